"""The pipeline's stages and the registered queries."""

import pytest
from compare import assert_same
from pyspark.sql import functions as F
from test_pairs import brute
from test_rows import brute_lines

import corpus_pipeline as C
from siltstone.llm import queries as Q


@pytest.mark.parametrize("name", sorted(Q.ORACLES))
def test_query_against_sql(spark, sf, name):
    assert_same(Q.QUERIES[name](spark, sf), Q.ORACLES[name], sf)


def test_stages(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns = docs.columns
    clean = C.toxicity(spark, docs, sf)
    toxic = {r["doc_id"] for r in docs.join(clean, "doc_id", "left_anti").collect()}
    labelled = {r["doc_id"]: r["toxic"] for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    assert all(labelled.get(i, 1) for i in toxic)

    lines = C.line_dedup(spark, clean, sf).cache()
    want = brute_lines([(r["doc_id"], r["text"]) for r in clean.collect()])
    assert {r["doc_id"]: r["text"] for r in lines.collect()} == {i: t for i, t in want.items() if t.strip()}
    assert lines.where(F.length("text") != F.col("n_chars")).count() == 0

    near = C.near_duplicates(spark, lines, sf).cache()
    parts = brute([(r["doc_id"], r["text"]) for r in lines.collect()])
    assert {r["doc_id"] for r in near.collect()} == {i for i, (_, c) in parts.items() if i == c}

    kept = C.decontamination(spark, near, sf)
    out = C.pieces(spark, kept, sf).collect()
    assert {r["doc_id"] for r in out} == {r["doc_id"] for r in kept.collect()} and all(r["lossless"] for r in out)
    assert all(s.columns == columns for s in (clean, lines, near, kept))


def test_near_duplicates_of_repeated_rows(spark):
    text = "one two three four five six"
    docs = spark.createDataFrame([(1, text), (1, text), (2, text), (3, "other words stand in this row"), (None, text), (4, None)], "doc_id long, text string")
    got = sorted((r["doc_id"] for r in C.near_duplicates(spark, docs, "").collect()), key=repr)
    assert got == sorted([1, 3, 4, None], key=repr)


def test_run(spark, sf):
    rows = C.run(spark, sf).collect()
    assert rows and all(r["lossless"] for r in rows)


ODD = [(1, None, "a"), (2, "", "a"), (None, "no id stands here in this row", "a"), (None, "no id stands here in this row", "a"), (3, "word " * 30_000, "b"), (4, "same text of eight words stands here now", "b"), (4, "same text of eight words stands here now", "b"), (5, "same text of eight words stands here now", "b")]


def written(spark, folder, rows):
    docs = spark.createDataFrame(rows, "doc_id long, text string, component_id string").withColumn("n_chars", F.length("text").cast("long"))
    docs.write.mode("overwrite").parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(1, 0), (5, 0)], "doc_id long, toxic int").write.mode("overwrite").parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([(1, "an item of the benchmark that no text of these has")], "item_id long, text string").write.mode("overwrite").parquet(f"{folder}/benchmark.parquet")
    return spark.read.parquet(f"{folder}/documents.parquet")


def test_stages_of_odd_rows(spark, tmp_path):
    docs = written(spark, str(tmp_path), ODD)
    plain = lambda df: sorted(((r["doc_id"], r["text"], r["component_id"]) for r in df.collect()), key=repr)
    everything = sorted(ODD, key=repr)
    assert plain(C.toxicity(spark, docs, str(tmp_path))) == everything
    assert plain(C.decontamination(spark, docs, str(tmp_path))) == everything
    # equal rows are one document, so 4 keeps its line and 5 loses it
    assert plain(C.line_dedup(spark, docs, str(tmp_path))) == sorted([r for r in ODD if r[0] != 5], key=repr)
    near = plain(C.near_duplicates(spark, docs, str(tmp_path)))
    assert near == sorted([*ODD[:5], ODD[5]], key=repr)
    coded = C.pieces(spark, docs, str(tmp_path)).collect()
    assert len(coded) == len(ODD) and all(r["lossless"] for r in coded) and sum(r["n_pieces"] == 0 for r in coded) == 2
    for name, stage in C.STAGES:
        assert stage(spark, docs.limit(0), str(tmp_path)).count() == 0, name


def test_run_of_odd_rows_and_an_empty_table(spark, tmp_path):
    written(spark, str(tmp_path), ODD)
    got = sorted((r["doc_id"] for r in C.run(spark, str(tmp_path)).collect()), key=repr)
    assert got == sorted([1, 2, None, None, 3, 4], key=repr)
    written(spark, str(tmp_path), [])
    assert C.run(spark, str(tmp_path)).count() == 0


def test_a_broken_run_goes_on(spark, tmp_path, monkeypatch):
    written(spark, str(tmp_path), ODD)
    calls, stages = [], list(C.STAGES)

    def noted(name, stage, fail):
        def f(*a):
            calls.append(name)
            if fail:
                raise RuntimeError("lost")
            return stage(*a)

        return name, f

    monkeypatch.setattr(C, "STAGES", [noted(n, s, n == "near_duplicates") for n, s in stages])
    with pytest.raises(RuntimeError):
        C.run(spark, str(tmp_path), run_id="again")
    monkeypatch.setattr(C, "STAGES", [noted(n, s, False) for n, s in stages])
    rows = C.run(spark, str(tmp_path), run_id="again").collect()
    assert calls == ["toxicity", "line_dedup", "near_duplicates", "near_duplicates", "decontamination", "sentencepiece"] and len(rows) == 6
