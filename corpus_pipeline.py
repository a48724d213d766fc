"""A corpus pipeline: documents without toxic texts, recurring lines, near copies and benchmark leaks, as sampled pieces.

Each stage takes (spark, docs, sf_dir) and works on every row that the one before it kept; run() writes each stage's rows as Parquet in the shared
folder of spark.checkpoint.dir and reads them again for the next stage.

Rows, in every stage: null ids, null and empty texts, repeated rows, very long texts and further columns are kept as they are unless the stage's
own rule says otherwise; an empty table gives an empty table.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from siltstone.llm.decontamination import decontaminate
from siltstone.llm.jaccard_join import jaccard_components
from siltstone.llm.line_templates import dedup_lines
from siltstone.llm.piece_sampling import round_trip
from siltstone.llm.shared import ensure_checkpoint_dir, table, without_shuffles
from siltstone.llm.toxicity import fit, keep_clean


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose text the classifier chain, fitted on the labelled rows among docs, does not call toxic.  A null or empty text is never toxic."""
    return keep_clean(docs, fit(docs, table(spark, sf_dir, "labels")))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without their recurring lines; a row that loses all its words goes, one that had none before, or a null text, stays.  n_chars follows the text."""
    count = "__dropped"
    out = dedup_lines(docs, count_col=count, every_template=True)
    out = out.where((F.col(count) == 0) | F.col("text").rlike(r"\S")).drop(count)
    return out.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else out


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of similar texts, that of the smallest id; of rows with one id the one of the least text.

    Rows without an id, and rows without words, which are similar to nothing, stay.
    """
    parts = jaccard_components(docs).where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.min("component_id").alias("c"), F.count("*").alias("n"))
    gone = parts.where("doc_id <> c OR n > 1").select(F.col("doc_id").alias("__id"), (F.col("doc_id") == F.col("c")).alias("__again"))
    marked = docs.join(gone, docs["doc_id"] == F.col("__id"), "left")
    first = F.row_number().over(Window.partitionBy("doc_id").orderBy("text"))
    again = marked.where("__again").withColumn("__nth", first).where("__nth = 1")
    return marked.where("__again IS NULL").select(docs.columns).unionByName(again.select(docs.columns))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item, exact or with other values in its template.  Null and empty texts hold none."""
    return decontaminate(docs, table(spark, sf_dir, "benchmark"))


def pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_pieces, pieces, lossless: a row for each row of docs; a null or empty text has no pieces."""
    return round_trip(docs)


STAGES = [("toxicity", toxicity), ("line_dedup", line_dedup), ("near_duplicates", near_duplicates), ("decontamination", decontamination), ("sentencepiece", pieces)]

#: No stage but its joins can be said in SQL; the tests hold the stages against brute-force versions.
ORACLE_SQL = None


def _path(spark: SparkSession, name: str):
    path = spark._jvm.org.apache.hadoop.fs.Path(name)
    return path, path.getFileSystem(spark._jsc.hadoopConfiguration())


def _done(spark: SparkSession, name: str) -> bool:
    path, fs = _path(spark, f"{name}/_SUCCESS")
    return fs.exists(path)


def _remove(spark: SparkSession, name: str) -> None:
    path, fs = _path(spark, name)
    fs.delete(path, True)


def run(spark: SparkSession, sf_dir: str, run_id: str | None = None) -> DataFrame:
    """The rows of the last stage, over the documents of sf_dir.

    A stage's folder goes when the next stage is written; the one that the result reads stays.  A run that is started again with the run_id of one that
    broke off goes on behind the last stage that was written.
    """
    ensure_checkpoint_dir(spark)
    # the session has a folder of its own inside the shared one; a run that goes on may be in another session
    folder = f"{spark.sparkContext.getCheckpointDir().rsplit('/', 1)[0]}/corpus-pipeline-{run_id or uuid.uuid4().hex}"
    written = [f"{folder}/{k}-{name}" for k, (name, _) in enumerate(STAGES[:-1])]
    at = max((k + 1 for k, name in enumerate(written) if _done(spark, name)), default=0)
    for k in range(at, len(written)):
        docs = spark.read.parquet(written[k - 1]) if k else table(spark, sf_dir, "documents")
        rows = STAGES[k][1](spark, docs, sf_dir)
        with without_shuffles(spark):
            rows.write.mode("overwrite").parquet(written[k])
        if k:
            _remove(spark, written[k - 1])
    return STAGES[-1][1](spark, spark.read.parquet(written[-1]), sf_dir)
