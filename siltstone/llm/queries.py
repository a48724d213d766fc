"""The registered queries of the ten operators, each over its whole table with production parameters, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.llm.shared import table


def op6_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from siltstone.llm.jaccard_join import jaccard_components

    return jaccard_components(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id", "class_id")


def op1_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from siltstone.llm.decontamination import contaminated

    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from siltstone.llm.line_templates import dedup_lines

    return dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"), count_col="n_dropped", every_template=True)


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from siltstone.llm.toxicity import fit, score

    docs = table(spark, sf_dir, "documents")
    return score(docs, fit(docs, table(spark, sf_dir, "labels")))


def op5_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    from siltstone.llm.piece_sampling import round_trip

    return round_trip(table(spark, sf_dir, "documents"))


def op2_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    from siltstone.llm.sharding import shard

    rows = shard(table(spark, sf_dir, "documents"), shards=8)
    return rows.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "row_number")


def op3_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from siltstone.llm.secret_scan import scan

    return scan(table(spark, sf_dir, "documents")).select("doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_guess")


def op4_licence_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from siltstone.llm.licences import scan

    return scan(table(spark, sf_dir, "documents"))


def op7_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    from siltstone.llm.media import describe

    rows = describe(table(spark, sf_dir, "documents"))
    feature = F.concat_ws(":", F.size("fingerprints").cast("string"), F.lower(F.hex(F.xxhash64("fingerprints"))))
    return rows.select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", feature.alias("feature"), "fingerprints")


#: The query's rules: host, path, verdict.
URL_RULES = (("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block"))


def op8_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    from siltstone.llm.url_rules import judge

    return judge(table(spark, sf_dir, "pages"), spark.createDataFrame(URL_RULES, "host string, path string, verdict string"))


OPERATORS = (op1_benchmark_decontamination, op2_sharding, op3_secret_scan, op4_licence_scan, op5_sentencepiece, op6_ngram_jaccard_join, op7_media_columns, op8_url_filter, op9_line_dedup, op10_toxicity)
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in OPERATORS}

_FITS = " OR ".join(f"((host = '{h}' OR host LIKE '%.{h}') AND starts_with(path, '{p}') AND rule = '{h}{p}')" for h, p, _ in URL_RULES)
_RULES = ", ".join(f"('{h}{p}', '{v}')" for h, p, v in URL_RULES)



def _mixed(x: str, i: int) -> str:
    """The round function of the Feistel network with seed 0 in SQL."""
    p = 2**31 - 1
    y = f"(((({x} + {i * 1000003}) % {p}) * 48271 + 11) % {p})"
    u = f"((({y} * {y}) % {p} * 69621 + {x}) % {p})"
    return f"(({u} * {u}) % {p})"


_WALK = "SELECT row_number, steps, y // b AS l, y % b AS r, a, b, n FROM walk, grid WHERE steps = 0 OR y >= n"
for _i in range(6):
    _l, _r = (f"(l + {_mixed('r', _i)} % a) % a AS l", "r") if _i % 2 == 0 else ("l", f"(r + {_mixed('l', _i)} % b) % b AS r")
    _WALK = f"SELECT row_number, steps, {_l}, {_r}, a, b, n FROM ({_WALK})"

ORACLES: dict[str, str] = {
    # numbers in the order of the digests, the network and its walk as a recursion, CRC-32 from its table
    "op2_sharding": f"""
        WITH RECURSIVE facts AS (
            SELECT doc_id, coalesce(text, '') AS t, md5(coalesce(doc_id::VARCHAR, 'null') || ':' || md5(coalesce(text, ''))) AS key FROM documents
        ), numbered AS (
            SELECT doc_id, t, row_number() OVER (ORDER BY key) - 1 AS row_number FROM facts
        ), grid AS (
            SELECT n, a, (n + a - 1) // a AS b FROM (SELECT count(*) AS n, greatest(ceil(sqrt(count(*)))::BIGINT, 1) AS a FROM facts)
        ), walk AS (
            SELECT row_number, row_number AS y, 0 AS steps FROM numbered
            UNION ALL
            SELECT row_number, l * b + r, steps + 1 FROM ({_WALK})
        ), places AS (
            SELECT row_number, arg_max(y, steps) AS p FROM walk GROUP BY 1
        ), crc AS (
            SELECT list_transform(range(256), lambda k: list_reduce(range(8), lambda v, i: xor(v >> 1, CASE WHEN v & 1 = 1 THEN 3988292384 ELSE 0 END), k)) AS c
        )
        SELECT doc_id, (strlen(t) + 1)::BIGINT AS size, xor(list_reduce(list_transform(regexp_extract_all(hex(encode(t)), '..'), lambda h: ('0x' || h)::BIGINT), lambda v, x: xor(v >> 8, c[(xor(v, x) & 255) + 1]), 4294967295), 4294967295) AS text_crc32,
            'rows' AS law, (p % 8)::INTEGER AS shard, p // 8 AS slot, NULL::INTEGER AS grown_shard, row_number
        FROM numbered JOIN places USING (row_number), crc
    """,
    # shingles of every text, the pairs that share some, and the closure of the links
    "op6_ngram_jaccard_join": r"""
        WITH RECURSIVE w AS (
            SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents
        ), s AS MATERIALIZED (
            SELECT doc_id, array_to_string(w, ' ') AS whole, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')] ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) END AS g FROM w
        ), x AS MATERIALIZED (
            SELECT doc_id, len(g) AS n, unnest(g) AS g FROM s
        ), shared AS MATERIALIZED (
            SELECT doc_id, n, g FROM x WHERE g IN (SELECT g FROM x GROUP BY g HAVING count(*) > 1)
        ), links AS MATERIALIZED (
            SELECT a.doc_id AS a, b.doc_id AS b FROM shared a JOIN shared b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY a.doc_id, a.n, b.doc_id, b.n HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))
        ), reach AS (
            SELECT doc_id, doc_id AS c FROM s UNION SELECT r.doc_id, l.b FROM reach r JOIN links l ON l.a = r.c
        ), parts AS MATERIALIZED (
            SELECT doc_id, min(c) AS component_id FROM reach GROUP BY 1
        )
        SELECT doc_id, len(g)::BIGINT AS n_shingles, component_id, CASE WHEN len(g) = 0 THEN doc_id ELSE min(doc_id) OVER (PARTITION BY whole) END AS class_id FROM s JOIN parts USING (doc_id)
    """,
    "op8_url_filter": f"""
        WITH parts AS (
            SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages
        ), split AS (
            SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
                   regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path
            FROM parts
        ), ranked AS (
            SELECT page_id, host, path, rule, verdict, row_number() OVER (PARTITION BY page_id ORDER BY length(rule) DESC NULLS LAST) AS nth
            FROM split LEFT JOIN (VALUES {_RULES}) r(rule, verdict) ON {_FITS}
        )
        SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM ranked WHERE nth = 1
    """,
}
