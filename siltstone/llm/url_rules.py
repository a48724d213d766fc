"""URL filter: a sort-merge range join of URLs with nested prefix rules, in DataFrame functions only.

A rule (host, path) becomes the canonical key  reversed host labels, a zero byte, path ; it covers the interval from that key to the key with a
byte 255 after it.  Rule intervals are nested or disjoint.  A URL becomes one key for each suffix of its host that is not deeper than the deepest rule.
Sorting both together and sweeping once, each URL key meets the stack of rules that are open at its place: starts of intervals push, ends
pop.  The innermost rule of each key is the longest that fits that suffix; the longest over the suffixes wins, at equal length a block
rule, then the smaller rule.

A key of k labels meets only rules of that very host, since the zero byte ends the host.  So the sweep is dealt by host: each rule's boundaries go
where its host's URLs go, and keys whose host has no rule are not swept.  A host with more than `per_part` URL keys, as one with a third of all rows, is dealt to
several parts; only its own rules are copied to each of them, and parts have four keys for each rule at least, so the copies are fewer than the keys.

Rows: a null url, or one without "://", has an empty host and path, which only a rule with an empty host can fit.  Ports and user names
belong to the host as written.  Equal rows are judged each for itself.  Rules without a host count as empty host, without a path as empty path;
of equal rules with different verdicts the block rule counts.  No rules: every row gets the default.  Other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: URL keys of one host that one part sweeps.
PER_PART = 1 << 10

_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def _lower(c: Column) -> Column:
    return F.translate(c, _UPPER, _UPPER.lower())


def host_and_path(url: Column) -> tuple[Column, Column]:
    # what follows the first "://", though more may come
    rest = F.when(F.instr(url, "://") > 0, url.substr(F.instr(url, "://") + 3, F.length(url)))
    host = F.coalesce(_lower(F.regexp_extract(rest, r"^([^/?#]*)", 1)), F.lit(""))
    path = F.coalesce(F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1), F.lit(""))
    return host, path


def _key(labels: Column, path: Column) -> Column:
    return F.concat(F.encode(F.array_join(labels, "."), "UTF-8"), F.lit(bytearray([0])), F.encode(path, "UTF-8"))


def boundaries(rules: DataFrame) -> DataFrame:
    """(rhost, bkey, stack): from this key on, the open rules of the reversed host, outermost first, as (length, block, rule, verdict)."""
    host, path = _lower(F.coalesce(F.col("host"), F.lit(""))), F.coalesce(F.col("path"), F.lit(""))
    plain = rules.select(host.alias("host"), path.alias("path"), F.col("verdict")).groupBy("host", "path").agg(F.max("verdict").alias("verdict"))
    labels = F.reverse(F.split("host", r"\."))
    plain = plain.select(F.array_join(labels, ".").alias("rhost"), _key(labels, F.col("path")).alias("rkey"), F.struct(F.length(F.concat("host", "path")).alias("length"), (F.col("verdict") == "block").alias("block"), F.concat("host", "path").alias("rule"), "verdict").alias("r"))
    # The rules open at the start of a rule are those whose key is a prefix of its key.
    heads = plain.select("rhost", F.col("rkey").alias("inner"), F.explode(F.sequence(F.lit(1), F.length("rkey"))).alias("n")).select("rhost", "inner", F.expr("substring(inner, 1, n)").alias("head"))
    nested = heads.join(plain.drop("rhost"), F.col("head") == F.col("rkey")).groupBy("rhost", "inner").agg(F.sort_array(F.collect_list(F.struct(F.length("rkey").alias("depth"), "r"))).alias("s"))
    stack = F.transform("s", lambda x: x["r"])
    start = nested.select("rhost", F.col("inner").alias("bkey"), stack.alias("stack"))
    end = nested.select("rhost", F.concat("inner", F.lit(bytearray([255]))).alias("bkey"), F.slice(stack, 1, F.size("s") - 1).alias("stack"))
    return start.unionByName(end)


def judge(pages: DataFrame, rules: DataFrame, id_col: str = "page_id", url_col: str = "url", default: str = "allow", per_part: int = PER_PART) -> DataFrame:
    """(page_id, host, path, rule, verdict): one row for each row of pages."""
    host, path = host_and_path(F.col(url_col).cast("string"))
    bounds = rules.select(F.max(F.size(F.split(F.coalesce("host", F.lit("")), r"\."))).alias("labels"), F.max(F.octet_length(F.concat(F.coalesce("host", F.lit("")), F.coalesce("path", F.lit("")))) + 1).alias("length")).first()
    deepest, longest = bounds["labels"] or 1, bounds["length"] or 1

    rows = pages.select(F.col(id_col).alias("page_id"), host.alias("host"), path.alias("path"), F.monotonically_increasing_id().alias("rid"))
    labels = F.reverse(F.split("host", r"\."))
    rows = rows.select("page_id", "host", "path", "rid", labels.alias("labels")).select("*", F.explode(F.sequence(F.lit(1), F.least(F.size("labels"), F.lit(deepest)))).alias("k"))
    # No rule is longer than `longest` bytes, so a key cut there meets the same intervals.
    key = F.substring(_key(F.slice("labels", 1, F.col("k")), F.substring("path", 1, longest)), 1, longest)
    payload = F.when(F.col("k") == 1, F.struct("page_id", "host", "path"))
    # hosts, as reversed labels, that have rules and URLs, and the parts that each is dealt to
    ruled = rules.select(F.array_join(F.reverse(F.split(_lower(F.coalesce(F.col("host"), F.lit(""))), r"\.")), ".").alias("dealt")).groupBy("dealt").agg(F.count("*").alias("m"))
    suffix = F.array_join(F.slice("labels", 1, F.col("k")), ".")
    hosts = rows.groupBy(suffix.alias("part")).agg(F.count("*").alias("n")).join(ruled, F.col("part") == F.col("dealt")).select("dealt", F.ceil(F.col("n") / F.greatest(F.lit(per_part), 4 * F.col("m"))).alias("parts"))
    urls = rows.withColumn("part", suffix).join(hosts, F.col("part") == F.col("dealt"), "left").where("dealt IS NOT NULL OR k = 1")
    # a row that no rule concerns is only carried along
    salt = F.when(F.col("dealt").isNotNull(), F.pmod(F.xxhash64("rid"), F.col("parts"))).otherwise(F.xxhash64("rid"))
    urls = urls.select(F.col("dealt").alias("part"), salt.alias("salt"), key.alias("key"), F.lit(1).alias("kind"), "rid", payload.alias("page"))

    edges = boundaries(rules).join(hosts, F.col("rhost") == F.col("dealt"))
    edges = edges.select(F.col("dealt").alias("part"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("salt"), F.col("bkey").alias("key"), F.lit(0).alias("kind"), "stack")
    both = urls.unionByName(edges, allowMissingColumns=True)
    sweep = F.expr("last(stack, true) OVER (PARTITION BY part, salt ORDER BY key, kind ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)")
    met = both.select("rid", "kind", "page", sweep.alias("open")).where("kind = 1")
    best = met.groupBy("rid").agg(F.first("page", ignorenulls=True).alias("page"), F.collect_list(F.get("open", F.size("open") - 1)).alias("won"))
    # at most one rule for each label of the deepest rule
    order = F.transform("won", lambda r: F.struct((-r["length"]).alias("l"), (~r["block"]).alias("b"), r["rule"].alias("rule"), r["verdict"].alias("verdict")))
    first = F.get(F.sort_array(order), F.lit(0))
    return best.select("page.page_id", "page.host", "page.path", first["rule"].alias("rule"), F.coalesce(first["verdict"], F.lit(default)).alias("verdict"))
