"""Sharding by a Feistel permutation of global row numbers, in DataFrame functions only.

Rows get global numbers 0..n-1 in the order of a digest of id and text: equal rows are counted first, the different ones are dealt to buckets by the
digest's first digits, numbered inside each bucket with their counts, and shifted by the counts of the buckets before it; then each is
expanded to its copies, in pieces of PIECE numbers.  A keyed Feistel network over a grid of a * b >= n cells, a = ceil(sqrt(n)), permutes the numbers; a
number that lands outside 0..n-1 walks on along its cycle until it is inside.  Place p of the shuffle is slot p div shards of shard p mod shards, so
shards differ by one row at most and slots have no gap, and place, shard and slot of any row number can be computed without the data.

The order depends on the rows and the seed only, not on partitions.  Rows: any doc_id, null or repeated, is numbered like others; rows equal in
id and text take neighbouring numbers, in any order among them, and however many there are they are one row until they are expanded.
A null text counts as empty.  No rows: no rows.  Other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Hexadecimal digits of the digest that name a bucket of the numbering: 3 make 4,096; the table of their counts is the only thing that is broadcast.
DIGITS = 3
ROUNDS = 6
#: Numbers of one row's copies that are made together.
PIECE = 1 << 16
#: Steps of a walk that are tried first.  A walk meets the a * b - n <= a cells outside at most once each, so so many steps more always end it.
WALKS = 16
#: The round function computes with whole numbers below this prime, so every product fits a long.
PRIME = 2**31 - 1


def _mixed(x: Column, i: Column, seed: int) -> Column:
    """The round function: linear steps and squares of a half and the round's number."""
    once = lambda value, then: F.aggregate(F.array(value), F.lit(0).cast("long"), lambda _, v: then(v))
    y = ((x + i * 1000003 + seed % PRIME) % PRIME * 48271 + 11) % PRIME
    return once(y, lambda t: once((t * t % PRIME * 69621 + x) % PRIME, lambda u: u * u % PRIME))


def _step(x: Column, a: Column, b: Column, seed: int) -> Column:
    """One pass of the network over cell x = left * b + right."""

    def round_(s: Column, i: Column) -> Column:
        left, right = s["left"], s["right"]
        even = i % 2 == 0
        return F.struct(
            F.when(even, (left + _mixed(right, i, seed) % a) % a).otherwise(left).alias("left"),
            F.when(even, right).otherwise((right + _mixed(left, i, seed) % b) % b).alias("right"),
        )

    # whole numbers below 2**53 divide exactly
    start = F.struct(((x - F.pmod(x, b)) / b).cast("long").alias("left"), F.pmod(x, b).alias("right"))
    return F.aggregate(F.sequence(F.lit(0).cast("long"), F.lit(ROUNDS - 1).cast("long")), start, round_, lambda s: s["left"] * b + s["right"])


def permuted(x: Column, n: Column, seed: int = 0) -> Column:
    """The place of row number x (0 <= x < n) in the shuffle of n rows."""
    a = F.greatest(F.ceil(F.sqrt(n.cast("double"))).cast("long"), F.lit(1).cast("long"))
    b = F.greatest(((n + a - 1 - (n + a - 1) % a) / a).cast("long"), F.lit(1).cast("long"))

    def walk(start: Column, steps: Column) -> Column:
        return F.aggregate(F.sequence(F.lit(1).cast("long"), steps), start, lambda y, _: F.when(y >= n, _step(y, a, b, seed)).otherwise(y))

    walked = walk(_step(x, a, b, seed), F.lit(WALKS).cast("long"))
    return F.aggregate(F.array(walked), F.lit(0).cast("long"), lambda _, y: F.when(y < n, y).otherwise(walk(y, a * b - n + 1)))


def numbered(docs: DataFrame, key: str, digits: int = DIGITS, out: str = "row_number", total: str = "n_rows") -> DataFrame:
    """docs with global row numbers in the order of key, a hexadecimal digest, and their count.  Rows equal in all columns, which must be comparable, are interchangeable."""
    names = list(docs.columns)
    bucket = F.substring(key, 1, digits)
    kinds = docs.groupBy(*names).agg(F.count("*").alias("__n")).withColumn("__bucket", bucket)
    counts = docs.groupBy(bucket.alias("__b")).agg(F.count("*").alias("__c"))
    offsets = counts.selectExpr("__b", "sum(__c) OVER (ORDER BY __b) - __c AS __before", f"sum(__c) OVER () AS {total}")  # of at most 16**digits rows
    ranked = kinds.selectExpr("*", f"sum(__n) OVER (PARTITION BY __bucket ORDER BY {key} ROWS UNBOUNDED PRECEDING) - __n AS __first")
    placed = ranked.join(F.broadcast(offsets), F.col("__bucket") == F.col("__b")).withColumn("__first", F.col("__first") + F.col("__before")).select(*names, "__n", "__first", total)

    def expanded(rows: DataFrame, first: Column, n: Column) -> DataFrame:
        return rows.select(*names, total, F.explode(F.sequence(first, first + n - 1)).alias(out))

    few = expanded(placed.where(F.col("__n") <= PIECE), F.col("__first"), F.col("__n"))
    pieces = placed.where(F.col("__n") > PIECE).select("*", F.explode(F.expr(f"sequence(0, (__n - 1) div {PIECE})")).alias("__piece"))
    begin = F.col("__first") + F.col("__piece") * PIECE
    return few.unionByName(expanded(pieces.repartition("__first", "__piece"), begin, F.least(F.lit(PIECE), F.col("__first") + F.col("__n") - begin)))


def shard(docs: DataFrame, shards: int = 8, seed: int = 0, id_col: str = "doc_id", text_col: str = "text", digits: int = DIGITS) -> DataFrame:
    """(doc_id, size, text_crc32, row_number, shard, slot): one row for each row of docs."""
    text = F.encode(F.coalesce(F.col(text_col).cast("string"), F.lit("")), "UTF-8")
    doc_id = F.col(id_col).cast("long")
    key = F.md5(F.concat(F.coalesce(doc_id.cast("string"), F.lit("null")), F.lit(":"), F.md5(text)).cast("binary"))
    facts = docs.select(doc_id.alias("doc_id"), (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text).alias("text_crc32"), key.alias("__key"))
    place = numbered(facts, "__key", digits).withColumn("__p", permuted(F.col("row_number"), F.col("n_rows"), seed))
    return place.select("doc_id", "size", "text_crc32", "row_number", F.pmod("__p", F.lit(shards)).cast("int").alias("shard"), F.expr(f"__p div {int(shards)}").alias("slot"))
