"""Line dedup by a fixed-depth log-template tree, in DataFrame functions only.

A line's tokens with a digit are variable fields (`<*>`).  Its leaf in the tree is its token count and its first `depth` tokens.  The first
line of a leaf (by doc_id, then position) founds the leaf's template; a line of the leaf that agrees with it in at least `percent` of the
positions is generalised into it (the other positions are variable).  Of the lines left over, with `every_template`, each in the same order is generalised into the first
later template that it agrees with so, or founds one; without, each is its own template.  A template that occurs in
`min_docs` documents or more is recurring: only its first line stays, every other line of it is dropped.  Lines of fewer than
`min_tokens` tokens and fewer than `min_chars` characters, and so blank lines, are never dropped: brackets, headings and single words recur in any
corpus.  A script without spaces gives one token a line, so its lines recur word for word only.

Lines end with a newline only; kept lines are joined again with newlines, so a text that loses nothing is unchanged.  A null text stays null.
A document that loses every line keeps an empty text.  Equal rows (same id, same text) are one document and come out alike; rows without an
id sort first and are told apart by their text.  Other columns stay as they are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siltstone.llm.shared import cut

VARIABLE = "<*>"
#: Bits of the map of documents that a join concerns: at most 2**12 rows of 4 KB are broadcast.  A full map only spares fewer texts the shuffle.
MAP_BITS = 27
#: Leaves with up to so many lines that may agree are compared in one row each, larger ones in rounds over the whole table.
TOGETHER = 256


def _once(expression: Column) -> Column:
    """A generator of one row: what it makes is computed once, however often it is used above."""
    return F.explode(F.array(expression))


def _bit(key: Column) -> Column:
    return F.shiftrightunsigned(key, 64 - MAP_BITS) + 1


def _marked(docs: DataFrame, keys: DataFrame) -> DataFrame:
    """docs with `maybe`: whether dkey may be among keys.wkey; never false for one that is."""
    parts = keys.groupBy(F.bitmap_bucket_number(_bit(F.col("wkey"))).alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(_bit(F.col("wkey")))).alias("bits"))
    at = F.bitmap_bit_position(_bit(F.col("dkey")))
    byte = F.conv(F.hex(F.substring("bits", (at / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    hit = F.expr("shiftright(byte, CAST(bit % 8 AS INT)) % 2 = 1")
    joined = docs.join(F.broadcast(parts), F.bitmap_bucket_number(_bit(F.col("dkey"))) == F.col("bucket"), "left").withColumns({"byte": byte, "bit": at})
    return joined.withColumn("maybe", F.coalesce(hit, F.lit(False))).drop("bucket", "bits", "byte", "bit")


def _tokens(line: Column) -> Column:
    """Fields with a digit are variable.  The look-behind lets the pattern start at tokens only, so a very long token costs linear time."""
    masked = F.when(line.rlike("[0-9]"), F.regexp_replace(line, r"(?<!\S)[^\s0-9]*+[0-9]\S*", VARIABLE)).otherwise(line)
    return F.split(F.btrim(masked, F.lit(" \t\r\f\v")), r"\s+")


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = F.col(text_col).cast("string")
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), text.alias("text")).withColumn("dkey", F.xxhash64("doc_id", "text"))


def line_table(docs: DataFrame, depth: int, min_tokens: int, min_chars: int) -> DataFrame:
    """at (doc_id, dkey, pos), leaf and form (hash of the masked tokens) of every line with enough tokens or characters."""
    lines = docs.where("text IS NOT NULL").select("doc_id", "dkey", F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    lines = lines.select(F.struct("doc_id", "dkey", "pos").alias("at"), (F.length(F.btrim("line", F.lit(" \t\r\f\v"))) >= min_chars).alias("long"), _once(_tokens(F.col("line"))).alias("tokens"))
    return lines.where((F.size("tokens") >= min_tokens) | F.col("long")).select("at", F.xxhash64(F.size("tokens"), F.slice("tokens", 1, depth)).alias("leaf"), F.xxhash64("tokens").alias("form"))


def _agree(a: Column, b: Column, percent: int) -> Column:
    return 100 * F.size(F.filter(F.zip_with(a, b, lambda x, y: x == y), lambda x: x)) >= percent * F.size(a)


def _bands(rest: DataFrame, depth: int, percent: int) -> DataFrame:
    """(leaf, form, at, band): two lines of a leaf that agree share a band at least; bands that only one line of the leaf has are left out.

    Lines that agree differ in at most n_off positions behind the leading tokens, so of n_off + 1 bands of these positions one is equal.
    """
    n = F.size("tokens")
    n_off = F.floor(n * (100 - percent) / 100).cast("int")
    behind = F.greatest(n - depth, F.lit(0))

    def edge(k: Column) -> Column:
        return F.least(F.lit(depth), n) + F.floor(k * behind / (n_off + 1)).cast("int")

    bands = F.transform(F.sequence(F.lit(0), n_off), lambda k: F.xxhash64("leaf", k, F.slice("tokens", edge(k) + 1, edge(k + 1) - edge(k))))
    held = rest.select("leaf", "form", "at", F.explode(bands).alias("band"))
    often = held.groupBy("band").agg(F.count("*").alias("n")).where("n > 1").select(F.col("band").alias("b"))
    return held.join(often, F.col("band") == F.col("b")).drop("b")


def _together(rest: DataFrame, percent: int) -> DataFrame:
    """(leaf, form, leader) of the lines of leaves of at most TOGETHER lines: each leaf's lines compared in order."""
    own = rest.groupBy("leaf").agg(F.array_sort(F.collect_list(F.struct("at", "form", "tokens"))).alias("own"))
    start = F.struct(F.expr("slice(own, 1, 0)").alias("leaders"), F.expr("CAST(array() AS ARRAY<STRUCT<form: BIGINT, leader: BIGINT>>)").alias("out"))

    def step(state: Column, x: Column) -> Column:
        hits = F.filter(state["leaders"], lambda y: _agree(x["tokens"], y["tokens"], percent))
        return F.element_at(
            F.transform(
                F.array(hits),
                lambda h: F.struct(
                    F.when(F.size(h) > 0, state["leaders"]).otherwise(F.concat(state["leaders"], F.array(x))).alias("leaders"),
                    F.concat(state["out"], F.array(F.struct(x["form"].alias("form"), F.coalesce(F.get(h, F.lit(0))["form"], x["form"]).alias("leader")))).alias("out"),
                ),
            ),
            1,
        )

    return own.select("leaf", F.inline(F.aggregate("own", start, step, lambda s: s["out"]))).where("form <> leader")


def _in_rounds(rest: DataFrame, bands: DataFrame, percent: int) -> DataFrame:
    """(leaf, form, leader) as _together gives them, for leaves of any size: no leaf is gathered anywhere.

    A line that is the first open one in all its bands agrees with no earlier line, so it founds a template.  Each round finds all such founders.  Where many
    lines of a leaf share their bands these are few, so the first TOGETHER open lines of each leaf are compared in order as well: no open line stands
    before them, so what they found or follow is final.  The lines behind all these founders in their bands are compared with them; one that agrees is no
    longer open, and follows the first founder that it agrees with.  So a round settles TOGETHER lines of a leaf at least.
    """
    key = ["leaf", "form"]
    rest, slots = cut(rest), cut(bands)
    open_ = waiting = cut(rest.select(*key, "at"))
    following, nth = None, F.row_number().over(Window.partitionBy("leaf").orderBy("at"))
    while open_.take(1):
        live = slots.join(open_.select(*key), key)
        heads = live.groupBy("band").agg(F.min(F.struct("at", "form")).alias("head"))
        marked = live.join(heads, "band").groupBy(*key).agg(F.min(F.col("head.form") == F.col("form")).alias("first"))
        early = cut(open_.withColumn("nth", nth).where(F.col("nth") <= TOGETHER).select(*key))
        known = rest.select("leaf", F.col("form").alias("leader"), F.col("at").alias("since"), F.col("tokens").alias("base"))
        led = cut(_together(rest.join(early, key), percent).join(known.drop("base"), ["leaf", "leader"]).select(*key, F.struct("since", "leader").alias("to")))
        alone = open_.join(marked, key, "left").where(F.coalesce("first", F.lit(True))).select(*key)
        founders = cut(alone.unionByName(early.join(led, key, "left_anti")).distinct())
        waiting = cut(waiting.join(founders, key, "left_anti").join(early, key, "left_anti"))
        founding = slots.join(founders, key).select("band", F.col("form").alias("leader"), F.col("at").alias("since"))
        pairs = slots.join(waiting.select(*key), key).join(founding, "band").where(F.col("at") > F.col("since")).select(*key, "leader").distinct()
        agree = pairs.join(rest.select(*key, "tokens"), key).join(known, ["leaf", "leader"]).where(_agree(F.col("tokens"), F.col("base"), percent)).select(*key, F.struct("since", "leader").alias("to"))
        agree = agree.unionByName(led)
        following = cut((agree if following is None else following.unionByName(agree)).groupBy(*key).agg(F.min("to").alias("to")))
        open_ = cut(waiting.join(open_.select(*key), key, "left_semi").join(following, key, "left_anti"))
    none = rest.select(*key, F.col("form").alias("leader")).limit(0)
    return none if following is None else following.select(*key, F.col("to.leader").alias("leader"))


def _later(rest: DataFrame, depth: int, percent: int) -> DataFrame:
    """(leaf, form, leader) of lines that are generalised into a later template of their leaf.  Lines that share no band with another are left out."""
    rest = cut(rest)
    bands = cut(_bands(rest, depth, percent))
    some = bands.select(F.col("leaf").alias("sl"), F.col("form").alias("sf")).distinct()
    many = cut(some.groupBy("sl").agg(F.count("*").alias("n")).where(F.col("n") > TOGETHER).select(F.col("sl").alias("ml")))
    some = rest.join(some, (F.col("leaf") == F.col("sl")) & (F.col("form") == F.col("sf"))).select("leaf", "form", "at", "tokens")
    led = _together(some.join(many, F.col("leaf") == F.col("ml"), "left_anti"), percent)
    if many.take(1):
        large = F.col("leaf") == F.col("ml")
        led = led.unionByName(_in_rounds(some.join(many, large, "left_semi"), bands.join(many, large, "left_semi"), percent))
    return led


def _generalised(docs: DataFrame, lines: DataFrame, depth: int, percent: int, every_template: bool) -> DataFrame:
    """(leaf, form, leader) of the lines that are generalised into an earlier line of their leaf."""
    forms = lines.groupBy("leaf", "form").agg(F.min("at").alias("at"))
    leaves = forms.groupBy("leaf").agg(F.min(F.struct("at", "form")).getField("form").alias("founder"), F.min("form").alias("lo"), F.max("form").alias("hi")).where("lo <> hi").select(F.col("leaf").alias("l"), "founder")
    wanted = forms.join(leaves, F.col("leaf") == F.col("l")).select(F.col("at.doc_id").alias("wid"), F.col("at.dkey").alias("wkey"), F.struct(F.col("at.pos").alias("pos"), "leaf", "form", "founder").alias("w"))
    wanted = wanted.groupBy("wid", "wkey").agg(F.collect_list("w").alias("ws"))
    wanted = cut(wanted)
    some = _marked(docs, wanted).where("maybe")
    text = some.join(wanted, F.col("doc_id").eqNullSafe(F.col("wid")) & (F.col("dkey") == F.col("wkey"))).select("wid", "wkey", "ws", _once(F.split("text", "\n")).alias("rows"))
    got = text.select(F.inline(F.transform("ws", lambda w: F.struct(w["leaf"].alias("leaf"), w["form"].alias("form"), w["founder"].alias("founder"), F.struct("wid", "wkey", w["pos"].alias("pos")).alias("at"), F.get("rows", w["pos"]).alias("line")))))
    got = cut(got.dropDuplicates(["leaf", "form"]).select("leaf", "form", "founder", "at", _tokens(F.col("line")).alias("tokens")))
    first = got.where("form = founder").select(F.col("leaf").alias("l"), F.col("tokens").alias("base"))
    both, agree = got.join(first, F.col("leaf") == F.col("l")), _agree(F.col("tokens"), F.col("base"), percent)
    led = both.where(agree).select("leaf", "form", F.col("founder").alias("leader"))
    if every_template:
        led = led.unionByName(_later(both.where(~agree).select("leaf", "form", "at", "tokens"), depth, percent))
    return led.select(F.col("leaf").alias("gleaf"), F.col("form").alias("gform"), "leader")


def recurring_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", depth: int = 3, percent: int = 80, min_docs: int = 2, min_tokens: int = 4, every_template: bool = False, min_chars: int = 20) -> DataFrame:
    """(doc_id, dkey, drops): positions of the dropped lines of each document that loses some; dkey = xxhash64(doc_id, text)."""
    docs = _keyed(docs, id_col, text_col)
    lines = cut(line_table(docs, depth, min_tokens, min_chars))
    general = _generalised(docs, lines, depth, percent, every_template)
    named = lines.join(general, (F.col("leaf") == F.col("gleaf")) & (F.col("form") == F.col("gform")), "left")
    named = named.select("at", F.xxhash64("leaf", F.coalesce("leader", "form")).alias("template"))
    named = cut(named)
    each = named.groupBy("template", F.col("at.doc_id").alias("doc_id"), F.col("at.dkey").alias("dkey")).agg(F.min("at").alias("first"))
    often = each.groupBy("template").agg(F.count("*").alias("n_docs"), F.min("first").alias("first")).where(F.col("n_docs") >= min_docs).select(F.col("template").alias("t"), "first")
    often = cut(often)  # the join below then deals both sides itself and can split a template with very many lines
    # the first line of a document with a null id: compared null-safe
    drops = named.join(often, F.col("template") == F.col("t")).where(~F.col("at").eqNullSafe(F.col("first")))
    return drops.groupBy(F.col("at.doc_id").alias("doc_id"), F.col("at.dkey").alias("dkey")).agg(F.collect_set("at.pos").alias("drops"))


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", count_col: str | None = None, **params) -> DataFrame:
    """docs with the recurring lines taken out of text_col; count_col, if given, gets the number of dropped lines.  Columns and rows stay."""
    gone = cut(recurring_lines(docs, id_col, text_col, **params).select(F.col("doc_id").alias("wid"), F.col("dkey").alias("wkey"), "drops"))
    text = F.col(f"row.{text_col}").cast("string")
    keyed = docs.select(F.struct("*").alias("row"), F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(F.col(id_col).cast("long"), F.col(text_col).cast("string")).alias("dkey"))
    marked = _marked(keyed, gone)
    rest = marked.where("NOT maybe").select("row", text.alias("text"), F.lit(0).cast("long").alias("n"))
    hit = marked.where("maybe").join(gone, F.col("doc_id").eqNullSafe(F.col("wid")) & (F.col("dkey") == F.col("wkey")), "left")
    hit = hit.select("row", "drops", text.alias("text"), _once(F.split(text, "\n")).alias("lines"))
    kept = F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), F.col("drops"))
    new = F.when(F.col("drops").isNull(), F.col("text")).otherwise(F.array_join(F.transform(kept, lambda i: F.get("lines", i)), "\n"))
    hit = hit.select("row", new.alias("text"), F.coalesce(F.size("drops"), F.lit(0)).cast("long").alias("n"))
    both = rest.unionByName(hit)
    return both.select(*[F.col("text").alias(c) if c == text_col else F.col(f"row.{c}").alias(c) for c in docs.columns], *([F.col("n").alias(count_col)] if count_col else []))
