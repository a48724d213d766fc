"""Benchmark decontamination by templates.

Words become template tokens: numbers ("120", or a run of number words such as "one hundred and twenty"), quantities, units and names turn into typed
placeholders, everything else is its lower-case form without outer punctuation.  The first word of a sentence may be a name or not, so windows with one are
taken in both readings.  Windows of `window` tokens of each benchmark item are matched with those of every document by hash join.

Where a window matches, its placeholders (slots) line up too, and the slots of a whole match must be consistent: one benchmark value stands for one document
value, and one document name for one benchmark name; numbers may coincide.  A match is not one alignment but a region, the windows whose alignments lie
within half an item of each other, so that inserted or left-out words don't part it.  In a region the value that most windows hold counts, and
windows that hold another are left out; a region with one name for two is left out whole.  The region with the most windows rules the text: windows elsewhere count if they don't contradict it.
If that covers too little, the other regions rule in turn, and then the values of each pair that the text holds, so that a match behind another one's windows or votes is found.
A document is contaminated by an item when consistent windows cover at least `coverage_percent` of the words that the item's windows cover, as `exact` when
all slots hold the same values, else as `reparameterised`.

Rows: a null text reads as empty; an empty text or item has no window and matches nothing.  Items with fewer than `window` tokens
are matched as one window of their own length, items with fewer than MIN_TOKENS are too unspecific and match nothing.  Windows that are less than
half literal words match with the same values only.  Items with the same template are one, named by their smallest id.  Of rows that share a doc_id the one that matches best
counts; rows without one are told apart by their text and reported under null.  Repeated rows count once, texts of any length are read whole.
Other columns are ignored.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltstone.llm.bytewords import Chunk, chunks, mix, runs, sequence_hashes, table_of, trim
from siltstone.llm.shared import cut, keyed_text

MIN_TOKENS = 5
#: Bits of the map of benchmark windows that is broadcast to spare other windows the shuffle: 16 MB, whatever the benchmark's size.
MAP_BITS = 27

# Words that are read as numbers, and units after a number.
NUMBER_WORDS = "zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen twenty thirty forty fifty sixty seventy eighty ninety hundred thousand million billion dozen half".split()
UNITS = "mm cm m km in inch inches ft foot feet yd yard yards mi mile miles mg g kg t ton tons lb lbs oz ounce ounces pound pounds ml l liter liters litre litres gallon gallons cup cups s sec second seconds min minute minutes h hr hour hours day days week weeks month months year years usd eur gbp dollar dollars euro euros cent cents pence percent % degree degrees c f k j kj w kw v a hz khz mhz ghz b kb mb gb tb mph kmh kph meter meters metre metres kilometer kilometers kilogram kilograms gram grams".split()

# Words that open a sentence as themselves, so that no second reading is made.
COMMON = "the an this that these those it its he she they we you his her their our your my there here then when while where why how what which who whose if as at by for from in into of on to with after before during each every all some many most no not and but or so yet also if is are was were do does did can could will would has have had let suppose find given calculate compute determine after until since because once now today yesterday".split()

NUM, UNIT, NAME, QUANTITY, EXACT = (np.uint64(x) for x in (0x1111, 0x2222, 0x3333, 0x4444, 0x5555))
_OUTER, _STOP = table_of(b".,;:!?\"'()[]{}<>*_`"), table_of(b".!?:")
_DIGIT = np.zeros(256, np.int32)
_DIGIT[48:58] = 1
_LETTER = np.zeros(256, np.int32)
_LETTER[[*range(65, 91), *range(97, 123), *range(128, 256)]] = 1


def _hashes_of(words: list[str]) -> np.ndarray:
    data = np.frombuffer(" ".join(words).encode(), np.uint8)
    chunk = Chunk(data, np.array([0, len(data)]), 0)
    starts, ends, _ = chunk.split()
    return np.sort(chunk.hashes(starts, ends))


def _among(values: np.ndarray, known: np.ndarray) -> np.ndarray:
    return known[np.minimum(np.searchsorted(known, values), len(known) - 1)] == values


_NUMBERS, _UNITS, _COMMON, _AND = _hashes_of(NUMBER_WORDS), _hashes_of(UNITS), _hashes_of(COMMON), _hashes_of(["and"])[0]


def template(chunk: Chunk):
    """Template token, value hash, slot flag of each word; the bounds of each text's words; and whether it opens a sentence and may be a name.

    The lowest bit of a value tells a name from other slots.
    """
    starts, ends, bounds = chunk.split()
    if not len(starts):
        none = np.zeros(0, np.uint64)
        return none, none, np.zeros(0, bool), bounds, np.zeros(0, bool)
    s, e = trim(chunk, starts, ends, _OUTER)
    values = chunk.hashes(s, e)
    digits, letters = (np.concatenate([[0], np.cumsum(t[chunk.data], dtype=np.int64)]) for t in (_DIGIT, _LETTER))
    n_digits, n_letters = digits[e] - digits[s], letters[e] - letters[s]
    word_number = _among(values, _NUMBERS)
    number = (n_digits > 0) & (n_letters == 0) | word_number
    first_letter = chunk.raw[s]
    second = chunk.raw[np.minimum(s + 1, len(chunk.raw) - 1)]
    capital = (first_letter >= 65) & (first_letter <= 90) | (first_letter == 0xC3) & (second >= 0x80) & (second <= 0x9E)
    opens = np.ones(len(s), bool)  # the first word of a text, sentence or line
    opens[1:] = _STOP[chunk.data[ends[:-1] - 1]]
    lines = np.concatenate([[0], np.cumsum(chunk.data == 10)])
    opens[1:] |= lines[starts[1:]] > lines[ends[:-1]]
    heads = bounds[:-1][np.diff(bounds) > 0]
    opens[heads] = True
    proper = capital & (e - s > 1) & (n_digits == 0)
    name = proper & ~opens
    after_number = np.zeros(len(s), bool)
    after_number[1:] = number[:-1]
    after_number[heads] = False
    unit = after_number & _among(values, _UNITS)
    # 5kg: digits, then letters that are a unit
    mixed = np.flatnonzero((n_digits > 0) & (n_letters > 0))
    quantity = np.zeros(len(s), bool)
    if len(mixed):
        head = s[mixed] + n_digits[mixed]
        plain = (digits[head] - digits[s[mixed]] == n_digits[mixed]) & (head < e[mixed])
        quantity[mixed[plain]] = _among(chunk.hashes(head[plain], e[mixed][plain]), _UNITS)
    tokens = np.select([number, unit, quantity, name], [NUM, UNIT, QUANTITY, NAME], values)
    slot = number | unit | quantity | name
    maybe = proper & opens & ~slot & ~_among(values, _COMMON)
    values = values & ~np.uint64(1) | (tokens == NAME) | maybe
    keep = ~_run_on(word_number, chunk.hashes(s, e) == _AND, heads)
    if not keep.all():
        values = np.where(number, _summed(values, keep) & ~np.uint64(1), values)
        bounds = np.concatenate([[0], np.cumsum(keep)])[bounds]
        tokens, values, slot, maybe = tokens[keep], values[keep], slot[keep], maybe[keep]
    return tokens, values, slot, bounds, maybe


def _run_on(number: np.ndarray, joins: np.ndarray, heads: np.ndarray) -> np.ndarray:
    """Whether a word goes on with the number word before it: a further number word, or an "and" between two."""
    inside = np.ones(len(number), bool)
    inside[heads] = False
    before, after = np.zeros(len(number), bool), np.zeros(len(number), bool)
    before[1:], after[:-1] = number[:-1], number[1:] & inside[1:]
    linked = joins & inside & before & after
    before[1:] |= linked[:-1]
    return number & inside & before | linked


def _summed(values: np.ndarray, keep: np.ndarray) -> np.ndarray:
    """At each kept place one value of it and the places that go on with it; a place alone keeps its own."""
    heads = np.flatnonzero(keep)
    nth = np.arange(len(values)) - np.repeat(heads, np.diff(np.append(heads, len(values))))
    with np.errstate(over="ignore"):
        terms = np.where(nth == 0, values, mix(values + nth.astype(np.uint64)))
        out = values.copy()
        out[heads] = np.add.reduceat(terms, heads)
    return out


def windows(chunk: Chunk, widths: list[int], whole: bool = False):
    """Per width and reading: (row, place, window hash, its hash in the first reading, .., slots before each word, whether the hash has the slots' values).

    The first reading has the windows with enough literal words; the second takes the words that may be names for names, and has the windows with such words
    only.  Windows of the first reading with fewer literal words are too unspecific as templates and are hashed with the values of their slots.

    whole: widths[0] is the full width, and a text of fewer words has one window of its own length (at least MIN_TOKENS).
    """
    tokens, values, slot, bounds, maybe = template(chunk)
    n = np.diff(bounds)
    unsure = np.concatenate([[0], np.cumsum(maybe)])
    readings = [(tokens, slot), (np.where(maybe, NAME, tokens), slot | maybe)] if maybe.any() else [(tokens, slot)]
    for width in widths:
        first = None
        for k, (tokens, slot) in enumerate(readings):
            before = np.concatenate([[0], np.cumsum(slot)])
            hashes, out = runs(tokens, bounds, width)
            if not len(hashes):
                break
            row = np.repeat(np.arange(len(n)), np.diff(out))
            place = np.arange(len(hashes)) - out[row]
            at = bounds[row] + place
            enough = 2 * (width - (before[at + width] - before[at])) >= width
            fits = n[row] == width if whole and width != widths[0] else np.ones(len(row), bool)
            hashes = mix(hashes ^ np.uint64(width))
            first = hashes if k == 0 else first
            keep = fits & enough & (unsure[at + width] > unsure[at]) if k else fits & enough
            yield row[keep], place[keep], hashes[keep], first[keep], at[keep], width, values, slot, before, False
            few = fits & ~enough
            if k == 0 and few.any():
                exact = mix(runs(values & ~np.uint64(1), bounds, width)[0] ^ EXACT ^ np.uint64(width))
                yield row[few], place[few], exact[few], first[few], at[few], width, values, slot, before, True


def _slots(at: np.ndarray, width: int, values: np.ndarray, slot: np.ndarray, before: np.ndarray) -> pa.ListArray:
    held = values[slot]
    lo, hi = before[at], before[at + width]
    bounds = np.concatenate([[0], np.cumsum(hi - lo)])
    inside = np.arange(bounds[-1]) - np.repeat(bounds[:-1], hi - lo) + np.repeat(lo, hi - lo)
    return pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(held[inside].view(np.int64)))


def _item_windows(items: DataFrame, window: int) -> DataFrame:
    """item_id, ikey, tpl (hash of the whole template), wh, unit (wh in the first reading), place, slots: one row for each window and reading of an item."""
    widths = [window, *range(min(MIN_TOKENS, window), window)]

    def run(batches):
        for batch in batches:
            ids, keys = batch.column("item_id"), batch.column("ikey")
            for chunk in chunks(batch.column("text")):
                tokens, values, _, bounds, _ = template(chunk)
                whole = sequence_hashes(tokens, bounds, 0x7F4A7C15)
                found = list(windows(chunk, widths, whole=True))
                # items with windows that go by their values are one only if their values are
                for row in (x[0] for x in found if x[-1]):
                    whole[row] = sequence_hashes(values, bounds, 0x1F83D9AB)[row]
                for row, place, wh, unit, at, width, values, slot, before, _ in found:
                    yield pa.RecordBatch.from_arrays(
                        [*(x.take(pa.array(row + chunk.first_row)) for x in (ids, keys)), pa.array(whole[row].view(np.int64)), pa.array(wh.view(np.int64)), pa.array(unit.view(np.int64)), pa.array(place.astype(np.int32)), pa.array(np.full(len(row), width, np.int32)), _slots(at, width, values, slot, before)],
                        ["item_id", "ikey", "tpl", "wh", "unit", "place", "width", "slots"],
                    )

    return items.mapInArrow(run, "item_id long, ikey long, tpl long, wh long, unit long, place int, width int, slots array<long>")


def _document_windows(docs: DataFrame, widths: list[int], seen) -> DataFrame:
    shift = np.uint64(64 - MAP_BITS)

    def run(batches):
        bits = seen.value
        for batch in batches:
            ids, keys = batch.column("doc_id"), batch.column("dkey")
            for chunk in chunks(batch.column("text")):
                for row, place, wh, _, at, width, values, slot, before, _ in windows(chunk, widths):
                    key = wh >> shift
                    hit = ((bits[(key >> np.uint64(3)).astype(np.int64)] >> (key & np.uint64(7)).astype(np.uint8)) & 1).astype(bool)
                    if hit.any():
                        yield pa.RecordBatch.from_arrays(
                            [*(x.take(pa.array(row[hit] + chunk.first_row)) for x in (ids, keys)), pa.array(wh[hit].view(np.int64)), pa.array(place[hit].astype(np.int32)), _slots(at[hit], width, values, slot, before)],
                            ["doc_id", "dkey", "wh", "place", "slots"],
                        )

    return docs.mapInArrow(run, "doc_id long, dkey long, wh long, place int, slots array<long>")


def _window_map(known: DataFrame):
    """Broadcast bit map of the benchmark's windows.  Its size is fixed; a full map only spares fewer rows the shuffle."""
    shift = 64 - MAP_BITS
    bits = np.zeros((1 << MAP_BITS) >> 3, np.uint8)
    for row in known.select(F.shiftrightunsigned("wh", shift).alias("key")).distinct().toLocalIterator():
        bits[row["key"] >> 3] |= 1 << (row["key"] & 7)
    return known.sparkSession.sparkContext.broadcast(bits)


def _agreeing(wins: list[tuple]) -> list[tuple]:
    """The (unit, span, pairs) that hold the most frequent document value of each benchmark value, of equally frequent ones the least; none if one name stands for two.

    A pair is (benchmark value, document value); the lowest bit tells names.
    """
    to = {}
    for (b, d), n in Counter(p for *_, pairs in wins for p in pairs).items():
        to[b] = min(to.get(b, (0, 0)), (-n, d))
    wins = [w for w in wins if all(to[b][1] == d for b, d in w[-1])]
    names = {p for *_, pairs in wins for p in pairs if p[0] & 1}
    return wins if len({d for _, d in names}) == len(names) else []


def _covered(wins: list[tuple]) -> int:
    return len({k for _, span, _ in wins for k in range(*span)})


def _led(wins: list[tuple], seed: tuple) -> list[tuple]:
    """The (unit, span, pairs) that agree with the pair `seed`, then value by value with the pair that most of those left hold; none if a name is left with no value of its own."""
    to, back, pair, left = {}, {}, seed, wins
    while pair:
        b, d = pair
        to[b] = d
        if b & 1:
            back[d] = b
        left = [w for w in left if all(to.get(x, y) == y and (not x & 1 or back.get(y, x) == x) for x, y in w[-1])]
        votes = Counter(p for *_, pairs in left for p in pairs if p[0] not in to)
        pair = min(votes, key=lambda p: (-votes[p], p), default=None)
    lost = {x for *_, pairs in wins for x, y in pairs if x & 1 and back.get(y, x) != x} - to.keys()
    return [] if lost else left


def consistent(wins: list[tuple], n_windows: int, least: int = 0) -> list[tuple]:
    """The (unit, span, pairs) of one text's windows (shift, unit, span, pairs) of one item that are consistent with its best region.

    If these cover fewer than `least` words, the text's other readings are tried: each pair of values as the first that holds, in its region and in the whole text.
    """
    wins = sorted(set(wins))
    regions, at = [], None
    for shift, *rest in wins:
        if at is None or shift - at > max(n_windows // 2, 1):
            regions.append([])
        regions[-1].append(tuple(rest))
        at = shift
    agreed = [_agreeing(r) for r in regions]

    def ruled(best: list[tuple]) -> list[tuple]:
        to = {b: d for *_, pairs in best for b, d in pairs}
        back = {d: b for b, d in to.items() if b & 1}
        return _agreeing([w[1:] for w in wins if all(to.get(b, d) == d and (not b & 1 or back.get(d, b) == b) for b, d in w[-1])]) or best

    if len(regions) == 1:
        found = agreed[0]
    else:
        found = ruled(max(agreed, key=lambda r: (len({x[0] for x in r}), all(b == d for *_, pairs in r for b, d in pairs))))  # the first of equal ones
    every = [w[1:] for w in wins]
    if _covered(found) >= least or _covered(every) < least:
        return found
    for region in agreed:
        if region and _covered(other := ruled(region)) >= least:
            return other
    for seed in sorted({p for *_, pairs in every for p in pairs}):
        for region in [r for r in regions if any(seed in w[-1] for w in r)]:
            # a region's own reading comes first, then what the rest of the text adds to it
            if (own := _led(region, seed)) and _covered(other := ruled(own)) >= least:
                return other
    return found


def _judged(hits: DataFrame) -> DataFrame:
    """(doc_id, dkey, ikey, n_covered, n_matched, n_pairs, changed) for each text and item.  Groups are streamed in the order of their keys; one is as large as its text at most."""

    def row(key, wins):
        good = consistent(wins, *key[3:])
        pairs = {p for *_, ps in good for p in ps}
        covered = {k for _, span, _ in good for k in range(*span)}
        return key[:3] + (len(covered), len({x[0] for x in good}), len(pairs), any(b != d for b, d in pairs))

    def out(rows):
        kinds = (*[pa.int64()] * 6, pa.bool_())
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(list(zip(*rows, strict=True)) or [[]] * 7, kinds, strict=True)], ["doc_id", "dkey", "ikey", "n_covered", "n_matched", "n_pairs", "changed"])

    def run(batches):
        known, wins = None, []
        for batch in batches:
            rows = []
            for *key, shift, unit, at, width, bslots, slots in zip(*(batch.column(c).to_pylist() for c in names), strict=True):
                if known != (key := tuple(key)):
                    if wins:
                        rows.append(row(known, wins))
                    known, wins = key, []
                wins.append((shift, unit, (at, at + width), tuple(sorted(set(zip(bslots, slots, strict=True))))))
            yield out(rows)
        if wins:
            yield out([row(known, wins)])

    keys, names = ["dkey", "ikey"], ["doc_id", "dkey", "ikey", "n_windows", "least", "shift", "unit", "bplace", "width", "bslots", "slots"]
    plain = hits.withColumn("shift", F.col("place") - F.col("bplace")).select(names).distinct()
    return plain.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(run, "doc_id long, dkey long, ikey long, n_covered long, n_matched long, n_pairs long, changed boolean")


def _contaminated(docs: DataFrame, items: DataFrame, window: int, coverage_percent: int, id_col: str, text_col: str, item_col: str, item_text_col: str) -> DataFrame:
    """The rows of contaminated() with dkey: the key of the row of a document without an id, else null."""
    docs = keyed_text(docs, id_col, text_col).withColumn("dkey", F.xxhash64("doc_id", "text"))
    items = keyed_text(items, item_col, item_text_col).withColumnRenamed("doc_id", "item_id").withColumn("ikey", F.xxhash64("item_id", "text"))
    found = _item_windows(items, window)
    names = found.groupBy("tpl").agg(F.min(F.struct(F.col("item_id").isNull().alias("none"), "item_id", "ikey")).getField("ikey").alias("item"))
    known = found.join(names.withColumnRenamed("tpl", "t"), (F.col("tpl") == F.col("t")) & (F.col("ikey") == F.col("item")))
    # one row for each item, window and reading: a window that an item repeats counts once
    known = known.groupBy("ikey", "wh", "unit").agg(F.min(F.struct("place", "slots", "width", "item_id")).alias("x"))
    known = cut(known.select("ikey", F.col("wh").alias("bwh"), "unit", F.col("x.place").alias("bplace"), F.col("x.slots").alias("bslots"), F.col("x.width").alias("width"), F.col("x.item_id").alias("item_id")))
    words = F.size(F.array_distinct(F.flatten(F.collect_list(F.sequence(F.col("bplace"), F.col("bplace") + F.col("width") - 1)))))  # of one item
    sizes = known.groupBy("ikey").agg(F.size(F.collect_set("unit")).alias("n_windows"), words.alias("n_words"), F.min("item_id").alias("item_id"))
    widths = sorted(r["width"] for r in known.select("width").distinct().collect())  # at most `window` numbers

    sized = known.drop("item_id").join(sizes.select(F.col("ikey").alias("i"), "n_windows", F.expr(f"({coverage_percent} * n_words + 99) DIV 100").alias("least")), F.col("ikey") == F.col("i")).drop("i")
    hits = _document_windows(docs, widths, _window_map(known.withColumnRenamed("bwh", "wh"))).join(sized, F.col("wh") == F.col("bwh"))
    got = _judged(hits).groupBy("doc_id", F.when(F.col("doc_id").isNull(), F.col("dkey")).alias("dkey"), "ikey").agg(F.max(F.struct("n_covered", "n_matched", (~F.col("changed")).alias("same"), "n_pairs")).alias("m"))
    got = got.join(sizes.withColumnRenamed("ikey", "i"), F.col("ikey") == F.col("i")).where(100 * F.col("m.n_covered") >= coverage_percent * F.col("n_words"))
    return got.select("doc_id", "item_id", F.col("n_windows").cast("long").alias("n_windows"), "m.n_matched", F.col("n_words").cast("long").alias("n_words"), "m.n_covered", F.col("m.n_pairs").alias("n_slots"), F.when(F.col("m.same"), "exact").otherwise("reparameterised").alias("kind"), "dkey")


def contaminated(docs: DataFrame, items: DataFrame, window: int = 8, coverage_percent: int = 50, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """(doc_id, item_id, n_windows, n_matched, n_words, n_covered, n_slots, kind): one row for each contaminated document and item template."""
    return _contaminated(docs, items, window, coverage_percent, id_col, text_col, item_col, item_text_col).drop("dkey")


def decontaminate(docs: DataFrame, items: DataFrame, window: int = 8, coverage_percent: int = 50, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """docs without the contaminated documents.  All columns stay as they are."""
    found = _contaminated(docs, items, window, coverage_percent, id_col, text_col, item_col, item_text_col)
    flagged = found.select(F.col("doc_id").alias("__leaked"), F.col("dkey").alias("__key")).distinct()
    key = F.xxhash64(docs[id_col].cast("long"), F.coalesce(docs[text_col].cast("string"), F.lit("")))
    return docs.join(flagged, docs[id_col].cast("long").eqNullSafe(F.col("__leaked")) & (F.col("__key").isNull() | (key == F.col("__key"))), "left_anti")
