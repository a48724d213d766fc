"""SentencePiece encoding by forward filtering and backward sampling, and lossless decoding.

A text is read as SentencePiece reads it: a space before it, spaces as the meta symbol, characters outside the vocabulary as byte pieces (a literal
meta symbol is one of those, so that decoding can tell it from a space).  Its pieces form a lattice over byte positions.  Forward filtering sums the
weights of all segmentations up to each position; backward sampling then draws a segmentation from the end with its exact probability,
by random numbers that depend on the seed, the row's key and the place in the text only: not on partitions, batches or retries.  Each node's edge is drawn
with a number of its own, so a draw doesn't hang on the way to the node.
Weights are exp(score / temperature): a piece's score is the model's log probability, or, for a model whose scores are merge
ranks, -log(rank + 2).  No piece of the model spans a space after another character, so words are separate lattices, and each distinct
word of a batch is filtered once.  Words up to TOGETHER bytes are filtered together, a position at a time.  Longer ones, as scripts without spaces and
encoded data have, are cut into blocks of so many bytes: all blocks together give the linear map from the weights before a block to those at its end, the
maps give the weights before each block, and with these all blocks are filtered together.  The cost is linear in the text for any word length.

Rows: a null text encodes like an empty one, to no pieces.  Equal rows get equal pieces; equal texts with different keys
are sampled apart.  A null key counts as one more key.  Any valid string decodes to itself.  Other columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siltstone.llm.bytewords import _ROOT, _TABLE, CHUNK_BYTES, _powers, chunks, mix

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
META = "▁"
#: Words up to so many bytes are filtered whole, and the blocks of longer ones are so long.
TOGETHER = 40
#: Blocks whose maps are held at once: as many matrices of the longest piece's length squared.
BLOCKS = 2048
SCALE = 1000.0
_SLOT_BITS = 20
#: Bytes of text that are encoded together; a longer text is taken by itself.
TOGETHER_BYTES = 1 << 20


def _sums(data: np.ndarray) -> np.ndarray:
    up, _ = _powers(max(CHUNK_BYTES, 1 << max(0, len(data) - 1).bit_length()))
    out = np.zeros(len(data) + 1, np.uint64)
    with np.errstate(over="ignore"):
        np.cumsum(_TABLE[data] * up[: len(data)], out=out[1:])
    return out


def _hash(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    _, down = _powers(max(CHUNK_BYTES, 1 << max(0, len(data) - 1).bit_length()))
    sums = _sums(data)
    with np.errstate(over="ignore"):
        return (sums[ends] - sums[starts]) * down[starts]


def _slot(h: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return (h * np.uint64(_ROOT)) >> np.uint64(64 - _SLOT_BITS)


@dataclass
class Pieces:
    """The vocabulary as arrays: piece bytes, lengths and scores; piece hashes with a chained hash table; ids of the byte pieces; weights times SCALE
    for each byte, which keeps the sums of words up to TOGETHER bytes within a double, or none at low temperatures.
    """

    blob: np.ndarray
    bounds: np.ndarray
    scores: np.ndarray
    keys: np.ndarray
    ids: np.ndarray
    lengths: np.ndarray
    heads: np.ndarray
    following: np.ndarray
    byte_ids: np.ndarray
    scaled: np.ndarray | None
    log_scale: float


def load(model: str = MODEL, temperature: float = 1.0) -> Pieces:
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=model)
    size = sp.get_piece_size()
    scores = np.array([sp.get_score(i) for i in range(size)])
    byte_ids = np.full(256, -1, np.int64)
    texts, usable = [], []
    for i in range(size):
        piece = sp.id_to_piece(i)
        if sp.is_byte(i):
            byte_ids[int(piece[1:-1], 16)] = i
            texts.append(bytes([int(piece[1:-1], 16)]))
        elif sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i):
            texts.append(b"")
        else:
            texts.append(piece.replace(META, " ").encode())
            usable.append(i)
            if " " in piece.replace(META, " ").lstrip(" "):
                raise ValueError(f"piece {i} spans a space after another character")
    if (byte_ids < 0).any():
        raise ValueError("the model has no byte fallback")
    usable = np.array(usable)
    if (scores[usable] == np.round(scores[usable])).all():
        scores = -np.log(2 - np.minimum(scores, 0))
    scores = np.where(_is_byte(byte_ids, size), -np.log(2.0 * size), scores) / temperature
    blob, bounds = np.frombuffer(b"".join(texts), np.uint8), np.concatenate([[0], np.cumsum([len(t) for t in texts])])
    hashes = _hash(blob, bounds[:-1], bounds[1:])[usable]
    if len(np.unique(hashes)) < len(hashes):
        raise ValueError("two pieces have the same hash")
    heads, following = np.full(1 << _SLOT_BITS, -1, np.int32), np.full(len(hashes), -1, np.int32)
    for k, slot in enumerate(_slot(hashes).astype(np.int64)):
        following[k], heads[slot] = heads[slot], k
    lengths = np.diff(bounds)
    scaled = np.exp(scores + np.log(SCALE) / temperature * np.maximum(lengths, 1)) if temperature >= 0.5 else None
    return Pieces(blob, bounds, scores, hashes, usable, lengths, heads, following, byte_ids, scaled, np.log(SCALE) / temperature)


def _is_byte(byte_ids: np.ndarray, size: int) -> np.ndarray:
    out = np.zeros(size, bool)
    out[byte_ids] = True
    return out


@dataclass
class Lattice:
    """The lattices of the words data[bounds[k]:bounds[k+1]].  Byte b of word k is node b + k, its end one more.

    The edges into node v are firsts[v]:firsts[v + 1], with their source nodes and pieces.  total: of a word up to TOGETHER bytes the summed, scaled
    weights of all segmentations up to a node; of a longer one, or at a low temperature, their logarithm.
    """

    base: np.ndarray
    length: np.ndarray
    firsts: np.ndarray
    src: np.ndarray
    ids: np.ndarray
    total: np.ndarray


def _matches(p: Pieces, data: np.ndarray, bounds: np.ndarray):
    """(source bytes, piece length, pieces) for each length, longest first, and last the bytes of characters that are no piece."""
    size = np.diff(bounds)
    room = np.repeat(bounds[1:], size) - np.arange(len(data))
    _, down = _powers(max(CHUNK_BYTES, 1 << max(0, len(data) - 1).bit_length()))
    sums = _sums(data)
    out, at = [], np.arange(len(data))
    lead = np.flatnonzero((data & 0xC0) != 0x80)
    width = np.zeros(len(data), np.int64)
    width[lead] = np.diff(np.append(lead, len(data)))
    covered = np.zeros(len(data), bool)
    for n in np.unique(p.lengths[p.ids]):
        at = at[room[at] >= n]
        if not len(at):
            break
        with np.errstate(over="ignore"):
            h = (sums[at + n] - sums[at]) * down[at]
        k = p.heads[_slot(h).astype(np.int64)]
        tried = np.flatnonzero(k >= 0)
        src, ids = [], []
        while len(tried):
            same = p.keys[k[tried]] == h[tried]
            hit = tried[same]
            src.append(at[hit])
            ids.append(p.ids[k[hit]])
            k[tried] = p.following[k[tried]]
            tried = tried[~same]
            tried = tried[k[tried] >= 0]
        if src:
            src, ids = np.concatenate(src), np.concatenate(ids)
            covered[src[width[src] == n]] = True
            out.append((src, n, ids))
    bare = np.flatnonzero(np.repeat(~covered[lead], width[lead]))
    return [*out[::-1], (bare, 1, p.byte_ids[data[bare]])]


def _filtered(p: Pieces, data: np.ndarray, bounds: np.ndarray) -> Lattice:
    """Forward filtering of all words at once, a position at a time; of longer words in blocks."""
    length = np.diff(bounds)
    word = np.repeat(np.arange(len(length)), length)
    base = bounds[:-1] + np.arange(len(length))
    nodes = len(data) + len(length)
    found = [(src + word[src], n, ids) for src, n, ids in _matches(p, data, bounds)]
    degree = np.zeros(nodes, np.int64)
    for src, n, _ in found:
        degree[src + n] += 1  # one edge of each length ends at a node
    firsts = np.concatenate([[0], np.cumsum(degree)])
    place = firsts[:-1].copy()
    sources, pieces = np.zeros(firsts[-1], np.int32), np.zeros(firsts[-1], np.int32)
    for src, n, ids in found:
        at = place[src + n]
        sources[at], pieces[at] = src, ids
        place[src + n] += 1
    del found, place
    total = np.zeros(nodes)
    short = np.flatnonzero(length <= _together(p))
    short = short[np.argsort(-length[short], kind="stable")]
    total[base[short]] = 1.0
    for k in range(1, int(length[short].max(initial=0)) + 1):
        at = base[short[: np.searchsorted(-length[short], -k, "right")]] + k
        edge, n = firsts[at], degree[at]
        acc = np.zeros(len(at))
        for j in range(int(n.max(initial=0))):
            on = np.flatnonzero(n > j)
            e = edge[on] + j
            acc[on] += total[sources[e]] * p.scaled[pieces[e]]
        total[at] = acc
    x = Lattice(base, length, firsts, sources, pieces, total)
    long = np.flatnonzero(length > _together(p))
    if len(long):
        _filter_blocks(p, x, long)
    return x


def _together(p: Pieces) -> int:
    """Words up to so many bytes are filtered in scaled weights."""
    return TOGETHER if p.scaled is not None else 0


def _advance(x: Lattice, weights: np.ndarray, start: np.ndarray, size: np.ndarray, held: np.ndarray, logs: bool, seen=None) -> np.ndarray:
    """Filter blocks a position at a time.  Block b has the size[b] nodes behind node start[b], sizes descending; held[b, i % reach] is the weight of node start[b] + i.

    held has a last axis for different weights before the blocks.  seen(nodes, weights) is called for each position.  Returns the weights of the last nodes.
    """
    reach = held.shape[1]
    for k in range(1, int(size.max(initial=0)) + 1):
        node = start[: np.searchsorted(-size, -k, "right")] + k
        edge, n = x.firsts[node], x.firsts[node + 1] - x.firsts[node]
        acc = np.full((len(node), held.shape[2]), -np.inf if logs else 0.0)
        for j in range(int(n.max(initial=0))):
            on = np.flatnonzero(n > j)
            e = edge[on] + j
            before = held[on, (k - (node[on] - x.src[e])) % reach]
            weight = weights[x.ids[e]][:, None]
            acc[on] = np.logaddexp(acc[on], before + weight) if logs else acc[on] + before * weight
        held[: len(node), k % reach] = acc
        if seen is not None:
            seen(node, acc[:, 0])
    return held


def _filter_blocks(p: Pieces, x: Lattice, words: np.ndarray) -> None:
    """Set total, as logarithms, for these words.  The weights of a block's last nodes are a linear map of those before it."""
    logs = p.scaled is None
    weights, zero = (p.scores, -np.inf) if logs else (p.scaled, 0.0)
    block = max(TOGETHER, 1)
    pieces = -(-x.length[words] // block)
    whose = np.repeat(words, pieces)
    nth = np.arange(len(whose)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
    start = x.base[whose] + nth * block
    size = np.minimum(block, x.base[whose] + x.length[whose] - start)
    ends = np.append(nth[1:] == 0, True)  # the last block of its word
    reach = int((np.repeat(np.arange(len(x.firsts) - 1), np.diff(x.firsts)) - x.src).max(initial=1))
    before, offset = np.full((len(whose), reach), zero), np.zeros(len(whose))
    first = np.full(reach, zero)
    first[0] = 0.0 if logs else 1.0
    for a in range(0, len(whose), BLOCKS):
        some = np.arange(a, min(a + BLOCKS, len(whose)))
        maps = some[~ends[some]]  # these have block bytes each
        unit = np.full((len(maps), reach, reach), zero)
        unit[:, (-np.arange(reach)) % reach, np.arange(reach)] = 0.0 if logs else 1.0
        moved = _advance(x, weights, start[maps], size[maps], unit, logs)[:, (block - np.arange(reach)) % reach] if len(maps) else unit
        at = 0
        for b in some:
            if nth[b] == 0:
                before[b] = first
            if ends[b]:
                continue
            with np.errstate(divide="ignore"):
                if logs:
                    after = np.logaddexp.reduce(moved[at] + before[b], axis=1)
                    top = after.max()
                    before[b + 1], offset[b + 1] = after - top, offset[b] + top
                else:
                    after = moved[at] @ before[b]
                    top = after.max()
                    before[b + 1], offset[b + 1] = after / top, offset[b] + np.log(top)
            at += 1
    order = np.argsort(-size, kind="stable")
    held = np.full((len(whose), reach, 1), zero)
    held[:, (-np.arange(reach)) % reach, 0] = before[order]
    shift = offset[order]

    def keep(node, weight):
        with np.errstate(divide="ignore"):
            x.total[node] = (weight if logs else np.log(weight)) + shift[: len(node)]

    x.total[x.base[words]] = 0.0
    _advance(x, weights, start[order], size[order], held, logs, keep)
    if not logs:  # the scale of a node's logarithm is that of its bytes
        nodes = x.length[words] + 1
        place = np.arange(nodes.sum()) - np.repeat(np.cumsum(nodes) - nodes, nodes)
        x.total[np.repeat(x.base[words], nodes) + place] -= place * p.log_scale


def _draw_long(p: Pieces, x: Lattice, word: np.ndarray, random: np.ndarray) -> list[np.ndarray]:
    """Pieces, last first, of the occurrences of long words: an edge is drawn for every node, then the way is followed from the end."""
    got = []
    for k in range(len(word)):
        lo, hi = int(x.base[word[k]]), int(x.base[word[k]] + x.length[word[k]])
        a, b = x.firsts[lo + 1], x.firsts[hi + 1]
        src, ids = x.src[a:b], x.ids[a:b]
        bounds = x.firsts[lo + 1 : hi + 2] - a
        nth = np.repeat(np.arange(hi - lo), np.diff(bounds))
        with np.errstate(invalid="ignore"):
            chance = np.exp(x.total[src] + p.scores[ids] - x.total[lo + 1 + nth])
        chance = np.nan_to_num(chance)
        sums = np.concatenate([[0.0], np.cumsum(chance)])
        goal = sums[bounds[:-1]] + _uniform(random[k], np.arange(1, hi - lo + 1)) * (sums[bounds[1:]] - sums[bounds[:-1]])
        edge = np.clip(np.searchsorted(sums[1:], goal, "right"), bounds[:-1], np.maximum(bounds[1:] - 1, bounds[:-1])).tolist()
        back, piece = (src - lo).tolist(), ids.tolist()
        v, way = hi - lo, []
        while v:
            e = edge[v - 1]
            way.append(piece[e])
            v = back[e]
        got.append(np.array(way, np.int64))
    return got


def _uniform(key: np.ndarray, place: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return (mix(key + (place.astype(np.uint64) + np.uint64(1)) * np.uint64(0xD1342543DE82EF95)) >> np.uint64(11)).astype(np.float64) * 2.0**-53


def sample(p: Pieces, data: np.ndarray, offsets: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Piece ids of the texts data[offsets[k]:offsets[k+1]] and their bounds; keys: a 64-bit number for each text."""
    n = np.diff(offsets)
    some = np.flatnonzero(n > 0)
    if not len(some):
        return np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    text = np.insert(data, offsets[:-1][some], 0x20)
    heads = offsets[:-1][some] + np.arange(len(some))
    space = text == 0x20
    cut = np.zeros(len(text), bool)
    cut[1:] = space[1:] & ~space[:-1]
    cut[heads] = True
    starts = np.flatnonzero(cut)
    ends = np.append(starts[1:], len(text))
    hashes = _hash(text, starts, ends)
    _, first, word = np.unique(hashes, return_index=True, return_inverse=True)
    size = (ends - starts)[first]
    bounds = np.concatenate([[0], np.cumsum(size)])
    flat = text[np.arange(bounds[-1]) + np.repeat(starts[first] - bounds[:-1], size)]
    x = _filtered(p, flat, bounds)

    owner = np.searchsorted(heads, starts, "right") - 1
    nth = np.arange(len(starts)) - np.searchsorted(starts, heads)[owner]
    with np.errstate(over="ignore"):
        random = mix(keys[some][owner] ^ mix(nth.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(1)))
    steps: list[tuple[np.ndarray, np.ndarray]] = []
    goal, end = x.base[word], (x.base + x.length)[word]
    small = x.length[word] <= TOGETHER
    occ = np.flatnonzero(small)

    def weight(e, node):
        return x.total[x.src[e]] * p.scaled[x.ids[e]] if p.scaled is not None else np.exp(x.total[x.src[e]] + p.scores[x.ids[e]] - x.total[node])

    node = end[occ]
    while len(occ):
        edge, last = x.firsts[node], x.firsts[node + 1] - 1
        left = _uniform(random[occ], node - goal[occ])
        left = (left * x.total[node] if p.scaled is not None else left) - weight(edge, node)
        on = np.flatnonzero((left >= 0) & (edge < last))
        while len(on):  # to the first edge whose cumulated weight exceeds the drawn one
            edge[on] += 1
            e = edge[on]
            left[on] -= weight(e, node[on])
            on = on[(left[on] >= 0) & (e < last[on])]
        steps.append((occ, x.ids[edge]))
        node = x.src[edge]
        open_ = node != goal[occ]
        occ, node = occ[open_], node[open_]
    far = np.flatnonzero(~small)
    ways = _draw_long(p, x, word[far], random[far])
    count = np.zeros(len(starts), np.int64)
    for o, _ in steps:
        count[o] += 1
    count[far] = [len(w) for w in ways]
    stop = np.cumsum(count)
    out = np.empty(int(stop[-1]), np.int64)
    for t, (o, i) in enumerate(steps):
        out[stop[o] - 1 - t] = i
    for o, way in zip(far, ways, strict=True):
        out[stop[o] - len(way) : stop[o]] = way[::-1]
    per_text = np.zeros(len(n), np.int64)
    per_text[some] = np.add.reduceat(count, np.searchsorted(starts, heads))
    return out, np.concatenate([[0], np.cumsum(per_text)])


def unpiece(p: Pieces, ids: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of the texts of these piece ids, and their bounds."""
    size = p.lengths[ids]
    at = np.concatenate([[0], np.cumsum(size)])
    data = p.blob[np.arange(at[-1]) + np.repeat(p.bounds[ids] - at[:-1], size)]
    cuts = at[bounds]
    some = cuts[1:] > cuts[:-1]
    keep = np.ones(len(data), bool)
    keep[cuts[:-1][some]] = False  # the space before the text
    return data[keep], cuts - np.concatenate([[0], np.cumsum(some)])


def encode(docs: DataFrame, model: str = MODEL, seed: int = 0, temperature: float = 1.0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text, n_pieces, pieces): one row for each row of docs, sampled by its id."""
    shared = docs.sparkSession.sparkContext.broadcast(load(model, temperature))  # as large as the vocabulary
    def run(batches):
        for batch in batches:
            for a, n, ids, bounds, _, _ in _sampled(shared.value, batch):
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(a, n), batch.column("text").slice(a, n), pa.array(np.diff(bounds)), _lists(ids, bounds)], ["doc_id", "text", "n_pieces", "pieces"])

    return _keyed(docs, seed, id_col, text_col).mapInArrow(run, "doc_id long, text string, n_pieces long, pieces array<int>")


def _keyed(docs: DataFrame, seed: int, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"), F.xxhash64(F.lit(seed), F.col(id_col).cast("long")).alias("key"))


def _sampled(p: Pieces, batch: pa.RecordBatch):
    """For each chunk of a batch: first row, rows, piece ids and their bounds, text bytes and their offsets."""
    keys = batch.column("key").to_numpy().view(np.uint64)
    for chunk in chunks(batch.column("text"), lower=False, size=TOGETHER_BYTES):
        ids, bounds = sample(p, chunk.raw, chunk.offsets, keys[chunk.first_row : chunk.first_row + chunk.rows])
        yield chunk.first_row, chunk.rows, ids, bounds, chunk.raw, chunk.offsets


def _lists(ids: np.ndarray, bounds: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(ids.astype(np.int32)))


def decode(rows: DataFrame, model: str = MODEL, pieces_col: str = "pieces", out: str = "decoded") -> DataFrame:
    """rows with the text of their pieces in a further column; null pieces decode like none, to the empty text."""
    shared = rows.sparkSession.sparkContext.broadcast(load(model))

    def run(batches):
        for batch in batches:
            lists = batch.column(pieces_col)
            if lists.null_count:
                lists = pa.array([x or [] for x in lists.to_pylist()], pa.list_(pa.int32()))
            offs = lists.offsets.to_numpy().astype(np.int64)
            ids = lists.values.to_numpy()[offs[0] : offs[-1]]
            data, bounds = unpiece(shared.value, ids, offs - offs[0])
            text = pa.Array.from_buffers(pa.large_string(), len(lists), [None, pa.py_buffer(bounds.astype(np.int64)), pa.py_buffer(data)])
            yield pa.RecordBatch.from_arrays([*batch.columns, text.cast(pa.string())], [*batch.schema.names, out])

    return rows.mapInArrow(run, T.StructType([*rows.schema.fields, T.StructField(out, T.StringType())]))


def round_trip(docs: DataFrame, model: str = MODEL, seed: int = 0, temperature: float = 1.0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_pieces, pieces, lossless): encoded, decoded from the ids again and compared with the text, in one pass."""
    shared = docs.sparkSession.sparkContext.broadcast(load(model, temperature))

    def run(batches):
        for batch in batches:
            for a, n, ids, bounds, raw, offsets in _sampled(shared.value, batch):
                data, cuts = unpiece(shared.value, ids.astype(np.int32).astype(np.int64), bounds)
                if len(data) == len(raw) and (cuts == offsets).all():
                    wrong = np.bincount(np.searchsorted(offsets, np.flatnonzero(data != raw), "right") - 1, minlength=n)[:n]
                else:
                    wrong = np.array([data[cuts[k] : cuts[k + 1]].tobytes() != raw[offsets[k] : offsets[k + 1]].tobytes() for k in range(n)])
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(a, n), pa.array(np.diff(bounds)), _lists(ids, bounds), pa.array(wrong == 0)], ["doc_id", "n_pieces", "pieces", "lossless"])

    return _keyed(docs, seed, id_col, text_col).mapInArrow(run, "doc_id long, n_pieces long, pieces array<int>, lossless boolean")
