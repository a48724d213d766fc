"""Words of whole Arrow batches as numpy arrays: no Python object is made for a word or a shingle.

A piece of text [s, e) has the polynomial hash  sum(T[byte] * R**i) / R**s  (mod 2**64), which prefix sums give
for any number of pieces at once.  R is odd, so its powers have inverses.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa

CHUNK_BYTES = 1 << 21
_ROOT = 0x9E3779B97F4A7C15 | 1
_TABLE = np.random.default_rng(20240517).integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


@lru_cache(maxsize=3)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    inverse = pow(_ROOT, -1, 1 << 64)
    up, down = np.full(n + 1, _ROOT, np.uint64), np.full(n + 1, inverse, np.uint64)
    up[0] = down[0] = 1
    with np.errstate(over="ignore"):
        return np.cumprod(up), np.cumprod(down)


class Chunk:
    """Some whole texts: bytes, byte offsets of the texts, and lazily their words and hashes."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, first_row: int, lower: bool = True):
        self.raw, self.offsets, self.first_row = data, offsets, first_row
        self.data = _LOWER[data] if lower else data
        self._sums: np.ndarray | None = None

    @property
    def rows(self) -> int:
        return len(self.offsets) - 1

    def split(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Start and end byte of every word, and the bounds of each text's words among them."""
        n = len(self.data)
        if not n:
            return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(self.rows + 1, np.int64)
        ink = ~_SPACE[self.data]
        edge = np.zeros(n + 1, bool)
        edge[self.offsets] = True
        before = np.empty(n, bool)
        before[0], before[1:] = False, ink[:-1]
        starts = np.flatnonzero(ink & (~before | edge[:-1]))
        after = np.empty(n, bool)
        after[-1], after[:-1] = False, ink[1:]
        ends = np.flatnonzero(ink & (~after | edge[1:])) + 1
        return starts, ends, np.searchsorted(starts, self.offsets)

    def hashes(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        if self._sums is None:
            up, _ = _powers(max(CHUNK_BYTES, 1 << max(0, len(self.data) - 1).bit_length()))
            self._sums = np.zeros(len(self.data) + 1, np.uint64)
            with np.errstate(over="ignore"):
                np.cumsum(_TABLE[self.data] * up[: len(self.data)], out=self._sums[1:])
        _, down = _powers(max(CHUNK_BYTES, 1 << max(0, len(self.data) - 1).bit_length()))
        with np.errstate(over="ignore"):
            return mix((self._sums[ends] - self._sums[starts]) * down[starts])


def chunks(texts: pa.Array | pa.ChunkedArray, lower: bool = True, size: int = CHUNK_BYTES) -> Iterator[Chunk]:
    """Cut a column of strings into chunks of whole texts of about size bytes; a longer text is a chunk of its own."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if isinstance(texts, pa.ChunkedArray):
        texts = pa.concat_arrays(texts.chunks)
    texts = texts.fill_null("") if texts.null_count else texts
    if not len(texts):
        return
    wide = pa.types.is_large_string(texts.type)
    _, where, what = texts.buffers()
    offsets = np.frombuffer(where, np.int64 if wide else np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    data = np.frombuffer(what, np.uint8) if what is not None else np.zeros(0, np.uint8)
    row = 0
    while row < len(texts):
        stop = max(row + 1, int(np.searchsorted(offsets, offsets[row] + size, "right")) - 1)
        stop = min(stop, len(texts))
        yield Chunk(data[offsets[row] : offsets[stop]], offsets[row : stop + 1] - offsets[row], row, lower)
        row = stop


def runs(values: np.ndarray, bounds: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """One order-dependent hash for every run of width values inside each part bounds[k]:bounds[k+1]; and the parts' bounds among them."""
    count = np.maximum(np.diff(bounds) - width + 1, 0)
    out_bounds = np.concatenate([[0], np.cumsum(count)])
    total = int(out_bounds[-1])
    if not total:
        return np.zeros(0, np.uint64), out_bounds
    at = np.arange(total) + np.repeat(bounds[:-1] - out_bounds[:-1], count)
    with np.errstate(over="ignore"):
        acc = np.zeros(total, np.uint64)
        for k in range(width):
            acc = acc * np.uint64(0xD6E8FEB86659FD93) + values[at + k]
    return mix(acc), out_bounds


def sequence_hashes(values: np.ndarray, bounds: np.ndarray, salt: int) -> np.ndarray:
    """One order-dependent hash for each whole part."""
    n = np.diff(bounds)
    up, _ = _powers(max(CHUNK_BYTES, 1 << max(0, int(n.max(initial=0)) - 1).bit_length()))
    place = np.arange(len(values)) - np.repeat(bounds[:-1], n)
    with np.errstate(over="ignore"):
        terms = np.concatenate([[np.uint64(0)], np.cumsum(mix(values ^ np.uint64(salt)) * up[place])])
        return mix(terms[bounds[1:]] - terms[bounds[:-1]] + n.astype(np.uint64) * np.uint64(0xA24BAED4963EE407))


def table_of(characters: bytes) -> np.ndarray:
    out = np.zeros(256, bool)
    out[list(characters)] = True
    return out


def trim(chunk: Chunk, starts: np.ndarray, ends: np.ndarray, outer: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The words without leading and trailing bytes of outer; a word of nothing else stays whole."""
    s, e, last = starts.copy(), ends.copy(), max(len(chunk.data) - 1, 0)
    while len(s) and (lead := (s < e) & outer[chunk.data[np.minimum(s, last)]]).any():
        s += lead
    while len(s) and (tail := (e > s) & outer[chunk.data[np.maximum(e - 1, 0)]]).any():
        e -= tail
    bare = s == e
    return np.where(bare, starts, s), np.where(bare, ends, e)
