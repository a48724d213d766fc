"""Secret scan: three base patterns, and password guess costs in credential contexts.

A value in a credential context (a key word, a separator, the value; or the password of a URL) is cut into words, dates, repeats, keyboard walks and
brute-force spans so that the product of their guesses, times 4 for each part, is least.  The minimum is found by dynamic programming over
positions and is exact over all segmentations; any stretch of a repeat or a walk may be a part, and costs what its whole run costs.  Values that need at
least 10**min_log_guesses guesses are reported as `guess` spans beside the base ones; the cost tells random secrets from ordinary words and from place
holders such as "changeme2024".  Words are ranked by a fixed list of password words, then by the words of a public vocabulary, whose path is a parameter.
After a bare "is" only a value with a letter and a digit counts.

Spans are code points, end exclusive.  A base span is the whole match, a `guess` span the value.  Base matches are leftmost and non-overlapping per
kind, and those that fail their length are dropped after matching.  Rows: a null text counts as empty; an empty text has no span.  Equal
rows give equal results.  The cost is linear in the text; a value of any length is read whole, up to its
closing quote on the line if it opens with one, else up to a space, quote, comma, semicolon, < or >.  Other columns are ignored.
"""

from __future__ import annotations

import hashlib
import json
import math
import re
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame

from siltstone.llm.shared import keyed_text

KINDS = ("assign", "access", "hex", "guess")
ASSIGN = re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{32,}")  # runs are maximal, so this is the run pattern with its length test
CONTEXT = re.compile(
    r"""(?i:pass(?:word|wd|phrase|code)?|pwd|secret|token|(?:api|access|private|client)[_-]?(?:key|secret)|credentials?|bearer|login)["']?[\x20\t]{0,8}(?:[:=]|(\bis\b))[\x20\t]{0,8}(?:"((?:[^"\\\n]|\\[^\n]){6,}+)"|'((?:[^'\\\n]|\\[^\n]){6,}+)'|["']?([^\s"'<>,;]{6,}))|://[^\s/:@]+:([^\s/@"'<>]{6,})@""",
    re.ASCII,
)
#: A text without any of these, in lower case, has no assign or context match.
_HINTS = ("pass", "pwd", "secret", "token", "key", "credential", "bearer", "login", "://")

# Frequent words of passwords in order of frequency, and rows of keys.
WORDS = "password admin welcome login letmein secret changeme master dragon monkey shadow sunshine princess football baseball superman batman trustno hello freedom whatever qazwsx ninja mustang access flower starwars computer michelle jordan hunter soccer killer pepper ginger summer winter spring autumn orange banana cookie cheese coffee test user guest root default example sample dummy token pass key love money london berlin paris madrid server public private company".split()
KEY_ROWS = ("1234567890", "qwertyuiop", "asdfghjkl", "zxcvbnm", "abcdefghijklmnopqrstuvwxyz")

#: log10 of the guesses that each part costs for being one more.
PART = math.log10(4)

#: The vocabulary whose words are ranked behind the fixed ones, and the longest unit of a repeat.
VOCABULARY = "/opt/tokenizers/word_bpe_49k.json"
LONGEST_UNIT = 12

_LEET = str.maketrans("013457$@!", "oleastsai")
_NEXT = {(r[k], r[k + d]) for r in KEY_ROWS for d in (1, -1) for k in range(len(r)) if 0 <= k + d < len(r)}
_DATE = re.compile(r"(?:19|20)\d\d(?:[-/.]?(?:0[1-9]|1[0-2])(?:[-/.]?(?:0[1-9]|[12]\d|3[01]))?)?|(?:0[1-9]|[12]\d|3[01])[-/.]?(?:0[1-9]|1[0-2])[-/.]?(?:19|20)?\d\d", re.ASCII)


@dataclass(frozen=True)
class Words:
    """The rank of each known word, from 1."""

    rank: dict[str, int]
    longest: int


def words(vocabulary: str | None = VOCABULARY) -> Words:
    """The fixed words and, behind them, the vocabulary's whole words of three ASCII letters or more, in its order; its size bounds what is broadcast."""
    known = dict.fromkeys(WORDS)
    if vocabulary:
        with open(vocabulary, encoding="utf-8") as f:
            ids = json.load(f)["model"]["vocab"]
        whole = (w.removesuffix("</w>") for w in sorted(ids, key=ids.get) if w.endswith("</w>"))
        known.update(dict.fromkeys(w for w in whole if len(w) >= 3 and w.isascii() and w.isalpha()))
    return Words({w: k + 1 for k, w in enumerate(known)}, max(map(len, known)))


def _class(c: str) -> int:
    return 10 if c.isdigit() else 26 if c.isalpha() else 33


def _spans(value: str, known: Words):
    """(start, end, log10 guesses) of every word and date."""
    low = value.lower()
    plain = low.translate(_LEET)
    n = len(value)
    for s in range(n):
        for e in range(s + 3, min(n, s + known.longest) + 1):
            word = low[s:e]
            rank = known.rank.get(word)
            if rank is None and (rank := known.rank.get(plain[s:e])) is not None:
                rank *= 4
            if rank is not None:
                yield s, e, math.log10(rank * (1 if value[s:e] == word else 2) + 1)
        if m := _DATE.match(value, s):
            yield s, m.end(), math.log10(365 * 130 if m.end() - s > 4 else 130)


def _runs(value: str):
    """(start, end, least length of a part, log10 guesses) of the maximal repeats of units up to LONGEST_UNIT characters and keyboard walks."""
    low = value.lower()
    n = len(low)
    for unit in range(1, LONGEST_UNIT + 1):
        s = 0
        for k in range(unit, n + 1):
            if k == n or low[k] != low[k - unit]:
                if k - s >= max(2 * unit, 3):
                    yield s, k, max(2 * unit, 3), unit * 1.2 + math.log10((k - s) // unit)
                s = k - unit + 1
    s = 0
    for k in range(1, n + 1):
        if k == n or (low[k - 1], low[k]) not in _NEXT:
            if k - s >= 3:
                yield s, k, 3, 1.6 + math.log10(k - s)
            s = k


def log10_guesses(value: str, known: Words) -> float:
    """Least log10 of guesses over all segmentations.  A run of brute-force characters is one part."""
    n = len(value)
    ends: dict[int, list[tuple[int, float]]] = {}
    for s, e, cost in _spans(value, known):
        ends.setdefault(e, []).append((s, cost))
    opens: dict[int, list[list]] = {}
    for s, e, least, cost in _runs(value):
        opens.setdefault(s + least, []).append([e, least, cost, math.inf])
    # least cost up to k with the last part a match, or a run of brute-force characters; and of either
    match, brute, best = [math.inf] * (n + 1), [math.inf] * (n + 1), [math.inf] * (n + 1)
    match[0] = best[0] = 0.0
    active: list[list] = []
    for k in range(1, n + 1):
        brute[k] = math.log10(_class(value[k - 1])) + min(match[k - 1] + PART, brute[k - 1])
        match[k] = min((best[s] + cost + PART for s, cost in ends.get(k, ())), default=math.inf)
        active = [r for r in active if r[0] >= k] + opens.get(k, [])
        for run in active:  # its last item: the least cost before any part of it that ends at k
            run[3] = min(run[3], best[k - run[1]])
            match[k] = min(match[k], run[3] + run[2] + PART)
        best[k] = min(match[k], brute[k])
    return best[n]


def spans(text: str, known: Words, min_log_guesses: float = 10.0) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
    """(start, kind number, end) of the base spans and of the added ones, each sorted."""
    base, more = [], []
    low = text.lower()
    hints = any(h in low for h in _HINTS)
    if hints:
        base += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 8]
        at = done = 0
        while m := CONTEXT.search(text, at):
            g = m.lastindex
            # a quoted value may hold a context whose value goes on behind it
            at = m.start(g) if g <= 3 else m.end()
            if m[1] and not (any(c.isdigit() for c in m[g]) and any(c.isalpha() for c in m[g])):
                continue
            if m.end(g) > done and log10_guesses(m[g], known) >= min_log_guesses:
                more.append((m.start(g), 3, m.end(g)))
                done = m.end(g)
    if "AKIA" in text:
        base += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 16]
    base += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(base), sorted(more)


def joined(found: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in found)


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_log_guesses: float = 10.0, vocabulary: str | None = VOCABULARY) -> DataFrame:
    """(doc_id, n_assign, n_access, n_hex, n_guess, base_sha256, spans): one row for each row of docs."""
    shared = docs.sparkSession.sparkContext.broadcast(words(vocabulary))

    def run(batches):
        known = shared.value
        for batch in batches:
            rows = []
            for text in batch.column("text").to_pylist():
                base, more = spans(text, known, min_log_guesses)
                counts = [sum(k == kind for _, k, _ in base) for kind in range(3)]
                rows.append((*counts, len(more), hashlib.sha256(joined(base).encode()).hexdigest(), joined(sorted(base + more))))
            columns = list(zip(*rows, strict=True)) or [[]] * 6
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(c, pa.int64()) for c in columns[:4]), *(pa.array(c, pa.string()) for c in columns[4:])], ["doc_id", "n_assign", "n_access", "n_hex", "n_guess", "base_sha256", "spans"])

    return keyed_text(docs, id_col, text_col).mapInArrow(run, "doc_id long, n_assign long, n_access long, n_hex long, n_guess long, base_sha256 string, spans string")
