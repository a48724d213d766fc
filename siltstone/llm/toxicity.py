"""Toxicity by a classifier chain.

Logistic models over hashed words and word beginnings predict the categories one after the other; each model also gets the logits of the
categories before it.  In training those are out-of-fold predictions, by models whose features were chosen and whose weights were fitted without the
fold, so a later model sees them as unsure as they will be on new texts.  A feature is a word, or the first 4 to 8 bytes of a longer one, that a text
has once, twice or four times at least.

The labels name one category, `toxic`.  Two kinds of toxic text come before it in the chain: the toxic rows of the sample fall into
KINDS clusters by their features (spherical k-means), and kind k is "toxic and of cluster k".  With more label columns (`categories`) those are the chain instead.

The models are fitted on at most MAX_TRAIN labelled documents (those of the smallest hash of doc_id), each model in a task of its own that gets the
feature lists of the sample; the driver gets the chosen features and the weights only.  All rows are scored.

Rows: a null or empty text has no feature and is never toxic.  Several labels of one doc_id count as their maximum, null labels not at all; of several texts
with one doc_id the least is taken for the sample.  Equal rows get equal scores.  A feature is kept that is in LEAST_ROWS labelled rows and whose |z|
reaches LEAST_Z or, on a small table, half of sqrt(labelled rows), the largest |z| there can be.  Without a toxic and a clean labelled row, every probability is 0.
Other columns stay as they are.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltstone.llm.bytewords import Chunk, chunks, mix, table_of, trim
from siltstone.llm.shared import cut, keyed_text

#: Documented bounds of the labelled sample and of each model's features.
MAX_TRAIN = 40_000
MAX_FEATURES = 4096
BITS, FOLDS, PREFIXES, TIMES, LEAST_Z, LEAST_ROWS, KINDS = 20, 5, (4, 5, 6, 7, 8), (1, 2, 4), 3.5, 3, 2

#: Counts that a task gathers before it adds them up.
SETTLE = 1 << 20

_OUTER = table_of(b".,;:!?\"'()[]{}<>*_`#$%&|~-+=/\\")


def _features(chunk: Chunk) -> tuple[np.ndarray, np.ndarray]:
    """(row, hash) of every word and word beginning, with repetitions."""
    starts, ends, bounds = chunk.split()
    s, e = trim(chunk, starts, ends, _OUTER)
    row = np.repeat(np.arange(chunk.rows), np.diff(bounds))
    rows, feats = [row], [chunk.hashes(s, e)]
    for n in PREFIXES:
        long = e - s > n
        rows.append(row[long])
        feats.append(mix(chunk.hashes(s[long], s[long] + n) ^ np.uint64(n)))
    return np.concatenate(rows), (np.concatenate(feats) >> np.uint64(64 - BITS)).astype(np.int64)


def _leveled(rows: np.ndarray, feats: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, feature * len(TIMES) + level) for every level of TIMES that a row's count of a feature reaches, sorted."""
    both, count = np.unique(rows << bits | feats, return_counts=True)
    reached = [both[count >= t] for t in TIMES]
    rows = np.concatenate([b >> bits for b in reached])
    feats = np.concatenate([(b & ((1 << bits) - 1)) * len(TIMES) + k for k, b in enumerate(reached)])
    order = np.lexsort((feats, rows))
    return rows[order], feats[order]


@dataclass
class Chain:
    """places: of each hashed feature among the weights, or -1.  weights[k]: of category k by place and level, with those of the logits before it last."""

    categories: tuple[str, ...]
    places: np.ndarray
    weights: list[np.ndarray]
    bias: list[float]

    def logits(self, rows: np.ndarray, feats: np.ndarray, n: int) -> np.ndarray:
        at = self.places[feats]
        keep = at >= 0
        m = (int(self.places.max(initial=-1)) + 1) * len(TIMES)
        rows, at = _leveled(rows[keep], at[keep].astype(np.int64), BITS)
        out = np.zeros((n, len(self.weights)))
        for k, w in enumerate(self.weights):
            out[:, k] = self.bias[k] + np.bincount(rows, w[at], n) + _squash(out[:, :k]) @ w[m:]
        return out


def _squash(logits: np.ndarray) -> np.ndarray:
    return np.clip(logits, -6, 6)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def _sums(groups: np.ndarray, size: int):
    """A function that sums values by their sorted groups; several times faster than bincount."""
    starts = np.flatnonzero(np.diff(groups, prepend=-1))
    held = groups[starts]

    def of(values: np.ndarray) -> np.ndarray:
        out = np.zeros(size)
        if len(starts):
            out[held] = np.add.reduceat(values, starts)
        return out

    return of


def logistic(rows, cols, extra, y, m, rounds=150, ridge=1e-4, rate=0.3):
    """Full-batch Adam on the mean log loss; deterministic.  rows are sorted.  Without both classes only the bias is learned."""
    w, bias = np.zeros(m + extra.shape[1]), float(np.log((y.sum() + 0.5) / (len(y) - y.sum() + 0.5)))
    if not 0 < y.sum() < len(y):
        return w, bias
    order = np.argsort(cols, kind="stable")
    by_col, by_row, at = _sums(cols[order], m), _sums(rows, len(y)), rows[order]
    m1, m2, b1, b2, n = np.zeros(len(w) + 1), np.zeros(len(w) + 1), 0.9, 0.999, len(y)
    for t in range(1, rounds + 1):
        p = _sigmoid(bias + by_row(w[cols]) + extra @ w[m:])
        g = (p - y) / n
        grad = np.concatenate([by_col(g[at]) + ridge * w[:m], extra.T @ g + ridge * w[m:], [g.sum()]])
        m1, m2 = b1 * m1 + (1 - b1) * grad, b2 * m2 + (1 - b2) * grad**2
        step = rate / (1 + t / 50) * (m1 / (1 - b1**t)) / (np.sqrt(m2 / (1 - b2**t)) + 1e-8)
        w, bias = w - step[:-1], bias - step[-1]
    return w, float(bias)


def clusters(rows: np.ndarray, cols: np.ndarray, n: int, m: int, k: int) -> np.ndarray:
    """Spherical k-means of n binary rows, from rows far apart; deterministic.  The largest cluster is 0."""
    length = np.sqrt(np.maximum(np.bincount(rows, minlength=n), 1))
    value = 1 / length[rows]

    def likeness(center: np.ndarray) -> np.ndarray:
        return np.bincount(rows, center[cols] * value, n)

    def center(member: np.ndarray) -> np.ndarray:
        out = np.bincount(cols, member[rows] * value, m)
        return out / max(np.sqrt((out**2).sum()), 1e-12)

    near = np.argsort(-likeness(center(np.ones(n))), kind="stable")[:1]
    chosen = [center(np.arange(n) == near[0])]
    while len(chosen) < k:
        chosen.append(center(np.arange(n) == np.argmin(np.max([likeness(c) for c in chosen], axis=0))))
    of = np.zeros(n, np.int64)
    for _ in range(30):
        now = np.argmax([likeness(c) for c in chosen], axis=0)
        if (now == of).all() and _:
            break
        of, chosen = now, [center(now == j) for j in range(k)]
    return np.argsort(np.argsort(-np.bincount(of, minlength=k), kind="stable"), kind="stable")[of]


def _lists(column: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    lists = column.combine_chunks()
    lists = pa.concat_arrays(lists.chunks) if isinstance(lists, pa.ChunkedArray) else lists
    return np.repeat(np.arange(len(lists)), np.diff(lists.offsets.to_numpy())), lists.flatten().to_numpy().astype(np.int64)


def _sample(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, categories: tuple[str, ...], max_train: int) -> DataFrame:
    """(id, fold, text, y: array of 0/1 a category) of at most max_train documents, one row each."""
    marks = F.array(*[F.max(F.col(c).cast("int")) for c in categories])
    ids = labels.where(F.col(id_col).isNotNull()).groupBy(F.col(id_col).cast("long").alias("id")).agg(marks.alias("y")).where(~F.array_contains(F.transform("y", lambda x: x.isNull()), True))
    ids = ids.orderBy(F.xxhash64("id"), "id").limit(max_train)
    found = keyed_text(docs, id_col, text_col).join(F.broadcast(ids), F.col("doc_id") == F.col("id"))  # at most max_train rows of some bytes
    fold = F.pmod(F.xxhash64("id", F.lit("fold")), F.lit(FOLDS)).cast("int")
    return found.groupBy("id").agg(F.min("text").alias("text"), F.first("y").alias("y")).select("id", fold.alias("fold"), "text", "y")


def _counts(sample: DataFrame) -> DataFrame:
    """(f, slot, n): rows with feature f, by slot = 2 * fold + whether the last category holds."""
    slots = 2 * FOLDS

    def run(batches):
        held, size = [], 0

        def settle():
            codes, n = np.unique(np.concatenate([c for c, _ in held]), return_inverse=True)
            return codes, np.bincount(n, np.concatenate([x for _, x in held]), len(codes)).astype(np.int64)

        for batch in batches:
            fold, y = batch.column("fold").to_numpy(), batch.column("label").to_numpy()
            for chunk in chunks(batch.column("text")):
                slot = (2 * fold + y)[chunk.first_row : chunk.first_row + chunk.rows].astype(np.int64)
                r, f = _leveled(*_features(chunk), BITS)
                held.append(np.unique(f * slots + slot[r], return_counts=True))
                size += len(held[-1][0])
                if size > SETTLE:
                    held = [settle()]
                    size = len(held[0][0])
                    if size > SETTLE // 2:
                        yield batch_of(held.pop())
                        size = 0
        if held:
            yield batch_of(settle())

    def batch_of(got):
        return pa.RecordBatch.from_arrays([pa.array(got[0] // slots), pa.array((got[0] % slots).astype(np.int32)), pa.array(got[1].astype(np.int64))], ["f", "slot", "n"])

    return sample.select("text", "fold", F.element_at("y", -1).alias("label")).mapInArrow(run, "f long, slot int, n long")


def _chosen(sample: DataFrame) -> list[np.ndarray] | None:
    """The features of each model: those without fold 0, 1, .., and those of all rows; None if a class is missing.  At most FOLDS + 1 times MAX_FEATURES numbers."""
    rows = sample.groupBy("fold", F.element_at("y", -1).alias("label")).count().collect()  # at most 2 * FOLDS
    size = np.zeros((2, FOLDS), np.int64)
    for r in rows:
        size[r["label"], r["fold"]] = r["count"]
    if not size.sum(1).all():
        return None
    part = lambda label, fold: F.sum(F.when(F.col("slot") == 2 * fold + label, F.col("n")).otherwise(0))
    table = _counts(sample).groupBy("f").agg(*[part(label, k).alias(f"n{label}_{k}") for label in (0, 1) for k in range(FOLDS)])
    scores = []
    for s in range(FOLDS + 1):
        n0, n1 = (float(size[label].sum() - (size[label, s] if s < FOLDS else 0)) for label in (0, 1))
        if not n0 or not n1:
            scores.append(F.lit(0.0))
            continue
        a, b = (sum((F.col(f"n{label}_{k}") for k in range(FOLDS) if k != s), F.lit(0.0)) for label in (0, 1))
        p = (a + b) / (n0 + n1)
        z = F.abs(b / n1 - a / n0) / F.sqrt(p * (1 - p) * (1 / n0 + 1 / n1) + 1e-12)
        scores.append(F.when((a + b >= LEAST_ROWS) & (z >= min(LEAST_Z, float(np.sqrt(n0 + n1)) / 2)), z).otherwise(0.0))
    table = cut(table.select("f", *[z.alias(f"z{s}") for s, z in enumerate(scores)]).where(F.greatest(*[F.col(f"z{s}") for s in range(FOLDS + 1)]) > 0))
    best = [table.where(F.col(f"z{s}") > 0).orderBy(F.desc(f"z{s}"), "f").limit(MAX_FEATURES).select(F.lit(s).alias("s"), "f") for s in range(FOLDS + 1)]
    got = best[0]
    for b in best[1:]:
        got = got.unionByName(b)
    pairs = got.collect()
    return [np.sort(np.array([r["f"] for r in pairs if r["s"] == s], np.int64)) for s in range(FOLDS + 1)]


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", max_train: int = MAX_TRAIN, categories: tuple[str, ...] = (), kinds: int = KINDS, rounds: int = 150) -> Chain:
    """The chain for `categories`, label columns in their order, the last of them the one that features are chosen for; without, for kinds of label_col and label_col."""
    sample = cut(_sample(docs, labels, id_col, text_col, categories or (label_col,), max_train))
    names = categories or (*(f"kind_{k + 1}" for k in range(kinds)), label_col)
    chosen = _chosen(sample)
    if chosen is None or not len(chosen[-1]):
        return Chain(names, np.full(1 << BITS, -1, np.int32), [np.zeros(k) for k in range(len(names))], [-40.0] * len(names))
    known = np.unique(np.concatenate(chosen))
    m = len(known)
    allowed = [np.isin(known, c) for c in chosen]
    bases = np.unique(known // len(TIMES))
    places = np.full(1 << BITS, -1, np.int32)
    places[bases] = np.arange(len(bases))
    column = np.full(len(bases) * len(TIMES), -1, np.int64)  # of place and level, among known
    column[places[known // len(TIMES)] * len(TIMES) + known % len(TIMES)] = np.arange(m)
    shared = docs.sparkSession.sparkContext.broadcast((places, column, allowed))

    def reduce(batches):
        places, column, _ = shared.value
        for batch in batches:
            for chunk in chunks(batch.column("text")):
                r, f = _features(chunk)
                at = places[f]
                r, at = _leveled(r[at >= 0], at[at >= 0].astype(np.int64), BITS)
                c = column[at]
                r, c = r[c >= 0], c[c >= 0]
                bounds = np.searchsorted(r, np.arange(chunk.rows + 1))
                yield pa.RecordBatch.from_arrays([*(batch.column(x).slice(chunk.first_row, chunk.rows) for x in ("id", "fold", "y")), pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(c.astype(np.int32)))], ["id", "fold", "y", "f"])

    rows = cut(sample.select("text", "id", "fold", "y").mapInArrow(reduce, "id long, fold int, y array<int>, f array<int>"))
    if not categories:
        rows = cut(_with_kinds(rows, m, kinds, shared))
    logits = None
    weights, bias = [], []
    for k in range(len(names)):
        target = F.get("y", F.lit(k)).alias("target")
        state = rows.select("id", "fold", target, "f") if logits is None else rows.join(logits, "id").select("id", "fold", target, "f", "before")
        got = cut(_trained(state if logits is not None else state.withColumn("before", F.array().cast("array<double>")), m, rounds, shared))
        w = np.array(got.where("w IS NOT NULL").first()["w"])
        full = np.zeros(len(column))
        full[column >= 0] = w[column[column >= 0]]
        weights.append(np.concatenate([full, w[m:-1]]))
        bias.append(float(w[-1]))
        logits = got.where("w IS NULL").select("id", "before")
    return Chain(names, places, weights, bias)


def _with_kinds(rows: DataFrame, m: int, kinds: int, shared) -> DataFrame:
    """y becomes whether the row is toxic and of kind 1, 2, .., and toxic.  One group: the toxic rows of the sample, at most its documented bound."""

    def split(table):
        table = table.sort_by("id")
        r, c = _lists(table.column("f"))
        keep = shared.value[2][-1][c]
        return pa.table({"id": table.column("id"), "kind": pa.array(clusters(r[keep], c[keep], len(table), m, kinds).astype(np.int32))})

    found = rows.where(F.get("y", F.lit(0)) == 1).select("id", "f", F.lit(0).alias("all")).groupBy("all").applyInArrow(split, "id long, kind int")
    y = F.array(*[F.coalesce((F.col("kind") == k).cast("int"), F.lit(0)) for k in range(kinds)], F.get("y", F.lit(0)))
    return rows.join(found, "id", "left").select("id", "fold", y.alias("y"), "f")


def _trained(state: DataFrame, m: int, rounds: int, shared) -> DataFrame:
    """(id, before, w): each row's earlier logits and its out-of-fold one, and one row with the weights and bias of the model of all rows.

    Model s trains without fold s, the last on all rows; each group is the sample, whose size has a documented bound.
    """

    def train(key, table):
        s = key[0].as_py()
        table = table.sort_by("id")
        r, c = _lists(table.column("f"))
        fold, y = table.column("fold").to_numpy(), table.column("target").to_numpy().astype(float)
        before = np.array(table.column("before").to_pylist(), float).reshape(len(table), -1)
        held, usable = fold == s, shared.value[2][s][c]
        r, c = r[usable], c[usable]
        place, inside = np.cumsum(~held) - 1, ~held[r]
        w, bias = logistic(place[r[inside]], c[inside], before[~held], y[~held], m, rounds)
        if s == FOLDS:
            return pa.table({"id": pa.array([None], pa.int64()), "before": pa.array([None], pa.list_(pa.float64())), "w": pa.array([np.append(w, bias)], pa.list_(pa.float64()))})
        out = _squash(bias + np.bincount(r, w[c], len(table)) + before @ w[m:])
        now = np.column_stack([before, out])[held]
        return pa.table({"id": pa.array(table.column("id").to_numpy()[held]), "before": pa.array(list(now), pa.list_(pa.float64())), "w": pa.nulls(int(held.sum()), pa.list_(pa.float64()))})

    models = F.explode(F.sequence(F.lit(0), F.lit(FOLDS)))
    return state.withColumn("model", models).groupBy("model").applyInArrow(train, "id long, before array<double>, w array<double>")


def _scorer(chain: Chain, spark):
    shared, width = spark.sparkContext.broadcast(chain), len(chain.categories)  # 4 MB and the weights

    def score(texts: pa.Array) -> np.ndarray:
        out = np.zeros((len(texts), width))
        for chunk in chunks(texts):
            r, f = _features(chunk)
            out[chunk.first_row : chunk.first_row + chunk.rows] = _sigmoid(shared.value.logits(r, f, chunk.rows))
        return out

    return score


def score(docs: DataFrame, chain: Chain, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.5) -> DataFrame:
    """(doc_id, p_<category> for each, toxic): one row for each row of docs; toxic by the last category."""
    scorer, names = _scorer(chain, docs.sparkSession), [f"p_{c}" for c in chain.categories]

    def run(batches):
        for batch in batches:
            p = scorer(batch.column("text"))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(p[:, k]) for k in range(p.shape[1])), pa.array((p[:, -1] >= threshold).astype(np.int32))], ["doc_id", *names, "toxic"])

    return keyed_text(docs, id_col, text_col).mapInArrow(run, "doc_id long, " + ", ".join(f"`{c}` double" for c in names) + ", toxic int")


def keep_clean(docs: DataFrame, chain: Chain, text_col: str = "text", threshold: float = 0.5) -> DataFrame:
    """The rows of docs, with all their columns, whose text is not toxic."""
    scorer = _scorer(chain, docs.sparkSession)

    def run(batches):
        for batch in batches:
            texts = batch.column(text_col).cast(pa.string())
            yield batch.filter(pa.array(scorer(texts)[:, -1] < threshold))

    return docs.mapInArrow(run, docs.schema)
