"""Quality scores: logistic regression on hashed word n-grams, trained by FTRL-proximal updates."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.llm import wordvec as wv
from lectern.llm.common import small_batches, unpack

BITS = 20
#: What a text's mean n-gram weight is multiplied with before the logistic function.
GAIN = 30.0
#: The feature of two equal neighbours.
SAME = 1


def _tokens(data: np.ndarray, off: np.ndarray) -> wv.Words:
    """Runs of letters and digits, and runs of other visible characters, case kept."""
    kind = _KIND[data]
    n = len(kind)
    before = np.empty(n, np.uint8)
    if n:
        before[0] = 0
        before[1:] = kind[:-1]
        breaks = off[1:-1]
        before[breaks[breaks < n]] = 0
    start = np.flatnonzero((kind != 0) & (kind != before))
    if not len(start):
        z = np.zeros(0, np.int64)
        return wv.Words(np.zeros(0, np.uint64), z, z, np.zeros(len(off), np.int64), data)
    low = start[0]
    place = np.arange(low, n) - np.repeat(start, np.diff(np.append(start, n)))
    value = np.where(kind[low:] != 0, wv._BYTE[data[low:]], np.uint64(0))
    h = wv.mix(np.add.reduceat(value * wv._PLACE[place & (wv._LONG - 1)], start - low))
    return wv.Words(h, start, start, np.searchsorted(start, off), data)


_KIND = np.asarray([0 if b == 32 or 9 <= b <= 13 else 1 if b >= 128 or chr(b).isalnum() else 2 for b in range(256)], np.uint8)


def features(data: np.ndarray, off: np.ndarray, orders: tuple[int, ...] = (1, 2)) -> tuple[np.ndarray, np.ndarray]:
    """(hashed feature, row) of every n-gram of the given orders, with repeats; all pairs of equal neighbours also share one feature."""
    w = _tokens(data, off)
    again = np.flatnonzero(w.hash[1:] == w.hash[:-1]) + 1
    row = np.searchsorted(w.first, again, "right") - 1
    again = again[w.first[row] < again]
    ids, rows = [np.full(len(again), SAME)], [np.searchsorted(w.first, again, "right") - 1]
    for k in orders:
        h, at = wv.windows(w, k)
        ids.append((h >> np.uint64(64 - BITS)).astype(np.int64))
        rows.append(np.searchsorted(w.first, at, "right") - 1)
    return np.concatenate(ids), np.concatenate(rows)


class Ftrl:
    """FTRL-proximal for logistic loss, one example at a time; the last weight is the bias."""

    def __init__(self, alpha: float = 0.5, beta: float = 1.0, l1: float = 0.05, l2: float = 0.1):
        self.alpha, self.beta, self.l1, self.l2 = alpha, beta, l1, l2
        self.z, self.n = np.zeros((1 << BITS) + 1), np.zeros((1 << BITS) + 1)

    def weights(self, at=slice(None)) -> np.ndarray:
        z, n = self.z[at], self.n[at]
        return np.where(np.abs(z) <= self.l1, 0.0, (np.sign(z) * self.l1 - z) / ((self.beta + np.sqrt(n)) / self.alpha + self.l2))

    def learn(self, at: np.ndarray, x: np.ndarray, y: float) -> None:
        w = self.weights(at)
        g = (1 / (1 + np.exp(-np.clip(w @ x, -30, 30))) - y) * x
        sq = g * g
        n = self.n[at]
        self.z[at] += g - (np.sqrt(n + sq) - np.sqrt(n)) / self.alpha * w
        self.n[at] = n + sq


def examples(texts: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Sparse vector of each text: features with counts over the text's number of n-grams, and the bias."""
    for lo, hi, data, off in wv.slices(texts):
        ids, rows = features(data, off)
        key, count = np.unique(rows << BITS | ids, return_counts=True)
        cut = np.searchsorted(key >> BITS, np.arange(hi - lo + 1))
        for i in range(hi - lo):
            c = count[cut[i] : cut[i + 1]]
            x = GAIN * c / max(1, c.sum())
            yield np.append(key[cut[i] : cut[i + 1]] & ((1 << BITS) - 1), 1 << BITS), np.append(x, 1.0)


def train(texts: pa.Array, labels: np.ndarray, epochs: int = 4) -> np.ndarray:
    model = Ftrl()
    data = list(examples(texts))
    for e in range(epochs):
        for i in np.random.RandomState(e).permutation(len(data)):
            model.learn(*data[i], labels[i])
    return model.weights().astype(np.float32)


def score(texts: pa.Array, weights: np.ndarray) -> np.ndarray:
    out = np.zeros(len(texts))
    for lo, hi, data, off in wv.slices(texts):
        ids, rows = features(data, off)
        total = np.bincount(rows, weights[ids], hi - lo)
        out[lo:hi] = GAIN * total / np.maximum(1, np.bincount(rows, minlength=hi - lo))
    return 1 / (1 + np.exp(-np.clip(out + weights[-1], -30, 30)))


def fold_of(id_col: Column, folds: int = 5) -> Column:
    return F.coalesce(F.crc32(id_col.cast("string").cast("binary")) % folds == 0, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, max_rows: int = 8000, folds: int = 5, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> np.ndarray:
    """Weights learnt from at most max_rows labelled rows outside the held-out fold, those of the least id hashes.

    The bound makes the ids small enough to broadcast and the fit small enough
    for one task. An id with several labels counts with their rounded mean;
    null ids and labels are left out. Without any label all weights are 0.
    """
    key = F.xxhash64("id")
    ids = labels.select(F.col(id_col).alias("id"), F.col(label_col).alias("y")).where(F.col("id").isNotNull() & F.col("y").isNotNull() & ~fold_of(F.col("id"), folds))
    ids = ids.groupBy("id").agg(F.round(F.avg("y")).alias("y")).orderBy(key, "id").limit(max_rows)
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("t"))
    rows = rows.join(F.broadcast(ids), "id").select(key.alias("k"), "id", "y", "t").orderBy("k", "id", "t").limit(max_rows)

    def one(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = list(batches)
        if not got:
            return
        table = pa.Table.from_batches(got).sort_by([("k", "ascending"), ("id", "ascending"), ("t", "ascending")])
        w = train(table.column("t"), table.column("y").to_numpy())
        yield pa.RecordBatch.from_arrays([pa.array([w.tobytes()], pa.binary())], ["w"])

    got = rows.coalesce(1).mapInArrow(one, "w binary").collect()
    return np.frombuffer(got[0].w, np.float32) if got else np.zeros((1 << BITS) + 1, np.float32)


def quality_classifier(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, max_rows: int = 8000, folds: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The columns of docs plus held_out, score and predicted (input columns of these names are replaced).

    A score is the logistic function of a sparse dot product: the mean weight of
    the text's word 1- and 2-grams, hashed to 2**20 weights, and a bias. Whole
    texts are scored in Arrow batches; the 4 MB of weights are all that is
    broadcast. Null and empty texts score as the bias alone; very long texts are scored whole; equal texts, and so
    repeated rows, score alike, and a score that equals the threshold is predicted 1. A null id is not held out and has no
    label. An empty table gives no rows, and learning from it weights of 0. Only texts and labels are learnt from, of equal
    id hashes the least id and text first. Columns that aren't replaced are kept whatever their names.
    """
    small_batches(docs)
    weights = docs.sparkSession.sparkContext.broadcast(fit(docs, labels, max_rows, folds, id_col, text_col))

    @F.arrow_udf("double")
    def scored(t: pa.Array) -> pa.Array:
        return pa.array(score(t, weights.value))

    rows = docs.select(F.struct("*").alias("d"), scored(F.col(f"`{text_col}`")).alias("s"))
    predicted = F.when(F.col("s") >= threshold, 1).otherwise(0)
    return unpack(rows, docs.columns, {"held_out": fold_of(F.col(f"d.`{id_col}`"), folds), "score": F.col("s"), "predicted": predicted})

