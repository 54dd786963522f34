"""Toxicity: a linear classifier on character n-grams, scaled by naive Bayes log-count ratios.

Features are the n-grams (ORDERS code points, A-Z lowered) that a text has, hashed to
2^HASH_BITS. r_j = log of the ratio of a feature's smoothed share in toxic and in other training
texts; a logistic regression is trained on the features x_j * r_j, by Adam on mini-batches
with a weak L2. Training texts are a bounded sample of the labelled rows (SAMPLE rows of
each class at most, by the order of a hash of doc_id; one task holds them, whole), and the intercept is set right for the
classes' shares among all labelled rows. Every text is scored whole.

Nulls: a null text counts as empty and is scored as such; null labels and null doc_ids are not
trained on; a null doc_id is scored as any other row. Several labels for one doc_id: it is toxic if one says
so, and of several texts it is the least that is trained on. Texts with several rows are scored alike;
very long texts are scored whole, some at a time. Without labelled rows of both classes, every
text gets the share of toxic labels (0 if there are none). An empty table gives no rows. Extra columns are
not read. Labels, lang, source and doc_id are not among the features.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import shared

HASH_BITS, ORDERS = 20, (4, 5, 6)
#: Training rows of each class at most; code points of a training text are all used.
SAMPLE = 3000
#: Features whose count differs between the classes by less than this (G-test statistic) are left out.
MIN_G = 20.0
EPOCHS, RATE, L2, SMOOTH = 30, 0.02, 1e-3, 1.0


def code_points(text: str | None) -> np.ndarray:
    x = np.frombuffer((text or "").encode("utf-32-le", "surrogatepass"), np.uint32)
    return np.where((x >= 65) & (x <= 90), x + 32, x).astype(np.uint32)


def grams(points: np.ndarray, owner: np.ndarray | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(positions, hashed features) of each order; with owner, none across two texts."""
    h = np.zeros(len(points), np.uint64)
    for n in range(1, max(ORDERS) + 1):
        if n > len(points):
            return
        h = h[: len(points) - n + 1] * np.uint64(0x9E3779B97F4A7C15) + points[n - 1 :] + np.uint64(n)
        if n in ORDERS:
            f = ((h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) >> np.uint64(64 - HASH_BITS)).astype(np.int32)
            at = np.arange(len(f))
            if owner is not None:
                inside = owner[: len(f)] == owner[n - 1 :]
                at, f = at[inside], f[inside]
            yield at, f


def features(text: str | None) -> np.ndarray:
    """The distinct hashed features of a text, sorted."""
    return np.unique(np.concatenate([f for _, f in grams(code_points(text))] or [np.empty(0, np.int32)]))


@dataclass
class Model:
    """Weights by hashed feature (ratio included), and the intercept."""

    weights: np.ndarray
    bias: float

    def scores(self, texts: list[str | None]) -> np.ndarray:
        out = np.full(len(texts), self.bias)
        sizes = np.cumsum([len(t or "") for t in texts])
        begin = 0
        while begin < len(texts):  # about half a million code points at a time, a text at least
            before = sizes[begin - 1] if begin else 0
            end = max(begin + 1, int(np.searchsorted(sizes, before + 500_000, side="right")))
            points = [code_points(t) for t in texts[begin:end]]
            flat = np.concatenate(points)
            owner = np.repeat(np.arange(begin, end, dtype=np.int64), [len(p) for p in points])
            hits = []
            for at, f in grams(flat, owner):
                hit = np.flatnonzero(self.weights[f])
                hits.append(owner[at[hit]] << HASH_BITS | f[hit])
            if hits:
                seen = np.unique(np.concatenate(hits))
                np.add.at(out, seen >> HASH_BITS, self.weights[seen & ((1 << HASH_BITS) - 1)].astype(np.float64))
            begin = end
        return 1 / (1 + np.exp(-np.clip(out, -60, 60)))


def g_test(times: np.ndarray, texts: np.ndarray) -> np.ndarray:
    """The G statistic of each feature: (2, features) texts that have it, of (2,) texts."""
    out = np.zeros(times.shape[1])
    both = times.sum(axis=0)
    for c in (0, 1):
        for seen, total in ((times[c], both), (texts[c] - times[c], texts.sum() - both)):
            expected = total * texts[c] / texts.sum()
            out += 2 * seen * np.log(np.where(seen > 0, seen, 1) / np.where(seen > 0, expected, 1))
    return out


def fit(texts: list[str | None], toxic: list[int], share: float) -> Model:
    """share: of toxic rows among all labelled ones."""
    size = 1 << HASH_BITS
    y = np.array(toxic, np.float64)
    prior = float(np.clip(share, 1e-6, 1 - 1e-6))
    model = Model(np.zeros(size, np.float32), float(np.log(prior / (1 - prior))) if len(y) else -60.0)
    if not len(y) or y.min() == y.max():
        if not 0 < share < 1:
            model.bias = -60.0 if share <= 0 else 60.0
        return model
    times = np.zeros((2, size))
    for text, t in zip(texts, toxic, strict=True):
        times[t, features(text)] += 1
    share_of = (times + SMOOTH) / (np.bincount(np.array(toxic), minlength=2)[:, None] + 2 * SMOOTH)
    ratio = np.log(share_of[1] / share_of[0])
    use = g_test(times, np.bincount(np.array(toxic), minlength=2)) >= MIN_G
    place = np.cumsum(use) - 1
    scale = ratio[use]
    rows = []
    for text in texts:  # made a second time: all features of all texts at once would fill the driver
        f = features(text)
        rows.append(place[f[use[f]]])
    w, b = np.zeros(len(scale)), 0.0
    m, v, mb, vb, step = np.zeros_like(w), np.zeros_like(w), 0.0, 0.0, 0
    balance = np.where(y > 0, 0.5 / y.mean(), 0.5 / (1 - y.mean()))
    random = np.random.default_rng(7)
    for _ in range(EPOCHS):
        for part in np.array_split(random.permutation(len(rows)), max(1, len(rows) // 256)):
            z = np.array([w[rows[k]] @ scale[rows[k]] for k in part]) + b
            gap = (1 / (1 + np.exp(-np.clip(z, -60, 60))) - y[part]) * balance[part] / len(part)
            grad = L2 * w
            for k, g in zip(part, gap, strict=True):
                grad[rows[k]] += g * scale[rows[k]]
            step += 1
            m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
            mb, vb = 0.9 * mb + 0.1 * gap.sum(), 0.999 * vb + 0.001 * gap.sum() ** 2
            c1, c2 = 1 - 0.9**step, 1 - 0.999**step
            w -= RATE * (m / c1) / (np.sqrt(v / c2) + 1e-8)
            b -= RATE * (mb / c1) / (np.sqrt(vb / c2) + 1e-8)
    model.weights[use] = w * scale
    # Trained with both classes in balance; the odds of the classes come in with the intercept.
    model.bias = b + float(np.log(prior / (1 - prior)))
    return model


def fold(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % 5


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    """Fits on rows whose crc32(doc_id as text) mod 5 is not 0: `sample` of each class at most."""
    known = (
        labels.where("doc_id IS NOT NULL AND toxic IS NOT NULL")
        .where(fold(F.col("doc_id")) != 0)
        .groupBy(F.col("doc_id").cast("long").alias("doc_id"))
        .agg(F.max("toxic").cast("int").alias("toxic"))
    )
    seen = {int(r["toxic"] > 0): int(r["n"]) for r in known.groupBy(F.col("toxic") > 0).agg(F.max("toxic").alias("toxic"), F.count("*").alias("n")).collect()}
    total = sum(seen.values())
    share = seen.get(1, 0) / total if total else 0.0
    if total == 0:
        return fit([], [], 0.0)
    # 2 * sample ids at most: bounded by the parameter, so they may be broadcast.
    picked = [known.where(F.col("toxic") > 0 if c else F.col("toxic") <= 0).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample) for c in (0, 1)]
    ids = F.broadcast(picked[0].unionByName(picked[1]))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(ids, "doc_id")
    rows = rows.groupBy("doc_id").agg(F.min("text").alias("text"), F.max("toxic").alias("toxic"))  # of several texts, the least
    shared.bounded_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        texts, toxic = [], []
        for b in batches:
            texts += b.column("text").to_pylist()
            toxic += [int(t > 0) for t in b.column("toxic").to_pylist()]
        model = fit(texts, toxic, share)
        yield pa.RecordBatch.from_arrays([pa.array([model.weights.tobytes()], pa.binary()), pa.array([float(model.bias)])], names=["weights", "bias"])

    # The sample meets in one task, which holds its 2 * sample texts; the driver gets the model alone.
    fitted = rows.repartition(1).sortWithinPartitions("doc_id").mapInArrow(run, "weights binary, bias double").collect()
    if not fitted:  # no row, and so no task
        return fit([], [], share)
    return Model(np.frombuffer(fitted[0]["weights"], np.float32), fitted[0]["bias"])


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, score, predicted of every row."""
    shared.bounded_batches(docs.sparkSession)
    model_ref = docs.sparkSession.sparkContext.broadcast((model.weights, model.bias))  # 2^HASH_BITS floats

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Model(*model_ref.value)
        for b in batches:
            s = own.scores(b.column("text").to_pylist())
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("held_out"), pa.array(s), pa.array((s >= 0.5).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(fold(F.col("doc_id").cast("long")) == 0, F.lit(False)).alias("held_out"), "text")
    return rows.mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")


def drop_toxic(docs: DataFrame, model: Model) -> DataFrame:
    """docs without the rows predicted toxic; all columns, one pass."""
    shared.bounded_batches(docs.sparkSession)
    model_ref = docs.sparkSession.sparkContext.broadcast((model.weights, model.bias))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Model(*model_ref.value)
        for b in batches:
            yield b.filter(pa.array(own.scores(b.column("text").to_pylist()) < 0.5))

    return docs.mapInArrow(run, docs.schema)
