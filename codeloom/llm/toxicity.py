"""Toxicity from subword-bag embeddings and a linear softmax (operator 7).

A text is the average of the vectors of its words and of the words' character n-grams
(hashed into buckets), and a linear softmax over that average gives the classes; vectors
and softmax are trained jointly by Adagrad in numpy.  A misspelling never seen in training
still shares most n-grams with the word it stands for.  Buckets that occur in fewer than
MIN_SHARE of the training texts have no vector and do not count in the average.

Training takes a bounded sample: about SAMPLE_PER_CLASS labelled texts a class, chosen by
a hash of the id against the class's count in the labels table.  Workers turn the sampled texts into bucket
counts; the trainer gets those counts (a few KB a text), never the corpus.  A fifth of the
sample is kept out of training to fit the score's scale and offset (Platt), weighted by the
true class sizes.  After training a bucket needs one number, its part of the logit, so
scoring streams all texts through a table of N_BUCKETS floats.

Cases: null and empty texts have an empty bag and get the score of the bias alone; without
both classes among the training rows the score is the share of toxic ones (0.0 without
rows); null or other labels are not learned from; repeated rows are scored each by itself;
other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .chargrams import Letters
from .common import held_out, labelled_sample, pick, text_slices

N_BUCKETS = 1 << 16
GRAMS = (3, 4, 5)
DIM = 8
EPOCHS = 3
RATE = 2.0
BATCH = 64
SAMPLE_PER_CLASS = 1_600
MIN_SHARE = 0.005


@dataclass
class Model:
    """logit = mean of part[bucket] over the known buckets of a text + bias, then scale and offset."""
    part: np.ndarray
    known: np.ndarray
    bias: float
    scale: float
    offset: float


def _buckets(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, int]:
    """(bucket, text row) of every word and n-gram."""
    letters = Letters(texts, digits=True)
    parts = [letters.words(), *(letters.grams(n) for n in GRAMS)]
    bucket = np.concatenate([h % np.uint64(N_BUCKETS) for h, _ in parts]).astype(np.int64)
    return bucket, np.concatenate([d for _, d in parts]).astype(np.int64), letters.n


def _bags(batches):
    """Bucket counts of every text, as little-endian arrays in binary columns."""
    for batch in batches:
        for a, b in text_slices(batch["text"]):
            part = batch.slice(a, b - a)
            bucket, row, n = _buckets(part["text"])
            keys, counts = np.unique(row * N_BUCKETS + bucket, return_counts=True)
            first = np.searchsorted(keys, np.arange(n + 1) * N_BUCKETS)
            keys, counts = (keys % N_BUCKETS).astype("<u2"), counts.astype("<u4")
            yield pa.record_batch({
                "label": part["label"],
                "fold": part["fold"],
                "buckets": pa.array([keys[first[i]:first[i + 1]].tobytes() for i in range(n)], pa.binary()),
                "counts": pa.array([counts[first[i]:first[i + 1]].tobytes() for i in range(n)], pa.binary())})


def _softmax(z: np.ndarray) -> np.ndarray:
    z = np.exp(z - z.max(axis=1, keepdims=True))
    return z / z.sum(axis=1, keepdims=True)


def fit(bags: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray, seed: int = 1) -> tuple[np.ndarray, np.ndarray, float]:
    """(part, known, bias) from bucket counts and 0/1 labels."""
    rng = np.random.default_rng(seed)
    seen = np.zeros(N_BUCKETS)
    for b, _ in bags:
        seen[b] += 1
    known = seen >= max(2, MIN_SHARE * len(bags))
    vectors = (rng.standard_normal((N_BUCKETS, DIM)) * 0.1).astype(np.float32)
    soft = (rng.standard_normal((DIM, 2)) * 0.3).astype(np.float32)
    bias = np.zeros(2, np.float32)
    sum_v, sum_s, sum_b = np.full((N_BUCKETS, 1), 1e-12, np.float32), np.full(soft.shape, 1e-8, np.float32), np.full(2, 1e-8, np.float32)
    kept = [(b[known[b]], c[known[b]].astype(np.float32)) for b, c in bags]
    usable = np.array([i for i, (b, _) in enumerate(kept) if len(b)], dtype=np.int64)
    for _ in range(EPOCHS):
        order = rng.permutation(usable)
        for at in range(0, len(order), BATCH):
            rows = order[at:at + BATCH]
            idx = np.concatenate([kept[i][0] for i in rows]).astype(np.int64)
            share = np.concatenate([kept[i][1] / kept[i][1].sum() for i in rows])
            size = [len(kept[i][0]) for i in rows]
            row = np.repeat(np.arange(len(rows)), size)
            first = np.concatenate([[0], np.cumsum(size)[:-1]])
            mean = np.add.reduceat(vectors[idx] * share[:, None], first)
            delta = _softmax(mean @ soft + bias)
            delta[np.arange(len(rows)), y[rows]] -= 1
            delta /= len(rows)
            grad_s, grad_b = mean.T @ delta, delta.sum(axis=0)
            pull = (delta @ soft.T)[row] * share[:, None]
            uniq, where = np.unique(idx, return_inverse=True)
            grad_v = np.stack([np.bincount(where, pull[:, j], len(uniq)) for j in range(DIM)], axis=1).astype(np.float32)
            sum_v[uniq] += (grad_v ** 2).mean(axis=1, keepdims=True)
            vectors[uniq] -= RATE * grad_v / np.sqrt(sum_v[uniq])
            sum_s += grad_s ** 2
            soft -= RATE * grad_s / np.sqrt(sum_s)
            sum_b += grad_b ** 2
            bias -= RATE * grad_b / np.sqrt(sum_b)
    part = vectors @ (soft[:, 1] - soft[:, 0])
    return np.where(known, part, 0).astype(np.float32), known, float(bias[1] - bias[0])


def platt(z: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[float, float]:
    """Weighted logistic fit of y on scale * z + offset by damped Newton steps; z is standardised inside."""
    m, s = (np.average(z, weights=weight), z.std() or 1.0) if len(z) else (0.0, 1.0)
    x = np.stack([(z - m) / s, np.ones(len(z))], axis=1)
    beta = np.array([1.0, 0.0])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        grad = x.T @ (weight * (p - y)) + 1e-3 * beta
        hess = (x * (weight * p * (1 - p))[:, None]).T @ x + 1e-3 * np.eye(2)
        step = np.linalg.solve(hess, grad)
        beta = beta - np.clip(step, -2, 2)
    return float(beta[0] / s), float(beta[1] - beta[0] * m / s)


def train(docs: DataFrame, marks: DataFrame, most: int = SAMPLE_PER_CLASS) -> Model:
    """A model from docs (doc_id, text) and marks (doc_id, label 0/1); see the module's notes on the sample."""
    sample, sizes = labelled_sample(docs, marks, most, seed=7)
    total = sum(sizes.values())
    empty = Model(np.zeros(N_BUCKETS, np.float32), np.zeros(N_BUCKETS, bool), 0.0, 1.0, 0.0)
    if len(sizes) < 2:
        empty.offset = 40.0 if total and 1 in sizes else -40.0
        return empty
    fold = F.pmod(F.xxhash64("doc_id", F.lit(71)), F.lit(5)).cast("int")
    rows = (sample.select("label", fold.alias("fold"), "text")
            .mapInArrow(_bags, "label int, fold int, buckets binary, counts binary").toArrow())
    y = rows["label"].to_numpy().astype(np.int64)
    held = rows["fold"].to_numpy() == 0
    bags = [(np.frombuffer(b, "<u2"), np.frombuffer(c, "<u4")) for b, c in zip(rows["buckets"].to_pylist(), rows["counts"].to_pylist(), strict=True)]
    # The order rows arrive in depends on the partitioning; training does not.
    order = sorted(range(len(bags)), key=lambda i: (int(y[i]), bags[i][0].tobytes(), bags[i][1].tobytes()))
    fit_rows, cal_rows = [i for i in order if not held[i]], [i for i in order if held[i]]
    if len(set(y[fit_rows])) < 2 or len(set(y[cal_rows])) < 2:
        fit_rows = cal_rows = order
    part, known, bias = fit([bags[i] for i in fit_rows], y[fit_rows])
    z = np.array([_logit(part, known, *bags[i]) for i in cal_rows]) + bias
    yc = y[cal_rows]
    weight = np.where(yc == 1, sizes[1] / max(1, (yc == 1).sum()), sizes[0] / max(1, (yc == 0).sum())) * len(yc) / total
    scale, offset = platt(z, yc, weight)
    return Model(part, known, bias, scale, offset)


def _logit(part, known, buckets, counts) -> float:
    c = counts * known[buckets]
    return float((part[buckets] * c).sum() / c.sum()) if c.sum() else 0.0


def _scorer(model):
    def run(batches):
        m = model.value
        for batch in batches:
            for a, b in text_slices(batch["text"]):
                rows = batch.slice(a, b - a)
                bucket, row, n = _buckets(rows["text"])
                use = m.known[bucket]
                count = np.bincount(row[use], minlength=n)
                z = np.bincount(row[use], m.part[bucket[use]], minlength=n) / np.maximum(count, 1) + m.bias
                score = 1 / (1 + np.exp(-np.clip(m.scale * z + m.offset, -40, 40)))
                yield pa.record_batch({"doc_id": rows["doc_id"], "held_out": rows["held_out"], "score": pa.array(score),
                                       "predicted": pa.array((score >= 0.5).astype(np.int32))})
    return run


def toxicity(docs: DataFrame, labels: DataFrame, most: int = SAMPLE_PER_CLASS) -> DataFrame:
    """doc_id, held_out, score, predicted for every row of ``docs``; learns from rows that are not held out."""
    d = pick(docs, doc_id="long", text="string").withColumn("held_out", held_out(F.col("doc_id"), 5, 0))
    marks = pick(labels, doc_id="long", toxic="int").select("doc_id", F.col("toxic").alias("label")).where("label IN (0, 1)")
    marks = marks.where(~held_out(F.col("doc_id"), 5, 0)).groupBy("doc_id").agg(F.max("label").alias("label"))
    model = docs.sparkSession.sparkContext.broadcast(train(d.select("doc_id", "text"), marks, most))
    return d.select("doc_id", "held_out", "text").mapInArrow(_scorer(model), "doc_id long, held_out boolean, score double, predicted int")
