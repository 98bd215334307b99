"""Operator 13 against brute force."""

import numpy as np
import pytest

from codeloom.llm import hard_negatives as H
from pyspark.sql import functions as F

SCHEMA = "norm int, vec_id long, embedding array<float>, label int, angle string, VEC_ID int"


def brute(data, anchor=100, changed=7):
    """data: (vec_id, embedding, label)."""
    rows = []
    for i, v, label in data:
        if i is None or v is None or label is None or any(x is None or not np.isfinite(np.float32(x)) for x in v):
            continue
        row = (i, (label + 1) % 10 if i % changed == 0 else label, tuple(int(np.floor(256 * float(np.float32(x)))) for x in v))
        if row not in rows:
            rows.append(row)
    dot = lambda a, b: sum(x * y for x, y in zip(a, b, strict=False))
    out = []
    for a, la, va in rows:
        if a % anchor:
            continue
        positives = sorted([(-dot(va, v), i) for i, label, v in rows if label == la and i != a])[:5]
        for p, i in positives:
            p = -p
            negatives = sorted([(-dot(va, v), j) for j, label, v in rows if label != la and 80 * p <= 100 * dot(va, v) <= 100 * p])[:5]
            out += [(a, i, r + 1, j, p, -n) for r, (n, j) in enumerate(negatives)]
    return sorted(out)


def got(spark, data, anchor=100, **kw):
    t = spark.createDataFrame([(1, i, v, label, "x", 3) for i, v, label in data], SCHEMA).repartition(5)
    rows = H.prepared(t, changed=F.col("vec_id") % 7 == 0)
    out = H.hard_negatives(rows, F.col("vec_id") % anchor == 0, **kw).collect()
    return sorted((r["anchor_id"], r["positive_id"], r["rank"], r["negative_id"], r["positive_score"], r["negative_score"]) for r in out)


def clustered(rng, n, width=24, centres=12):
    c = rng.normal(size=(centres, width))
    x = c[rng.integers(0, centres, n)] + 0.3 * rng.normal(size=(n, width))
    return (x / np.linalg.norm(x, axis=1)[:, None]).astype(np.float32)


def test_clusters_ties_repeats_and_unusable_rows(spark):
    rng = np.random.default_rng(3)
    x = clustered(rng, 700)
    x[300:420] = x[300]                                         # a group of copies
    x[420:430] *= rng.uniform(0.2, 40, size=(10, 1)).astype(np.float32)
    x[430] = 0
    data = [(i, [float(y) for y in v], int(rng.integers(0, 10))) for i, v in enumerate(x)]
    data += [data[5], data[100], (100, [0.5] * 24, 3), (None, [0.1] * 24, 1), (900, None, 1), (1000, [0.1] * 24, None), (1100, [0.1] * 23 + [float("nan")], 1),
             (1200, [float("inf")] + [0.1] * 23, 1), (1300, [None] + [0.1] * 23, 1), (1400, [], 2), (1500, [1.0, 2.0], 4), (1600, [-3.0] * 30, 5), (-100, [0.3] * 24, 6)]
    want = brute(data, 20)
    assert len(want) > 300
    assert got(spark, data, 20) == want
    assert got(spark, data, 20, chunk_bytes=3_000) == want       # several chunks of anchors


def test_spread_vectors_and_small_tables(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(300, 7))
    data = [(i, [float(np.float32(y)) for y in v], int(rng.integers(0, 3))) for i, v in enumerate(x)]
    assert got(spark, data, 10) == brute(data, 10)
    assert got(spark, data[:2], 10) == brute(data[:2], 10)
    assert got(spark, [], 10) == []
    assert got(spark, [(0, [1.0], 1)], 10) == []


def test_bounds_hold_and_skip_most_clustered_pairs():
    rng = np.random.default_rng(5)
    v = np.floor(256 * clustered(rng, 6_000, 32, 40)).astype(np.int64)
    refs = H.directions(v[:1_000], 24)
    norm, angles = H.angles_to(refs, v)
    angles = angles.astype(np.float32).astype(np.float64)
    cell = angles.argmin(axis=1)
    order = np.lexsort((angles[np.arange(len(v)), cell], cell))
    ids, labels = np.arange(len(v)), rng.integers(0, 10, len(v))
    q = np.arange(0, len(v), 100)
    score = v[q] @ v.T
    fifth = np.sort(np.where(ids[None, :] == q[:, None], -10**9, score), axis=1)[:, -5]
    w = H.Wanted(q, labels[q], v[q], norm[q], angles[q], False, np.arange(len(q)), (0.9 * fifth).astype(np.int64), fifth)
    for c in np.unique(cell):
        rows = order[cell[order] == c]
        for a in range(0, len(rows), 64):
            r = rows[a:a + 64]
            w.block(ids[r], labels[r], v[r], norm[r], angles[r], int(c))
    w.settle()
    for k, a in enumerate(q):
        fit = [(-score[k, i], i) for i in ids if labels[i] != labels[a] and int(0.9 * fifth[k]) <= score[k, i] <= fifth[k]]
        at = w.kept[0] == k
        assert list(zip(-w.kept[2][at], w.kept[1][at], strict=True)) == sorted(fit)[:5]
    assert w.scored < 0.35 * w.seen


def test_missing_columns(spark):
    with pytest.raises(ValueError):
        H.prepared(spark.createDataFrame([(1,)], "vec_id long"))
