"""Exact top-k inner-product search by no-random-access aggregation (operator 8).

Every dimension of a block of candidate vectors is a list sorted by value.  A query reads
each list from its useful end (largest first for a positive weight, smallest first for a
negative one), all lists to the same depth.  After a round, a candidate's score lies between

* a lower bound: what has been read of it, and for each unread list the list's worst value;
* an upper bound: what has been read of it, and for each unread list the value last read.

Both bounds of all candidates of a block are two matrix products over clipped columns,
because "read" means "at or beyond the last value read".  A query stops when no other
candidate's upper bound reaches its k-th best lower bound; candidates still able to
qualify are resolved to their full scores.  No list is accessed by candidate id while
bounds are kept.

Spark deals candidates into blocks and queries into blocks by hash; one task handles one
(candidate block, query block) pair, so its memory is bounded whatever the tables' sizes,
and the per-block winners (k a query) are ranked once more over all blocks.

Cases: rows with a null id, a null vector, or a null or non-finite component take no part;
shorter vectors count as padded with zeros; an empty vector scores 0; identical repeated
rows count once; rows that repeat an id with another vector are candidates of their own;
a query's candidates are all rows with another id; ties go to the smaller id; an empty
table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import pick

SCALE = 64
CANDIDATE_BLOCK = 16_384      # vectors a candidate block, in expectation
QUERY_BLOCK = 2_048           # queries a query block, in expectation
DEPTHS = (0.05, 0.2, 0.45)    # share of each list read by the end of a round
_STEP = 256                   # queries handled at once inside a task

_RESULT = "query_id long, vec_id long, score long"


def quantised(vectors: DataFrame, scale: int = SCALE) -> DataFrame:
    """vec_id, v: every component x as floor(scale * x), x as double; unusable rows left out."""
    v = pick(vectors, vec_id="long", embedding="array<double>")
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return (v.where(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull()).where(finite)
            .select("vec_id", F.transform("embedding", lambda x: F.floor(x * scale)).alias("v")).distinct())


def _matrix(lists: pa.Array, width: int) -> np.ndarray:
    """Rows padded with zeros to ``width``; float64 holds the integers exactly (see _products_are_exact)."""
    lists = lists.combine_chunks() if isinstance(lists, pa.ChunkedArray) else lists
    sizes = np.diff(lists.offsets.to_numpy())
    flat = lists.flatten().to_numpy(zero_copy_only=False)
    if len(sizes) and (sizes == width).all():
        return flat.reshape(len(sizes), width).astype(np.int64)
    out = np.zeros((len(sizes), width), dtype=np.int64)
    out[np.repeat(np.arange(len(sizes)), sizes), np.concatenate([np.arange(s) for s in sizes]) if len(sizes) else []] = flat
    return out


def _exact_type(q: np.ndarray, v: np.ndarray):
    """A number type in which every partial sum is exact: float32 under 2**24, float64 under 2**53, else Python integers."""
    most = max(1, q.shape[1]) * max(1, _size(q)) * max(1, _size(v))
    return np.float32 if most < 1 << 24 else np.float64 if most < 1 << 53 else object


def _size(m: np.ndarray) -> int:
    return max(abs(int(m.min())), abs(int(m.max()))) if m.size else 0


def nra(q_ids: np.ndarray, q: np.ndarray, ids: np.ndarray, v: np.ndarray, k: int, depths=DEPTHS):
    """The k best candidates of each query: lists (query index, candidate index, score).

    q: queries x dims, v: candidates x dims, both integers.
    """
    n = len(ids)
    kind = _exact_type(q, v)
    q, v = q.astype(kind), v.astype(kind)
    by_value = np.sort(v, axis=0)                      # every dimension's list, smallest first
    low, high = (by_value[0], by_value[-1]) if n else (None, None)
    plus, minus = np.maximum(q, 0), np.minimum(q, 0)
    out_q, out_c, out_s = [], [], []
    left = np.arange(len(q))
    for depth in (*depths, 1.0):
        if not len(left) or not n:
            break
        at = min(n, max(k + 1, int(np.ceil(depth * n))))
        done = at >= n
        if done:
            below = above = v.T
            worst_p = worst_m = None
        else:
            last_p, last_m = by_value[n - at], by_value[at - 1]            # values last read from either end
            below = np.where(v >= last_p, v, last_p).T                      # best case of a positive weight's list
            above = np.where(v <= last_m, v, last_m).T                      # best case of a negative weight's list
            worst_p, worst_m = np.where(v >= last_p, v, low).T, np.where(v <= last_m, v, high).T
        stopped = []
        for a in range(0, len(left), _STEP):
            rows = left[a:a + _STEP]
            upper = plus[rows] @ below + minus[rows] @ above
            lower = upper if done else plus[rows] @ worst_p + minus[rows] @ worst_m
            own = q_ids[rows][:, None] == ids[None, :]
            if own.any():
                lower = lower.copy()
                lower[own] = _least(kind)
                upper = np.where(own, _least(kind), upper)
            take = min(k, n)
            kth = np.partition(lower, n - take, axis=1)[:, n - take] if kind is not object else np.sort(lower, axis=1)[:, n - take]
            able = (upper >= kth[:, None]) & ~own
            # Stop when the candidates still able to qualify are few enough to resolve at once.
            few = np.ones(len(rows), bool) if done else able.sum(axis=1) <= max(4 * k, n // 50)
            stopped.append(few)
            for r in np.flatnonzero(few):
                c = np.flatnonzero(able[r])
                s = upper[r][c] if done else v[c] @ q[rows[r]]
                best = np.lexsort((ids[c], -s))[:k]
                out_q.append(np.full(len(best), rows[r]))
                out_c.append(c[best])
                out_s.append(np.array([int(x) for x in s[best]], dtype=np.int64))
        left = left[~np.concatenate(stopped)]
    cat = lambda xs, t: np.concatenate(xs) if xs else np.zeros(0, t)
    return cat(out_q, np.int64), cat(out_c, np.int64), cat(out_s, np.int64)


def _least(kind):
    return -(1 << 200) if kind is object else -np.inf


def _block_pair(k: int):
    def run(candidates: pa.Table, queries: pa.Table) -> pa.Table:
        out = {"query_id": [], "vec_id": [], "score": []}
        if candidates.num_rows and queries.num_rows:
            c, q = candidates["v"].combine_chunks(), queries["v"].combine_chunks()
            width = max(int(np.diff(x.offsets.to_numpy()).max(initial=0)) for x in (c, q))
            ids, q_ids = candidates["vec_id"].to_numpy(), queries["vec_id"].to_numpy()
            a, b, s = nra(q_ids, _matrix(q, width), ids, _matrix(c, width), k)
            out = {"query_id": q_ids[a], "vec_id": ids[b], "score": s}
        return pa.table({n: pa.array(x, pa.int64()) for n, x in out.items()})
    return run


def exact_topk(vectors: DataFrame, queries: DataFrame, k: int = 20, candidate_block: int = CANDIDATE_BLOCK,
               query_block: int = QUERY_BLOCK) -> DataFrame:
    """query_id, rank, vec_id, score: the k best of ``vectors`` for each row of ``queries`` (both vec_id, v of integers)."""
    n_c, n_q = vectors.count(), queries.count()
    blocks_c, blocks_q = max(1, -(-n_c // candidate_block)), max(1, -(-n_q // query_block))
    # Blocks are dealt by the row, so a group of equal vectors or ids is spread.
    pair = lambda df, own, n_own, other, n_other: df.select(
        "*", F.pmod(F.xxhash64("vec_id", "v"), F.lit(n_own)).cast("int").alias(own),
        F.explode(F.sequence(F.lit(0), F.lit(n_other - 1))).alias(other))
    c = pair(vectors, "cb", blocks_c, "qb", blocks_q)
    q = pair(queries, "qb", blocks_q, "cb", blocks_c).select("vec_id", "v", "cb", "qb")
    best = c.groupBy("cb", "qb").cogroup(q.groupBy("cb", "qb")).applyInArrow(_block_pair(k), _RESULT)
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    # Rows that repeat a candidate id with another vector may tie; both are candidates.
    return best.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
