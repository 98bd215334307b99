"""V1/V2 embedding plug-in and V4 exact cosine nearest neighbours.

The query matrix is broadcast only behind a row bound; beyond it the
queries are processed in bounded chunks.  Each task scans its share of the
document vectors once per chunk and keeps, per query, a running top-k plus
the min/max score (the min/max feed hybrid scaling).  Only k rows per query
per task leave a task, and a WindowGroupLimit finishes the global top-k.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.sizing import fits, spread
from ..session import cut_lineage
from .predict import resolve, worker_model
from .ranking import SCORE_DECIMALS, top_k

MAX_QUERY_ROWS = 50_000       # rows per broadcast query chunk
_QUERY_BLOCK = 256            # queries scored together inside a task

PARTIAL_SCHEMA = T.StructType([
    T.StructField("query_id", T.LongType()),
    T.StructField("doc_id", T.LongType()),
    T.StructField("vec_score", T.DoubleType()),
    T.StructField("vec_min", T.DoubleType()),
    T.StructField("vec_max", T.DoubleType()),
])


def _unit_rows(m: np.ndarray) -> np.ndarray:
    n = np.linalg.norm(m, axis=1, keepdims=True)
    n[n == 0] = 1.0
    return m / n


def _to_matrix(arr: pa.Array) -> np.ndarray:
    flat = arr.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(arr), -1) if len(arr) else flat.reshape(0, 0)


def _nearest(scores: np.ndarray, ids: np.ndarray, k: int, margin: float) -> tuple[np.ndarray, np.ndarray]:
    """The k best by (score, smaller id), and with a margin the rows at most that far below the
    k-th; of rows with one score the k smallest ids, so equal vectors stay bounded."""
    order = np.lexsort((ids, -scores))
    s, i = scores[order], ids[order]
    if margin == 0:
        return s[:k], i[:k]
    s, i = s[s >= s[min(k, len(s)) - 1] - margin], i[:int((s >= s[min(k, len(s)) - 1] - margin).sum())]
    place = np.arange(len(s)) - np.searchsorted(-s, -s, side="left")
    return s[place < k], i[place < k]


def _partial_topk_fn(bc, k: int, doc_id: str, vec: str,
                     group: str | None = None, margin: float = 0.0) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        qids, qmat, qgroups = bc.value
        codes = {g: i for i, g in enumerate(sorted(set(qgroups)))} if group else {}
        qcode = np.array([codes[g] for g in qgroups], dtype=np.int64) if group else None
        nq = len(qids)
        best = [(np.zeros(0), np.zeros(0, dtype=np.int64))] * nq
        vmin = np.full(nq, np.inf)
        vmax = np.full(nq, -np.inf)
        for b in batches:
            ids = b.column(doc_id)
            vecs = b.column(vec)
            keep = pc.and_(pc.is_valid(ids), pc.is_valid(vecs))
            if not pc.all(keep).as_py():
                b = b.filter(keep)
                ids, vecs = b.column(doc_id), b.column(vec)
            if b.num_rows == 0 or nq == 0:
                continue
            if group:
                # only documents of a collection some query searches
                dcode = np.array([codes.get(g, -1) for g in b.column(group).to_pylist()], dtype=np.int64)
                sel = dcode >= 0
                if not sel.any():
                    continue
                b, dcode = b.filter(pa.array(sel)), dcode[sel]
                ids, vecs = b.column(doc_id), b.column(vec)
            d = _unit_rows(_to_matrix(vecs))
            did = ids.to_numpy(zero_copy_only=False).astype(np.int64)
            for lo in range(0, nq, _QUERY_BLOCK):
                hi = min(lo + _QUERY_BLOCK, nq)
                s = np.round(qmat[lo:hi] @ d.T, SCORE_DECIMALS)
                if group:
                    own = qcode[lo:hi, None] == dcode[None, :]
                    vmin[lo:hi] = np.minimum(vmin[lo:hi], np.where(own, s, np.inf).min(axis=1))
                    vmax[lo:hi] = np.maximum(vmax[lo:hi], np.where(own, s, -np.inf).max(axis=1))
                    s = np.where(own, s, -np.inf)
                else:
                    vmin[lo:hi] = np.minimum(vmin[lo:hi], s.min(axis=1))
                    vmax[lo:hi] = np.maximum(vmax[lo:hi], s.max(axis=1))
                if len(did) > k:
                    floor = np.partition(s, len(did) - k, axis=1)[:, len(did) - k]
                    near = s >= floor[:, None] - margin
                else:
                    near = np.ones(s.shape, dtype=bool)
                near &= np.isfinite(s)  # masked: another collection
                for q in np.flatnonzero(near.any(axis=1)):
                    at = np.flatnonzero(near[q])
                    have = best[lo + q]
                    best[lo + q] = _nearest(np.concatenate([have[0], s[q, at]]), np.concatenate([have[1], did[at]]), k, margin)
        sizes = [len(x[0]) for x in best]
        n = sum(sizes)
        if not np.isfinite(vmin).any():
            return
        if n:
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.repeat(qids, sizes), pa.int64()), pa.array(np.concatenate([x[1] for x in best]), pa.int64()),
                 pa.array(np.concatenate([x[0] for x in best]), pa.float64()), pa.nulls(n, pa.float64()), pa.nulls(n, pa.float64())],
                schema=_ARROW_SCHEMA)
        seen = np.isfinite(vmin)
        yield pa.RecordBatch.from_arrays(
            [pa.array(qids[seen], pa.int64()), pa.nulls(int(seen.sum()), pa.int64()),
             pa.nulls(int(seen.sum()), pa.float64()),
             pa.array(vmin[seen], pa.float64()), pa.array(vmax[seen], pa.float64())],
            schema=_ARROW_SCHEMA)
    return run


_ARROW_SCHEMA = pa.schema([("query_id", pa.int64()), ("doc_id", pa.int64()),
                           ("vec_score", pa.float64()), ("vec_min", pa.float64()),
                           ("vec_max", pa.float64())])


def _query_chunks(queries: DataFrame, query_id: str, vec: str, group: str | None = None) -> list[DataFrame]:
    g = F.col(group).cast("string") if group else F.lit(None).cast("string")
    q = queries.select(F.col(query_id).cast("long").alias("query_id"), F.col(vec).alias("vec"), g.alias("grp"))
    if fits(q, MAX_QUERY_ROWS):
        return [q]
    n = q.count()
    chunks = -(-n // MAX_QUERY_ROWS)
    key = F.pmod(F.xxhash64("query_id"), F.lit(chunks))
    return [q.filter(key == i) for i in range(chunks)]


def vector_partials(docs: DataFrame, queries: DataFrame, k: int, *, doc_id: str = "doc_id",
                    doc_vec: str = "embedding", query_id: str = "query_id",
                    query_vec: str = "embedding", group: str | None = None, margin: float = 0.0) -> DataFrame:
    """Per-task partial results: top rows (doc_id set) and stat rows (doc_id null).

    With ``group`` (a column of both tables, e.g. snapshot_id) a query only
    scores documents of its own collection."""
    spark = docs.sparkSession
    gcol = [F.col(group).cast("string").alias(group)] if group else []
    d = spread(docs.select(F.col(doc_id).cast("long").alias(doc_id), F.col(doc_vec).alias(doc_vec), *gcol), doc_id)
    parts = []
    for chunk in _query_chunks(queries, query_id, query_vec, group):
        rows = [r for r in chunk.collect() if r["vec"] is not None]  # bounded by MAX_QUERY_ROWS
        qids = np.array([r["query_id"] for r in rows], dtype=np.int64)
        qm = [r["vec"] for r in rows]
        qmat = _unit_rows(np.asarray(qm, dtype=np.float64)) if qm else np.zeros((0, 0))
        bc = spark.sparkContext.broadcast((qids, qmat, [r["grp"] for r in rows]))
        parts.append(d.mapInArrow(_partial_topk_fn(bc, k, doc_id, doc_vec, group, margin), PARTIAL_SCHEMA))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def vector_topk(docs: DataFrame, queries: DataFrame, k: int, **kw) -> tuple[DataFrame, DataFrame]:
    """(top, stats): top-k (query_id, doc_id, vec_score, vec_rank) and per-query (vec_min, vec_max).

    With ``margin`` also the rows at most that far below the k-th score, the k smallest ids of a score."""
    # Partials (k rows per query per task, plus min/max rows) feed two consumers.
    part = cut_lineage(vector_partials(docs, queries, k, **kw))
    rows = part.filter(F.col("doc_id").isNotNull()).select("query_id", "doc_id", "vec_score")
    top = top_k(rows, ["query_id"], "vec_score", ["doc_id"], k, "vec_rank")
    if kw.get("margin"):
        floor = top.groupBy("query_id").agg((F.min("vec_score") - kw["margin"]).alias("floor"))
        near = rows.join(floor, "query_id").filter(F.col("vec_score") >= F.col("floor")).drop("floor")
        top = top_k(near, ["query_id", "vec_score"], "vec_score", ["doc_id"], k, "vec_rank")
    stats = (part.filter(F.col("doc_id").isNull())
             .groupBy("query_id")
             .agg(F.min("vec_min").alias("vec_min"), F.max("vec_max").alias("vec_max")))
    return top, stats


def _ranks_fn(sent, doc_id: str, vec: str, group: str | None):
    """How many of the task's documents come before each marked hit of each query."""
    def run(batches):
        qids, qmat, qgroups, score, ids = sent.value            # score, ids: queries x marks, NaN where there is none
        before = np.zeros(score.shape, dtype=np.int64)
        for b in batches:
            b = b.filter(pc.and_(pc.is_valid(b.column(doc_id)), pc.is_valid(b.column(vec))))
            if not b.num_rows:
                continue
            d, did = _unit_rows(_to_matrix(b.column(vec))), b.column(doc_id).to_numpy(zero_copy_only=False)
            own = np.array(b.column(group).to_pylist(), dtype=object) if group else None
            for lo in range(0, len(qids), _QUERY_BLOCK):
                s = np.round(qmat[lo:lo + _QUERY_BLOCK] @ d.T, SCORE_DECIMALS)
                if group:
                    s = np.where(qgroups[lo:lo + _QUERY_BLOCK, None] == own[None, :], s, -np.inf)
                for m in range(score.shape[1]):
                    t, i = score[lo:lo + _QUERY_BLOCK, m, None], ids[lo:lo + _QUERY_BLOCK, m, None]
                    before[lo:lo + _QUERY_BLOCK, m] += ((s > t) | ((s == t) & (did[None, :] < i))).sum(axis=1)
        some = ~np.isnan(score)
        yield pa.record_batch({"query_id": pa.array(np.broadcast_to(qids[:, None], score.shape)[some], pa.int64()),
                               "doc_id": pa.array(ids[some], pa.int64()), "n": pa.array(before[some], pa.int64())})
    return run


def vector_ranks(docs: DataFrame, queries: DataFrame, hits: DataFrame, *, doc_id: str = "doc_id", doc_vec: str = "embedding",
                 query_id: str = "query_id", query_vec: str = "embedding", group: str | None = None) -> DataFrame:
    """(query_id, doc_id, vec_rank): 1 + the documents before each hit (query_id, doc_id, vec_score), by score, then id.

    A scan per chunk of queries counts against the hits' scores; a task gives one number a hit, no scores are sorted.
    """
    gcol = [F.col(group).cast("string").alias(group)] if group else []
    d = docs.select(F.col(doc_id).cast("long").alias(doc_id), F.col(doc_vec).alias(doc_vec), *gcol)
    marks = hits.groupBy(F.col("query_id").cast("long").alias("query_id")).agg(F.collect_list(F.struct("vec_score", "doc_id")).alias("marks"))
    out = None
    for chunk in _query_chunks(queries, query_id, query_vec, group):
        rows = chunk.where(F.col("vec").isNotNull()).join(marks, "query_id").collect()      # bounded by MAX_QUERY_ROWS
        if not rows:
            continue
        most = max(len(r["marks"]) for r in rows)
        score, ids = np.full((len(rows), most), np.nan), np.zeros((len(rows), most), dtype=np.int64)
        for i, r in enumerate(rows):
            score[i, :len(r["marks"])], ids[i, :len(r["marks"])] = [m[0] for m in r["marks"]], [m[1] for m in r["marks"]]
        sent = docs.sparkSession.sparkContext.broadcast((
            np.array([r["query_id"] for r in rows], dtype=np.int64), _unit_rows(np.asarray([r["vec"] for r in rows], dtype=np.float64)),
            np.array([r["grp"] for r in rows], dtype=object), score, ids))
        counted = d.mapInArrow(_ranks_fn(sent, doc_id, doc_vec, group), "query_id long, doc_id long, n long")
        one = cut_lineage(counted.groupBy("query_id", "doc_id").agg((F.sum("n") + 1).alias("vec_rank")))
        sent.destroy()
        out = one if out is None else out.unionByName(one)
    return out if out is not None else docs.sparkSession.createDataFrame([], "query_id long, doc_id long, vec_rank long")


def cosine(a: Column | str, b: Column | str) -> Column:
    """Native cosine similarity of two numeric arrays (stays in codegen)."""
    a = F.col(a) if isinstance(a, str) else a
    b = F.col(b) if isinstance(b, str) else b
    dot = F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")),
                      F.lit(0.0), lambda acc, x: acc + x)
    na = F.sqrt(F.aggregate(a, F.lit(0.0), lambda acc, x: acc + x.cast("double") * x.cast("double")))
    nb = F.sqrt(F.aggregate(b, F.lit(0.0), lambda acc, x: acc + x.cast("double") * x.cast("double")))
    return F.when((na == 0) | (nb == 0), F.lit(0.0)).otherwise(dot / (na * nb))


# ---- V1 / V2: embedding plug-in -------------------------------------------

def hashing_embedder(dim: int = 64):
    """Deterministic stand-in model: signed feature hashing of tokens, unit norm.

    Returns a ``make_predict_fn`` for ``predict_batch_udf``; a real model is
    any loader with the same shape (called once per Python worker).
    """
    def make_predict_fn():
        import re
        import zlib
        words = re.compile(r"\w+", re.UNICODE).findall

        def predict(texts: np.ndarray) -> np.ndarray:
            found = [words(str(t).lower()) for t in texts]
            h = np.array([zlib.crc32(w.encode("utf-8")) for ws in found for w in ws], dtype=np.int64)
            cell = np.repeat(np.arange(len(found)), [len(ws) for ws in found]) * dim + h % dim
            signs = np.where(h >> 16 & 1, 1.0, -1.0)
            out = np.bincount(cell, weights=signs, minlength=len(found) * dim).reshape(len(found), dim).astype(np.float32)
            n = np.linalg.norm(out, axis=1, keepdims=True)
            n[n == 0] = 1.0
            return out / n
        return predict
    return make_predict_fn


def embed(df: DataFrame, text: str = "text", out: str = "embedding", model=None,
          batch_size: int = 64, dim: int = 64) -> DataFrame:
    """V1: add an embedding column with a batch model (Arrow batches, model loaded once per worker).

    The model gets ``batch_size`` texts at a time and gives a matrix, a row a text; only texts and vectors go to and from
    Python, as Arrow columns."""
    token, make = resolve(model if model is not None else hashing_embedder(dim))

    @F.arrow_udf(T.ArrayType(T.FloatType()))
    def embedded(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for b in batches:
            texts = np.array([*b.to_pylist(), None], dtype=object)[:-1]
            parts = [pa.array([], pa.list_(pa.float32()))]
            for at in range(0, len(texts), batch_size):
                got = np.asarray(worker_model(token, make)(texts[at:at + batch_size]), dtype=np.float32)
                n = len(texts[at:at + batch_size])
                if got.ndim != 2 or len(got) != n:
                    raise ValueError(f"vectors of shape {got.shape} for {n} texts")
                parts.append(pa.ListArray.from_arrays(pa.array(np.arange(n + 1) * got.shape[1], pa.int32()), pa.array(got.ravel(), pa.float32())))
            yield pa.concat_arrays(parts)
    return df.withColumn(out, embedded(F.col(text)))


def pair_cosine(pairs: DataFrame, doc_vec: str, query_vec: str, out: str = "vec_score") -> DataFrame:
    """Cosine of the two vectors of every row, vectorised per Arrow batch; both columns are dropped.

    Rows without one of the vectors get null.  Scores are rounded like the rest of the search.
    """
    keep = [f for f in pairs.schema.fields if f.name not in (doc_vec, query_vec)]
    schema = T.StructType(keep + [T.StructField(out, T.DoubleType(), True)])
    names = [f.name for f in keep]

    def run(batches):
        for b in batches:
            dv, qv = b.column(doc_vec), b.column(query_vec)
            ok = np.asarray(pc.and_(pc.is_valid(dv), pc.is_valid(qv)).to_numpy(zero_copy_only=False), dtype=bool)
            res = np.full(b.num_rows, np.nan)
            if ok.any():
                d, q = (_unit_rows(_to_matrix(x.filter(pa.array(ok)))) for x in (dv, qv))
                res[ok] = np.round(np.einsum("ij,ij->i", d, q), SCORE_DECIMALS)
            col = pa.array(res, pa.float64(), mask=~ok)
            yield pa.RecordBatch.from_arrays([b.column(n) for n in names] + [col],
                                             schema=pa.schema([(n, b.schema.field(n).type) for n in names]
                                                              + [(out, pa.float64())]))
    return pairs.mapInArrow(run, schema)
