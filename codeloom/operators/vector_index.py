"""V4 vector index: inverted lists with compressed vectors, exact re-rank.

* **Lists.**  Centroids come from a spherical k-means over a bounded, hash-chosen sample (FIT_ROWS);
  every vector is assigned to its nearest centroid.  Lists are the partitions of the stored table.
* **Codes.**  A row holds 8 bits a component, a scale, and the length of what the code leaves out, so the
  distance between the code's score and the true cosine is known.  The full vectors are a second table,
  read for candidates only.
* **Search.**  Queries go in chunks of bounded bytes, one after another; codes are scored where they are
  stored.  The lists nearest to a query give its first k-th best score; of the other lists those are read
  that can still reach it, by the angle between query and centroid and the largest angle in the list.
  Rows that can still be among the k best by their code are candidates; their exact cosines are ranked.
  The result is that of ``vector_topk``; ``probes`` stops after so many lists instead (approximate).
* **Snapshots.**  ``append`` writes new files only; collections (``by``) share centroids, and a query
  sees its own collection.

Equal vectors: of those only the k smallest ids of a stored batch can be among the k best, the others are
left out before scoring, so a vector that a third of all rows share costs no more output than another.
Null ids and null vectors take no part; a zero vector has cosine 0 with everything.
"""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import cut_lineage, ensure_checkpoint_dir
from .ranking import top_k
from .vector import _to_matrix, _unit_rows, pair_cosine

FIT_ROWS = 8_192            # vectors the centroids are fitted on, in expectation
MAX_LISTS = 4_096
CHUNK_BYTES = 8 << 20       # of query vectors sent to the tasks at once
SEEDS = 2                   # nearest lists that give a query its first k-th best score
_SLACK = 1e-5               # above the rounding of 32-bit products and of 6-place scores
_CODES = "grp string, doc_id long, h long, code binary, scale double, rest double, angle double, list int, vec array<double>"
_FOUND = "query_id long, grp string, doc_id long, list int, low double, high double"


def centroids_of(sample: np.ndarray, n: int, rounds: int = 10, seed: int = 11) -> np.ndarray:
    """n unit centroids of the sample's directions (spherical k-means)."""
    x = _unit_rows(np.asarray(sample, dtype=np.float64))
    x = x[np.linalg.norm(x, axis=1) > 0]
    if not len(x):
        return np.eye(1, sample.shape[1] if sample.ndim == 2 and sample.shape[1] else 1)
    c = x[np.random.default_rng(seed).choice(len(x), min(n, len(x)), replace=False)]
    for _ in range(rounds):
        own = (x @ c.T).argmax(axis=1)
        total = np.zeros_like(c)
        np.add.at(total, own, x)
        size = np.linalg.norm(total, axis=1)
        c = np.where((size > 1e-9)[:, None], total / np.maximum(size, 1e-9)[:, None], c)
    return c


def _assign(centroids: np.ndarray):
    def run(batches):
        for batch in batches:
            unit = _unit_rows(_to_matrix(batch["vec"]))
            if not len(unit):
                continue
            scale = np.abs(unit).max(axis=1)
            code = np.round(unit / np.where(scale > 0, scale, 1)[:, None] * 127).astype(np.int8)
            rest = np.linalg.norm(unit - code * (scale / 127)[:, None], axis=1)
            near = np.clip(unit @ centroids.T, -1, 1)
            own = near.argmax(axis=1)
            # No angle bounds the cosine of a zero vector: its list is always read.
            angle = np.where(scale > 0, np.arccos(near[np.arange(len(unit)), own]), np.pi)
            yield pa.record_batch({
                "grp": batch["grp"], "doc_id": batch["doc_id"], "h": batch["h"], "code": pa.array([x.tobytes() for x in code], pa.binary()),
                "scale": pa.array(scale), "rest": pa.array(rest), "angle": pa.array(angle), "list": pa.array(own.astype(np.int32)), "vec": batch["vec"]})
    return run


def _scan(sent, k: int):
    """Candidates of a chunk's queries among the task's codes."""
    def run(batches):
        ids, groups, q, wanted, floor = sent.value
        n, q32 = len(ids), q.astype(np.float32)
        best = np.full((n, k), -np.inf)                          # the k best lower bounds so far
        best[:, 0] = floor
        floor = floor.copy()
        for batch in batches:
            if not batch.num_rows:
                continue
            lists, grp = batch["list"].to_numpy(), np.array(batch["grp"].to_pylist(), dtype=object)
            doc, h = batch["doc_id"].to_numpy(), batch["h"].to_numpy()
            # Of equal vectors the k smallest ids.
            order = np.lexsort((doc, h, lists))
            same = np.concatenate([[False], (h[order][1:] == h[order][:-1]) & (lists[order][1:] == lists[order][:-1]) & (grp[order][1:] == grp[order][:-1])])
            place = np.arange(len(order)) - np.maximum.accumulate(np.where(same, 0, np.arange(len(order))))
            rows = order[place < k]
            code = np.frombuffer(b"".join(batch["code"].take(pa.array(rows)).to_pylist()), np.int8).reshape(len(rows), -1).astype(np.float32)
            scale, rest = (batch[c].to_numpy()[rows] for c in ("scale", "rest"))
            key = np.array([f"{a}\0{b}" for a, b in zip(lists[rows], grp[rows], strict=True)])
            for name in np.unique(key):
                at = np.flatnonzero(key == name)
                which = int(lists[rows[at[0]]])
                asked = np.flatnonzero(wanted[:, which] & (groups == grp[rows[at[0]]]))
                for a in range(0, len(asked), 256):
                    qi = asked[a:a + 256]
                    s = (q32[qi] @ code[at].T).astype(np.float64) * (scale[at] / 127)[None, :]
                    wide = rest[at][None, :] + _SLACK
                    low = s - wide
                    take = min(k, len(at))
                    merged = np.concatenate([best[qi], np.partition(low, len(at) - take, axis=1)[:, len(at) - take:]], axis=1)
                    best[qi] = -np.partition(-merged, k - 1, axis=1)[:, :k]
                    floor[qi] = np.maximum(floor[qi], best[qi].min(axis=1))
                    x, y = np.nonzero(s + wide >= floor[qi][:, None])
                    if len(x):
                        r = rows[at[y]]
                        yield pa.record_batch({
                            "query_id": pa.array(ids[qi[x]], pa.int64()), "grp": pa.array(grp[r].tolist(), pa.string()), "doc_id": pa.array(doc[r], pa.int64()),
                            "list": pa.array(lists[r], pa.int32()), "low": pa.array(low[x, y]), "high": pa.array((s + wide)[x, y])})
    return run


class VectorIndex:
    """An index stored under ``path``: ``codes`` and ``vectors`` partitioned by list, ``reach`` (largest angle a list), ``centroids``."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path
        # At most MAX_LISTS rows; none before the first vectors.
        rows = spark.read.schema("list int, centroid array<double>").parquet(f"{path}/centroids").orderBy("list").collect()
        self.centroids = np.array([r["centroid"] for r in rows], dtype=np.float64)

    @classmethod
    def build(cls, vectors: DataFrame, *, doc_id: str = "doc_id", vec: str = "embedding", by: str | None = None,
              path: str | None = None, lists: int | None = None) -> VectorIndex:
        """An index of ``vectors``; the number of lists defaults to half the root of their number."""
        spark = vectors.sparkSession
        path = path or f"{ensure_checkpoint_dir(spark)}/vector-index-{uuid.uuid4().hex}"
        v = vectors.where(F.col(vec).isNotNull() & F.col(doc_id).isNotNull())
        n = v.count()
        share = F.pmod(F.xxhash64(F.col(doc_id), F.lit(5)), F.lit(1 << 20)) < int((1 << 20) * min(1.0, FIT_ROWS / max(n, 1)))
        sample = v.where(share).select(F.col(vec).cast("array<double>").alias("vec")).toArrow()["vec"].to_pylist()
        c = centroids_of(np.array(sample, dtype=np.float64), min(MAX_LISTS, lists or max(1, round(n ** 0.5 / 2)))) if sample else []
        spark.createDataFrame([(i, [float(y) for y in r]) for i, r in enumerate(c)], "list int, centroid array<double>").coalesce(1).write.parquet(f"{path}/centroids")
        index = cls(spark, path)
        if sample:
            index.append(vectors, doc_id=doc_id, vec=vec, by=by)
        return index

    def append(self, vectors: DataFrame, *, doc_id: str = "doc_id", vec: str = "embedding", by: str | None = None) -> None:
        """Add vectors (a new snapshot, say) under the same centroids; only new files are written."""
        if not len(self.centroids):
            raise ValueError("an index built on no vectors has no lists; build it again")
        g = F.col(by).cast("string") if by else F.lit(None).cast("string")
        rows = (vectors.where(F.col(vec).isNotNull() & F.col(doc_id).isNotNull())
                .select(F.coalesce(g, F.lit("")).alias("grp"), F.col(doc_id).cast("long").alias("doc_id"), F.col(vec).cast("array<double>").alias("vec"))
                .withColumn("h", F.xxhash64("vec")))
        codes = cut_lineage(rows.mapInArrow(_assign(self.centroids), _CODES))
        # A list's rows are spread by a hash of the id, so a list that holds a third of all rows is many files.
        n = max(1, self.spark.sparkContext.defaultParallelism)
        spread = [F.col("list"), F.pmod(F.xxhash64("doc_id"), F.lit(n))]
        dealt = codes.drop("angle").repartition(n, *spread).sortWithinPartitions("list", "doc_id")
        dealt.drop("vec").write.mode("append").partitionBy("list").parquet(f"{self.path}/codes")
        dealt.select("grp", "doc_id", "vec", "list").write.mode("append").partitionBy("list").parquet(f"{self.path}/vectors")
        codes.groupBy("list").agg(F.max("angle").alias("angle")).coalesce(1).write.mode("append").parquet(f"{self.path}/reach")

    def _reach(self) -> np.ndarray:
        out = np.full(len(self.centroids), -1.0)                  # -1: an empty list
        for r in self.spark.read.parquet(f"{self.path}/reach").groupBy("list").agg(F.max("angle").alias("a")).collect():
            out[r["list"]] = r["a"]
        return out

    def _read(self, table: str, schema: str) -> DataFrame:
        return self.spark.read.schema(schema).parquet(f"{self.path}/{table}")

    def _found(self, chunk, wanted: np.ndarray, floor: np.ndarray, k: int) -> tuple[DataFrame, object]:
        ids, groups, q = chunk
        lists = np.flatnonzero(wanted.any(axis=0)).tolist()
        codes = self._read("codes", "grp string, doc_id long, h long, code binary, scale double, rest double, list int")
        sent = self.spark.sparkContext.broadcast((ids, groups, q, wanted, floor))
        return cut_lineage(codes.where(F.col("list").isin(lists)).mapInArrow(_scan(sent, k), _FOUND)), sent

    def _chunks(self, queries: DataFrame, query_id: str, query_vec: str, by: str | None):
        g = F.coalesce(F.col(by).cast("string"), F.lit("")) if by else F.lit("")
        q = queries.where(F.col(query_vec).isNotNull()).select(F.col(query_id).cast("long").alias("id"), g.alias("g"), F.col(query_vec).cast("array<double>").alias("v"))
        n = max(1, -(-q.count() * 8 * (self.centroids.shape[1] + len(self.centroids) // 8 + 1) // CHUNK_BYTES))
        for i in range(n):
            rows = q.where(F.pmod(F.xxhash64("id"), F.lit(n)) == i).toArrow()
            if rows.num_rows:
                yield rows["id"].to_numpy(), np.array(rows["g"].to_pylist(), dtype=object), _unit_rows(np.array(rows["v"].to_pylist(), dtype=np.float64))

    def _candidates(self, chunk, k: int, probes: int | None) -> DataFrame:
        """(query_id, grp, doc_id, list, low, high): what may be among the k best, each with its code's bounds."""
        ids, _, q = chunk
        reach = self._reach()
        angle = np.arccos(np.clip(q @ self.centroids.T, -1, 1))
        nearest = np.argsort(np.where(reach < 0, np.inf, angle), axis=1, kind="stable")[:, :probes or SEEDS]
        wanted = np.zeros(angle.shape, bool)
        np.put_along_axis(wanted, nearest, True, axis=1)
        wanted &= reach >= 0
        none = np.full(len(ids), -np.inf)
        found, sent = self._found(chunk, wanted, none, k)
        held = [sent]
        if probes is None:
            # One number a query of the chunk.
            kth = {r["query_id"]: r["t"] for r in self._kth(found, k).collect()}
            floor = np.array([kth.get(int(i), -np.inf) for i in ids])
            upper = np.where(reach >= np.pi - 1e-9, 1.0, np.cos(np.maximum(angle - np.maximum(reach, 0), 0)))
            more = (upper + _SLACK >= floor[:, None]) & (reach >= 0) & ~wanted
            if more.any():
                rest, sent = self._found(chunk, more, floor, k)
                held.append(sent)
                found = found.unionByName(rest)
        kth = self._kth(found, k)
        out = cut_lineage(found.join(kth, "query_id", "left").where(F.col("t").isNull() | (F.col("high") >= F.col("t"))).drop("t"))
        for b in held:
            b.destroy()
        return out

    @staticmethod
    def _kth(found: DataFrame, k: int) -> DataFrame:
        """(query_id, t): the k-th best lower bound where there are k."""
        best = top_k(found.select("query_id", "doc_id", "low"), ["query_id"], "low", ["doc_id"], k)
        return best.where(F.col("rank") == k).select("query_id", F.col("low").alias("t"))

    def candidates(self, queries: DataFrame, k: int, *, query_id: str = "query_id", query_vec: str = "embedding",
                   by: str | None = None, probes: int | None = None) -> DataFrame:
        """The candidates that ``topk`` compares exactly."""
        parts = [self._candidates(c, k, probes) for c in self._chunks(queries, query_id, query_vec, by)]
        out = self.spark.createDataFrame([], _FOUND) if not parts else parts[0]
        for p in parts[1:]:
            out = out.unionByName(p)
        return out

    def topk(self, queries: DataFrame, k: int, *, query_id: str = "query_id", query_vec: str = "embedding",
             by: str | None = None, probes: int | None = None) -> DataFrame:
        """(query_id, doc_id, vec_score, vec_rank): the k best of each query's collection, by cosine, ties to the smaller id."""
        if not len(self.centroids):
            return self.spark.createDataFrame([], "query_id long, doc_id long, vec_score double, vec_rank int")
        found = self.candidates(queries, k, query_id=query_id, query_vec=query_vec, by=by, probes=probes)
        vectors = self._read("vectors", "grp string, doc_id long, vec array<double>, list int")
        q = queries.select(F.col(query_id).cast("long").alias("query_id"), F.col(query_vec).cast("array<double>").alias("qvec"))
        pairs = found.select("query_id", "grp", "doc_id", "list").distinct().join(vectors, ["list", "grp", "doc_id"]).join(q, "query_id")
        scored = pair_cosine(pairs.select("query_id", "doc_id", "vec", "qvec"), "vec", "qvec")
        return top_k(scored, ["query_id"], "vec_score", ["doc_id"], k, "vec_rank")

    def drop(self) -> None:
        """Delete the stored index."""
        p = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
