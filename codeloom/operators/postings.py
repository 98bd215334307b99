"""V3/V6 stored postings: keyword search that reads no text after the collection is indexed.

``PostingsIndex`` keeps three tables under a path, appended to snapshot by snapshot:

* ``postings``: (grp, term, block, doc_id, tf, dl), partitioned by a hash bucket of the term, sorted by
  term and block; tf and dl are arrays over the fields.  A block of a term is the documents with
  like frequency and length (powers of two), so a block's best contribution is close to all of its.
* ``blocks``: (grp, term, block, n, max_tf, min_dl), what bounds a block's contributions whatever the
  statistics and boosts are at query time.
* ``stats``: documents and summed lengths per collection.

A batch of queries reads the buckets of its terms.  Scores are first made for the documents in each query's
best blocks; their k-th best score T is a lower end.  With a query's terms in the order of their largest
contribution, a document whose last term in that order is t, in block b, scores at most the sum of the earlier
terms' largest contributions plus b's: blocks for which that is below T are skipped, the documents of the others
are candidates and scored fully.  So long lists of common terms are only looked up for candidates, or, where most
blocks are needed, read once.  The result is that of ``bm25f`` over the same documents.

Queries go in chunks of bounded bytes.  Documents are told apart by (collection, id): an id appended twice to
one collection is two documents' worth of statistics, as in an append-only collection (S4).  Null ids take no part.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.sizing import exchanged, fits_bytes, spread
from ..session import cut_lineage, ensure_checkpoint_dir
from .keyword import B, K1, idf, normalised, posting_rows, query_terms, term_rows
from .ranking import rounded, top_k

BUCKETS = 64
CHUNK_BYTES = 16 << 20      # of query terms handled at once
SEED_DOCS = 16              # postings per wanted hit behind the first lower end
LOOKED_UP = 50              # postings a candidate's lookup costs: fewer needed ones than this share are looked up, else all are read
_ROUNDING = 2e-6            # scores are ranked at 6 places
_POSTING = "grp string, term string, block int, doc_id long, tf array<long>, dl array<int>, tb int"
_BLOCK = "grp string, term string, block int, n long, max_tf array<long>, min_dl array<int>, tb int"
_STATS = "grp string, n_docs long, sum_dl array<long>"


def _bucket(term: str = "term"):
    return F.pmod(F.xxhash64(term), F.lit(BUCKETS)).cast("int")


class PostingsIndex:
    def __init__(self, spark: SparkSession, path: str, fields: Sequence[str]):
        self.spark, self.path, self.fields = spark, path, list(fields)

    @classmethod
    def build(cls, docs: DataFrame, fields: Sequence[str], *, doc_id: str = "doc_id", by: str | None = None, path: str | None = None) -> PostingsIndex:
        """An index of ``docs`` over these text columns."""
        index = cls(docs.sparkSession, path or f"{ensure_checkpoint_dir(docs.sparkSession)}/postings-{uuid.uuid4().hex}", fields)
        index.append(docs, doc_id=doc_id, by=by)
        return index

    def append(self, docs: DataFrame, *, doc_id: str = "doc_id", by: str | None = None) -> None:
        """Index more documents; only new files are written."""
        nf = len(self.fields)
        g = F.coalesce(F.col(by).cast("string"), F.lit("")) if by else F.lit("")
        d = docs.where(F.col(doc_id).isNotNull()).select(g.alias("grp"), F.col(doc_id).cast("long").alias("doc_id"), *self.fields)
        rows = cut_lineage(term_rows(spread(d), self.fields, "doc_id", ["grp"]))
        level = lambda c: F.floor(F.log2(F.greatest(F.lit(1), F.aggregate(c, F.lit(0).cast("long"), lambda a, x: a + x))))
        postings = posting_rows(rows, nf).withColumns({"block": (level("tf") * 64 + level("dl")).cast("int"), "tb": _bucket()})
        # Terms are dealt by bucket and document, so a term that a third of all documents hold is many files.
        n = self.spark.sparkContext.defaultParallelism
        dealt = postings.repartition(n, "tb", F.pmod(F.xxhash64("doc_id"), F.lit(n))).sortWithinPartitions("tb", "term", "block")
        dealt.select("grp", "term", "block", "doc_id", "tf", "dl", "tb").write.mode("append").partitionBy("tb").parquet(f"{self.path}/postings")
        (postings.groupBy("grp", "tb", "term", "block")
         .agg(F.count("*").alias("n"), F.array(*[F.max(F.get("tf", F.lit(i))) for i in range(nf)]).alias("max_tf"),
              F.array(*[F.min(F.get("dl", F.lit(i))) for i in range(nf)]).alias("min_dl"))
         .repartition(n, "tb").write.mode("append").partitionBy("tb").parquet(f"{self.path}/blocks"))
        (rows.groupBy("grp")
         .agg(F.count("*").alias("n_docs"), F.array(*[F.sum(F.get("dl", F.lit(i)).cast("long")) for i in range(nf)]).alias("sum_dl"))
         .write.mode("append").parquet(f"{self.path}/stats"))

    def _read(self, name: str, schema: str) -> DataFrame:
        return self.spark.read.schema(schema).parquet(f"{self.path}/{name}")

    def _stats(self) -> DataFrame:
        nf = len(self.fields)
        sums = self._read("stats", _STATS).groupBy("grp").agg(F.sum("n_docs").alias("n_docs"), *[F.sum(F.get("sum_dl", F.lit(i))).alias(f"s{i}") for i in range(nf)])
        return sums.select("grp", "n_docs", F.array(*[F.col(f"s{i}") / F.col("n_docs") for i in range(nf)]).alias("avgdl"))

    def _weights(self, qt: DataFrame, buckets: list[int], boosts: Sequence[float], k1: float, b: float) -> DataFrame:
        """(query_id, grp, term, block, n, w, ub): every block of a query's terms, the term's weight and the block's best contribution."""
        blocks = (self._read("blocks", _BLOCK).where(F.col("tb").isin(buckets)).join(F.broadcast(qt.select("grp", "term").distinct()), ["grp", "term"], "left_semi")
                  .groupBy("grp", "term", "block")       # a block may have been appended to
                  .agg(F.sum("n").alias("n"), *[F.max(F.get("max_tf", F.lit(i))).alias(f"t{i}") for i in range(len(boosts))],
                       *[F.min(F.get("min_dl", F.lit(i))).alias(f"d{i}") for i in range(len(boosts))])
                  .join(self._stats(), "grp"))
        many = range(len(boosts))
        x = normalised(F.array(*[F.col(f"t{i}") for i in many]), F.array(*[F.col(f"d{i}") for i in many]), F.col("avgdl"), boosts, b)
        blocks = blocks.withColumn("best", x * (k1 + 1) / (x + k1))
        whole = blocks.groupBy("grp", "term").agg(F.sum("n").alias("df"), F.first("n_docs").alias("n_docs"))
        w = qt.join(whole, ["grp", "term"]).select("query_id", "grp", "term", (F.col("qtf") * idf(F.col("n_docs"), F.col("df"))).alias("w"))
        return cut_lineage(w.join(blocks.select("grp", "term", "block", "n", "best", "avgdl"), ["grp", "term"]).withColumn("ub", F.col("w") * F.col("best")))

    @staticmethod
    def _pairs(matched: DataFrame, chosen: DataFrame) -> DataFrame:
        """(query_id, grp, doc_id): the documents in the chosen blocks (query_id, grp, term, block)."""
        return matched.select("grp", "term", "block", "doc_id").join(chosen, ["grp", "term", "block"]).select("query_id", "grp", "doc_id").distinct()

    @staticmethod
    def _scores(pairs: DataFrame, matched: DataFrame, weights: DataFrame, boosts: Sequence[float], k1: float, b: float) -> DataFrame:
        """(query_id, doc_id, kw_score) of these pairs, over all of the query's terms."""
        terms = weights.select("query_id", "grp", "term", "w", "avgdl").distinct()
        x = normalised("tf", "dl", F.col("avgdl"), boosts, b)
        return (pairs.join(matched, ["grp", "doc_id"]).join(F.broadcast(terms), ["query_id", "grp", "term"])
                .groupBy("query_id", "doc_id").agg(F.sum(F.col("w") * x * (k1 + 1) / (x + k1)).alias("kw_score")))

    @staticmethod
    def _all_scores(needed: DataFrame, matched: DataFrame, weights: DataFrame, boosts: Sequence[float], k1: float, b: float) -> DataFrame:
        """``_scores`` of the documents in the needed blocks, by one pass over all postings of the queries' terms, where they lie."""
        marked = weights.select("query_id", "grp", "term", "block", "w", "avgdl").join(
            needed.select("query_id", "grp", "term", "block", F.lit(True).alias("need")), ["query_id", "grp", "term", "block"], "left")
        marked = cut_lineage(marked)
        sent = F.broadcast(marked) if fits_bytes(marked, ["grp", "term"]) else exchanged(marked)
        x = normalised("tf", "dl", F.col("avgdl"), boosts, b)
        return (matched.join(sent, ["grp", "term", "block"])
                .groupBy("query_id", "doc_id").agg(F.sum(F.col("w") * x * (k1 + 1) / (x + k1)).alias("kw_score"), F.max("need").alias("need"))
                .where("need").drop("need"))

    @staticmethod
    def needed(weights: DataFrame, lower: DataFrame) -> DataFrame:
        """(query_id, grp, term, block, n): the blocks whose documents may reach the query's lower end ``t`` (null: all)."""
        terms = weights.groupBy("query_id", "term").agg(F.max("ub").alias("top"))
        order = Window.partitionBy("query_id").orderBy("top", "term")          # a query's terms
        before = F.coalesce(F.sum("top").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
        placed = terms.select("query_id", "term", before.alias("before"))
        return (weights.join(placed, ["query_id", "term"]).join(lower, "query_id", "left")
                .where(F.col("t").isNull() | (F.col("before") + F.col("ub") >= F.col("t") - _ROUNDING))
                .select("query_id", "grp", "term", "block", "n"))

    def topk(self, queries: DataFrame, k: int, *, query_id: str = "query_id", query_text: str = "text", by: str | None = None,
             boosts: Sequence[float] | None = None, k1: float = K1, b: float = B, skipped: list | None = None) -> DataFrame:
        """(query_id, rank, doc_id, score): the k best documents of each query's collection.

        ``skipped`` receives (postings of the queries' terms, postings in needed blocks) per chunk.
        """
        boosts = list(boosts or [1.0] * len(self.fields))
        g = F.coalesce(F.col(by).cast("string"), F.lit("")) if by else F.lit("")
        q = queries.select(F.col(query_id).cast("long").alias("query_id"), g.alias("grp"), F.col(query_text).alias("text"))
        all_terms = cut_lineage(query_terms(q, "query_id", "text", ["grp"]))
        size = all_terms.agg(F.sum(F.octet_length("term").cast("long") + 64)).first()[0] or 0
        chunks, out = max(1, -(-size // CHUNK_BYTES)), None
        for c in range(chunks):
            qt = all_terms.where(F.pmod(F.xxhash64("query_id"), F.lit(chunks)) == c)
            one = self._chunk(qt, k, boosts, k1, b, skipped)
            out = one if out is None else out.unionByName(one)
        return out

    def _chunk(self, qt: DataFrame, k: int, boosts: list[float], k1: float, b: float, skipped: list | None) -> DataFrame:
        buckets = sorted(r[0] for r in qt.select(_bucket().alias("tb")).distinct().collect())       # at most BUCKETS
        weights = self._weights(qt, buckets, boosts, k1, b)
        vocabulary = F.broadcast(qt.select("grp", "term").distinct())
        matched = cut_lineage(self._read("postings", _POSTING).where(F.col("tb").isin(buckets)).join(vocabulary, ["grp", "term"], "left_semi")
                              .drop("tb").repartition("doc_id"))
        # First lower end: full scores of the documents in each query's best blocks.
        best = Window.partitionBy("query_id").orderBy(F.desc("ub"), "term", "block")
        seeds = (weights.withColumn("have", F.coalesce(F.sum("n").over(best.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
                 .where(F.col("have") < SEED_DOCS * k).select("query_id", "grp", "term", "block"))
        known = cut_lineage(self._scores(self._pairs(matched, seeds), matched, weights, boosts, k1, b).withColumn("score", rounded("kw_score")))
        lower = top_k(known, ["query_id"], "score", ["doc_id"], k).where(F.col("rank") == k).select("query_id", F.col("score").alias("t"))
        needed = cut_lineage(self.needed(weights, lower))
        held, read = weights.agg(F.sum("n")).first()[0] or 0, needed.agg(F.sum("n")).first()[0] or 0
        if skipped is not None:
            skipped.append((held, read))
        if read * LOOKED_UP > held:
            scored = self._all_scores(needed, matched, weights, boosts, k1, b)
        else:
            scored = self._scores(self._pairs(matched, needed.drop("n")), matched, weights, boosts, k1, b)
        scored = scored.withColumn("score", rounded("kw_score"))
        return cut_lineage(top_k(scored, ["query_id"], "score", ["doc_id"], k).select("query_id", "rank", "doc_id", "score"))

    def drop(self) -> None:
        """Delete the stored index."""
        p = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
