"""Search queries over documents (as the snippet collection) and benchmark (as issues)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.keyword import bm25, bm25_fields, bm25f
from ..operators.ranking import rounded, top_k
from ..sources.tables import table

LIMIT = 10


def bm25_topk(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents")
    issues = table(spark, sf, "benchmark")
    s = bm25(docs, issues, doc_id="doc_id", query_id="item_id")
    s = s.withColumn("score", rounded("kw_score"))
    return (top_k(s, ["item_id"], "score", ["doc_id"], LIMIT)
            .select("item_id", "rank", "doc_id", "score"))


# Fields of a document searched together, with their boosts: its first line as a title, and the whole.
FIELDS = {"title": 2.0, "text": 1.0}


def bm25_fields_topk(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents").select("doc_id", "text", F.substring_index("text", "\n", 1).alias("title"))
    issues = table(spark, sf, "benchmark")
    s = bm25_fields(docs, issues, FIELDS, doc_id="doc_id", query_id="item_id")
    s = s.withColumn("score", rounded("kw_score"))
    return (top_k(s, ["item_id"], "score", ["doc_id"], LIMIT)
            .select("item_id", "rank", "doc_id", "score"))


def bm25f_topk(spark: SparkSession, sf: str) -> DataFrame:
    """As ``bm25_fields_topk``, but the fields' frequencies are weighed and added before they saturate (BM25F)."""
    docs = table(spark, sf, "documents").select("doc_id", "text", F.substring_index("text", "\n", 1).alias("title"))
    s = bm25f(docs, table(spark, sf, "benchmark"), FIELDS, doc_id="doc_id", query_id="item_id")
    return (top_k(s.withColumn("score", rounded("kw_score")), ["item_id"], "score", ["doc_id"], LIMIT)
            .select("item_id", "rank", "doc_id", "score"))


def bm25_stored_topk(spark: SparkSession, sf: str) -> DataFrame:
    """The rows of ``bm25_topk`` out of a postings index that the collection was appended to in two snapshots."""
    from ..operators.postings import PostingsIndex
    docs = table(spark, sf, "documents").select("doc_id", "text")
    index = PostingsIndex.build(docs.where("doc_id % 2 = 0"), ["text"])
    index.append(docs.where("doc_id % 2 <> 0"))
    top = index.topk(table(spark, sf, "benchmark"), LIMIT, query_id="item_id")
    index.drop()
    return top.withColumnRenamed("query_id", "item_id")


def _vectors(spark, sf):
    return table(spark, sf, "embeddings").select("vec_id", "embedding")


def vector_topk(spark: SparkSession, sf: str) -> DataFrame:
    from ..operators.vector import vector_topk as vt
    docs = table(spark, sf, "documents").select("doc_id")
    issues = table(spark, sf, "benchmark").select("item_id")
    vec = _vectors(spark, sf)
    dv = vec.join(docs, vec.vec_id == docs.doc_id, "left_semi").select(F.col("vec_id").alias("doc_id"), "embedding")
    qv = vec.join(issues, vec.vec_id == issues.item_id, "left_semi").select(F.col("vec_id").alias("item_id"), "embedding")
    top, _ = vt(dv, qv, LIMIT, doc_id="doc_id", doc_vec="embedding", query_id="item_id", query_vec="embedding")
    return top.select(F.col("query_id").alias("item_id"), F.col("vec_rank").alias("rank"),
                      "doc_id", F.col("vec_score").alias("score"))


def vector_topk_indexed(spark: SparkSession, sf: str) -> DataFrame:
    """The rows of ``vector_topk`` out of a vector index built over the collection."""
    from ..operators.vector_index import VectorIndex
    from ..session import cut_lineage
    docs = table(spark, sf, "documents").select("doc_id")
    issues = table(spark, sf, "benchmark").select("item_id")
    vec = _vectors(spark, sf)
    dv = vec.join(docs, vec.vec_id == docs.doc_id, "left_semi").select(F.col("vec_id").alias("doc_id"), "embedding")
    qv = vec.join(issues, vec.vec_id == issues.item_id, "left_semi").select(F.col("vec_id").alias("item_id"), "embedding")
    index = VectorIndex.build(dv)
    top = cut_lineage(index.topk(qv, LIMIT, query_id="item_id"))
    index.drop()
    return top.select(F.col("query_id").alias("item_id"), F.col("vec_rank").alias("rank"), "doc_id", F.col("vec_score").alias("score"))


def hybrid_topk(spark: SparkSession, sf: str) -> DataFrame:
    from ..operators.hybrid import hybrid
    docs = table(spark, sf, "documents")
    issues = table(spark, sf, "benchmark")
    vec = _vectors(spark, sf)
    h = hybrid(docs, issues, doc_id="doc_id", query_id="item_id", doc_vectors=vec, query_vectors=vec, ranks=True)
    return h.withColumnRenamed("query_id", "item_id")


def doc_snippets(spark: SparkSession, sf: str) -> DataFrame:
    """documents seen as a snippet collection: type = source, file = lang folder, name = doc tag."""
    d = table(spark, sf, "documents")
    return d.select("doc_id", "text", F.col("source").alias("type"),
                    F.concat(F.col("lang"), F.lit("/doc_"), F.col("doc_id").cast("string"), F.lit(".txt")).alias("file"),
                    F.concat(F.lit("doc_"), F.col("doc_id").cast("string")).alias("name"))


# The snippet types kept after the top-k (the reference keeps
# its two code types; here the documents' sources play that role).
KEPT_TYPES = ("src0", "src1", "src2", "src3", "src4", "src5", "src6", "src7", "src8", "src9")


def hybrid_typed_hits(spark: SparkSession, sf: str) -> DataFrame:
    """Keyword-only hybrid (no model, V10), type filter after top-k, hit projection, empty issues kept."""
    from ..operators.hybrid import hybrid, typed_hits
    snippets = doc_snippets(spark, sf)
    issues = table(spark, sf, "benchmark")
    h = hybrid(snippets, issues, doc_id="doc_id", query_id="item_id")
    return typed_hits(h, snippets, issues, "item_id", KEPT_TYPES)
