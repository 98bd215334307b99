"""V5-V11 hybrid search: relative-score fusion of the keyword and vector legs.

fused = alpha * scaled(vector) + (1 - alpha) * scaled(keyword), each leg
min-max scaled per query over its candidates (a missing leg counts 0; if a
leg's max equals its min, its scaled score is 1).

Exactness without a query x document product: the keyword leg's candidates
are all matching documents; the vector leg's min/max come from the partial
aggregates of the full scan.  Fused scores are rounded before they are ranked,
so the vector neighbours kept are the DEPTH best and all rows so close below
them that rounding could tie them (of one vector score, the DEPTH smallest
ids).  A document that is neither a keyword candidate nor kept has DEPTH
documents that rank before it.  The kept rows' fused scores are known
exactly, and their k-th best T bounds the true one from below; another keyword
candidate has vector score at most the DEPTH-th best v, so it is scored exactly
(an equi join to its vector) only if a * scaled(v) + (1 - a) * scaled(kw) can
still reach T.  The depth is a constant: it steers cost, never the result.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.sizing import exchanged, fits
from ..session import cut_lineage
from . import fused
from .keyword import bm25f
from .ranking import rounded, top_k
from .vector import pair_cosine, vector_ranks, vector_topk
from .vector_index import VectorIndex

ALPHA = 0.7
LIMIT = 10
# Depth of the fully scored vector neighbours behind the pruning bound (at least k).
DEPTH = 32
# Vector scores this close below the DEPTH-th could tie with it once the fused score is rounded to
# 6 places: alpha * difference / (max - min) < 1e-6, max - min <= 2.
def _tie_margin(alpha: float) -> float:
    return 2 * 1.5e-6 / alpha + 1e-6 if alpha > 0 else 0.0


# Hits (ids and scores, under 100 bytes each) sent to the snippet table at most.
HITS_SENT = 200_000
# Queries whose limits or thresholds (a few hundred bytes each) are sent to the pairs at most.
MARKED_QUERIES = 200_000
# Groups of documents a wanted hit whose best scores bound the keyword hits from below.
PARTS = 16
# Safety margin of the pruning bound, well above the 1e-6 score rounding.
PRUNE_MARGIN = 1e-3


def _scaled(x: str, lo: str, hi: str) -> Column:
    return (F.when(F.col(x).isNull(), F.lit(0.0))
            .when(F.col(hi) == F.col(lo), F.lit(1.0))
            .otherwise((F.col(x) - F.col(lo)) / (F.col(hi) - F.col(lo))))


def _near(vt: DataFrame) -> DataFrame:
    """(doc_id, near): the vector neighbours by document, query id -> score."""
    once = vt.groupBy("doc_id", "query_id").agg(F.max("vec_score").alias("vec_score"))
    return once.groupBy("doc_id").agg(F.map_from_entries(F.collect_list(F.struct("query_id", "vec_score"))).alias("near"))


def _leg_ranks(hits: DataFrame, kw: DataFrame, k: int) -> DataFrame:
    """(query_id, doc_id, kw_rank): 1 + the keyword candidates before each hit, counted against at most k thresholds a query.

    Counts are summed where the pairs lie; no leg is sorted.
    """
    marks = (hits.where(F.col("kw_score").isNotNull()).groupBy("query_id")
             .agg(F.collect_list(F.struct("kw_score", "doc_id")).alias("marks")))
    # Only plain numbers go to the pairs, so the counts are one hash aggregation.
    ends = marks.select("query_id", *[F.get("marks", F.lit(i))[c].alias(f"{c}_{i}") for i in range(k) for c in ("kw_score", "doc_id")])
    sent = F.broadcast(ends) if fits(marks, MARKED_QUERIES) else ends
    before = [F.count_if((F.col("kw_score") > F.col(f"kw_score_{i}")) | ((F.col("kw_score") == F.col(f"kw_score_{i}")) & (F.col("doc_id") < F.col(f"doc_id_{i}"))))
              for i in range(k)]
    counted = kw.join(sent, "query_id").groupBy("query_id").agg(*[n.alias(f"n_{i}") for i, n in enumerate(before)])
    counts = marks.join(counted, "query_id").select("query_id", "marks", F.array(*[f"n_{i}" for i in range(k)]).alias("n"))
    each = counts.select("query_id", F.explode(F.arrays_zip("marks", F.slice("n", 1, F.size("marks")))).alias("e"))
    return each.select("query_id", F.col("e.marks.doc_id").alias("doc_id"), (F.col("e.1") + 1).alias("kw_rank"))


def _query_vectors(queries: DataFrame, query_vectors: DataFrame, query_id: str, vec_id: str, vec: str, g: list[str]) -> DataFrame:
    """(query_id, qvec, collection...) of the queries that have a vector row."""
    return (query_vectors.select(F.col(vec_id).cast("long").alias("query_id"), F.col(vec).alias("qvec"))
            .join(queries.select(F.col(query_id).cast("long").alias("query_id"), *g), "query_id", "inner" if g else "left_semi"))


HIT = ("query_id", "rank", "doc_id", "score", "kw_score", "kw_scaled", "vec_score", "vec_scaled")


def _fused_top(cand: DataFrame, a: float, k: int) -> DataFrame:
    """HIT rows of the k best candidates (query_id, doc_id, scores and ranges of both legs) of each query."""
    k_s = _scaled("kw_score", "kw_min", "kw_max")
    v_s = _scaled("vec_score", "vec_min", "vec_max")
    scored = (cand
              .withColumn("kw_scaled", F.when(F.col("kw_score").isNotNull(), rounded(k_s)))
              .withColumn("vec_scaled", F.when(F.col("vec_score").isNotNull(), rounded(v_s)))
              .withColumn("score", rounded(F.lit(a) * v_s + F.lit(round(1.0 - a, 12)) * k_s)))
    return top_k(scored, ["query_id"], "score", ["doc_id"], k).select(*HIT)


def hybrid(docs: DataFrame, queries: DataFrame, *, doc_id: str = "doc_id", doc_text: str = "text",
           query_id: str = "query_id", query_text: str = "text",
           doc_vectors: DataFrame | None = None, query_vectors: DataFrame | None = None,
           vec_id: str = "vec_id", vec: str = "embedding",
           alpha: float = ALPHA, k: int = LIMIT, by: str | None = None,
           depth: int = DEPTH, fields: dict[str, float] | None = None,
           vector_index: VectorIndex | None = None, ranks: bool = False, doc_vec: str | None = None) -> DataFrame:
    """Top-k fused hits: (query_id, rank, doc_id, score, kw_score, kw_scaled, vec_score, vec_scaled[, kw_rank, vec_rank]).

    ``doc_vectors`` / ``query_vectors`` are (vec_id, embedding) tables keyed by
    doc id / query id.  Without them the vector leg is absent (V10) and the
    score is the scaled keyword score.  With ``by`` (a column of docs and
    queries, e.g. snapshot_id) each query searches only its own collection,
    with collection-level keyword statistics; query ids must be unique.
    ``fields`` (name -> boost) are searched by BM25F instead of ``doc_text``.
    With ``vector_index`` (and ``query_vectors``) the vector leg is what the index returns, the ``depth`` best,
    scaled among themselves; other documents have no vector leg.  ``ranks`` adds each hit's place in either leg.
    ``doc_vec`` (instead of ``doc_vectors``) is a column of ``docs`` with their vectors; a document id is then one row of
    ``docs``, and both legs are scored where it lies (see ``fused``), without ``depth``.
    """
    g = [by] if by else []
    if doc_vec is not None and query_vectors is not None:
        if ranks:
            raise ValueError("ranks need doc_vectors")
        cand = fused.candidates(docs, queries, _query_vectors(queries, query_vectors, query_id, vec_id, vec, g), fields or {doc_text: 1.0}, doc_id=doc_id,
                                doc_vec=doc_vec, query_id=query_id, query_text=query_text, by=g, alpha=alpha, k=k)
        return _fused_top(cand, alpha, k)
    # The keyword pairs are summed from the checkpointed document rows wherever they are needed, inside document
    # partitions; neighbours are brought to the documents, so no exchange is made on (query, document).
    kw = (bm25f(docs, queries, fields or {doc_text: 1.0}, doc_id=doc_id, query_id=query_id,
                query_text=query_text, by=[by] if by else ())
          .select(F.col(query_id).cast("long").alias("query_id"),
                  F.col(doc_id).cast("long").alias("doc_id"), rounded("kw_score").alias("kw_score")))
    # Collections by snapshot are made of parsed files, whose plans misjudge their size; stored tables' do not.
    sized = exchanged if by else (lambda d: d)
    if query_vectors is None or (doc_vectors is None and vector_index is None):
        a, dv = 0.0, None
        # The best score of each of many groups of documents: k of them reach the k-th best of these, so a score so far below
        # it that rounding cannot tie the two does not rank, and is not sorted.
        part = F.pmod(F.xxhash64("doc_id"), F.lit(PARTS * k))
        best = cut_lineage(kw.groupBy("query_id", part.alias("part")).agg(F.min("kw_score").alias("lo"), F.max("kw_score").alias("hi")))
        floor = F.try_element_at(F.sort_array(F.collect_list("hi"), asc=False), F.lit(k))
        kstats = cut_lineage(best.groupBy("query_id").agg(F.min("lo").alias("kw_min"), F.max("hi").alias("kw_max"), floor.alias("floor")))
        sent = F.broadcast(kstats) if fits(kstats, MARKED_QUERIES) else kstats
        near = F.col("floor").isNull() | (F.col("kw_score") >= F.col("floor") - 2e-6 * (F.col("kw_max") - F.col("kw_min")))
        cand = (kw.join(sent, "query_id").where(near).drop("floor").withColumn("vec_score", F.lit(None).cast("double"))
                .withColumn("vec_min", F.lit(None).cast("double"))
                .withColumn("vec_max", F.lit(None).cast("double")))
    else:
        a = alpha
        b1 = round(1.0 - a, 12)
        depth = max(k, depth)
        qv = _query_vectors(queries, query_vectors, query_id, vec_id, vec, g)
        if vector_index is not None:
            dv = None
            vt = cut_lineage(vector_index.topk(qv, depth, query_id="query_id", query_vec="qvec", by=by))
            vs = vt.groupBy("query_id").agg(F.min("vec_score").alias("vec_min"), F.max("vec_score").alias("vec_max"))
        else:
            dv = (doc_vectors.select(F.col(vec_id).cast("long").alias("doc_id"), F.col(vec).alias("dvec"))
                  .join(sized(docs.select(F.col(doc_id).cast("long").alias("doc_id"), *g)), "doc_id",
                        "inner" if by else "left_semi"))
            vtop, vs = vector_topk(dv, qv, depth, doc_id="doc_id", doc_vec="dvec", query_id="query_id",
                                   query_vec="qvec", group=by, margin=_tie_margin(a))
            vt = cut_lineage(vtop.select("query_id", "doc_id", "vec_score"))

        # One pass: each query's keyword range, and the keyword scores of its neighbours (about DEPTH a query).
        pairs = kw.join(_near(vt), "doc_id", "left").withColumn("vec_score", F.element_at("near", F.col("query_id"))).drop("near")
        met = F.when(F.col("vec_score").isNotNull(), F.struct("doc_id", "kw_score"))
        once = cut_lineage(pairs.groupBy("query_id").agg(F.min("kw_score").alias("kw_min"), F.max("kw_score").alias("kw_max"), F.collect_list(met).alias("met")))
        kstats = once.select("query_id", "kw_min", "kw_max")
        vt_kw = once.select("query_id", F.explode("met").alias("m")).select("query_id", "m.doc_id", "m.kw_score")

        # Exact fused scores of the scored vector neighbours.
        known = (vt.select("query_id", "doc_id", "vec_score").join(vt_kw, ["query_id", "doc_id"], "left").join(kstats, "query_id", "left")
                 .join(vs, "query_id", "left"))
        known_f = F.lit(a) * _scaled("vec_score", "vec_min", "vec_max") + F.lit(b1) * _scaled("kw_score", "kw_min", "kw_max")
        # Per query: T = k-th best fused among them (a lower bound of the true k-th best),
        # v_k = the DEPTH-th best vector score (every other document scores at most this).
        best_v = F.try_element_at(F.sort_array(F.collect_list("vec_score"), asc=False), F.lit(depth))
        thr = (known.groupBy("query_id")
               .agg(F.try_element_at(F.sort_array(F.collect_list(known_f), asc=False), F.lit(k)).alias("t_k"), best_v.alias("v_k"))
               .join(vs, "query_id"))
        # Any other keyword candidate has vector score <= v_k (none with an index), so its fused score is at most
        # a * scaled(v_k) + (1 - a) * scaled(kw); below T (minus a rounding margin) it cannot rank.
        limits = cut_lineage(kstats.join(thr, "query_id", "left"))
        sent = F.broadcast(limits) if fits(limits, MARKED_QUERIES) else limits
        rest = pairs.where(F.col("vec_score").isNull()).drop("vec_score").join(sent, "query_id")
        reach = F.lit(0.0) if dv is None else F.lit(a) * _scaled("v_k", "vec_min", "vec_max")
        bound = reach + F.lit(b1) * _scaled("kw_score", "kw_min", "kw_max")
        unknown = F.col("t_k").isNull() if dv is None else F.col("t_k").isNull() | F.col("v_k").isNull()
        survivors = rest.filter(unknown | (bound >= F.col("t_k") - F.lit(PRUNE_MARGIN))).select("query_id", "doc_id", "kw_score", "kw_min", "kw_max")
        if dv is None:
            kwv = survivors.withColumn("vec_score", F.lit(None).cast("double"))
        else:
            # Exact vector score of the survivors: equi joins on doc and query id.
            joined = survivors.join(sized(dv.select("doc_id", "dvec")), "doc_id", "left")
            kwv = pair_cosine(joined.join(qv.select("query_id", "qvec"), "query_id", "left"), "dvec", "qvec")
        cand = (kwv.select("query_id", "doc_id", "kw_score", "kw_min", "kw_max", "vec_score")
                .unionByName(known.select("query_id", "doc_id", "kw_score", "kw_min", "kw_max", "vec_score"))
                .join(vs, "query_id", "left"))

    hits = _fused_top(cand, a, k)
    if not ranks:
        return hits
    hits = cut_lineage(hits)
    # Checkpointed, so the vector ranks do not count the keyword ranks again.
    hits = cut_lineage(hits.join(_leg_ranks(hits, kw, k), ["query_id", "doc_id"], "left"))
    if a and dv is not None:
        places = vector_ranks(dv, qv, hits.where(F.col("vec_score").isNotNull()), doc_id="doc_id", doc_vec="dvec", query_id="query_id", query_vec="qvec", group=by)
        hits = hits.join(places, ["query_id", "doc_id"], "left")
    elif a:
        hits = hits.join(vt.select("query_id", "doc_id", F.col("vec_rank").cast("long").alias("vec_rank")), ["query_id", "doc_id"], "left")
    else:
        hits = hits.withColumn("vec_rank", F.lit(None).cast("long"))
    return hits.select(*HIT, "kw_rank", "vec_rank")


def typed_hits(hits: DataFrame, snippets: DataFrame, issues: DataFrame, issue_id: str,
               types: Sequence[str], doc_id: str = "doc_id") -> DataFrame:
    """V7 type filter after the top-k, V8 projection, V11 empty result for issues without hits.

    Snippet text is joined back only for the k survivors per issue; the hits (at most LIMIT-like k
    rows an issue) are sent to the snippets while they are few, so no text is shuffled for them.
    """
    hits = cut_lineage(hits)
    if hits.count() <= HITS_SENT:
        hits = F.broadcast(hits)
    kept = hits.join(snippets.select(F.col(doc_id).cast("long").alias("doc_id"), "file", "name", "type", "text"),
                     "doc_id").filter(F.col("type").isin(list(types)))
    proj = kept.select(F.col("query_id").alias(issue_id), "rank", "file",
                       F.col("name").alias("function_type"), "type", "text", "score")
    return issues.select(F.col(issue_id).cast("long").alias(issue_id)).join(proj, issue_id, "left")
