"""Prompt, model-call and end-to-end queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..operators import codegraph as G
from ..operators import replies as R
from ..operators import scoring as S
from ..operators import symbols as X
from ..operators.hybrid import hybrid, typed_hits
from ..operators.match import neighbourhood, results_per_issue
from ..operators.predict import predict
from ..operators.prompts import ANALYSIS_TEMPLATE, PATCH_TEMPLATE, QUERY_TEMPLATE, SCORE_TEMPLATE, render
from ..operators.snippets import build_snippets
from ..operators.vector import embed
from ..session import cut_lineage
from ..sources.tables import table
from . import search
from . import source_fixture as F1

NO_GRAPH = "(none)"
NO_HITS = "(none)"
# The snippet types kept from the hybrid hits.
HIT_TYPES = ("usage_context", "function_code")


def hits_text(hits: DataFrame, issue_id: str) -> DataFrame:
    """Per issue, the kept hits (at most k) as text lines in rank order."""
    line = F.concat(F.lit("- "), F.col("rank").cast("string"), F.lit(". "), F.col("file"), F.lit(" :: "),
                    F.col("function_type"), F.lit(" ["), F.col("type"), F.lit("] score="),
                    F.format_string("%.6f", F.col("score")), F.lit("\n"), F.col("text"))
    return (hits.filter(F.col("rank").isNotNull())
            .groupBy(issue_id)
            .agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", line.alias("l")))),
                                          lambda x: x["l"]), "\n").alias("hits")))


def prompts(spark: SparkSession, sf: str) -> DataFrame:
    """P1 and P3 for every benchmark issue; hits are the keyword-only typed hits."""
    issues = table(spark, sf, "benchmark")
    h = hits_text(search.hybrid_typed_hits(spark, sf), "item_id")
    j = issues.join(h, "item_id", "left")
    return j.select("item_id",
                    render(ANALYSIS_TEMPLATE, issue=F.col("text")).alias("analysis_prompt"),
                    render(PATCH_TEMPLATE, issue=F.col("text"), hits=F.coalesce("hits", F.lit(NO_HITS)),
                           graph=F.lit(NO_GRAPH)).alias("patch_prompt"))


def analyse(issues: DataFrame, text: str, analysis_provider="stub-keywords",
            query_provider="stub-queries", error: str | None = None) -> DataFrame:
    """Analysis, then the two queries from it; each model step runs once (checkpointed).

    With ``error`` a column of that name says why a step failed; the second step leaves such rows alone."""
    a = predict(issues.withColumn("p1", render(ANALYSIS_TEMPLATE, issue=F.col(text))), "p1", "analysis",
                analysis_provider, error=error)
    q = predict(a.withColumn("p2", render(QUERY_TEMPLATE, analysis=F.col("analysis"))), "p2", "queries_reply",
                query_provider, error=error)
    vq, cq = R.parse_queries("queries_reply")
    return q.withColumn("vector_query", vq).withColumn("cypher_query", cq).drop("p1", "p2")


def parsed_queries(spark: SparkSession, sf: str) -> DataFrame:
    issues = table(spark, sf, "benchmark")
    return analyse(issues, "text").select("item_id", "analysis", "vector_query", "cypher_query")


def embed_rows(spark: SparkSession, sf: str) -> DataFrame:
    """V1 over documents and V2 over the benchmark queries (hashing stand-in model)."""
    d = embed(table(spark, sf, "documents").select(F.col("doc_id").alias("id"), "text"))
    q = embed(table(spark, sf, "benchmark").select(F.col("item_id").alias("id"), "text"))
    return (d.select(F.lit("document").alias("kind"), "id", "embedding")
            .unionByName(q.select(F.lit("query").alias("kind"), "id", "embedding")))


def ingest(source_files: DataFrame | None = None, *, parsed: DataFrame | None = None,
           symbols: DataFrame | None = None, nodes: DataFrame | None = None) -> dict[str, DataFrame]:
    """Files -> symbols -> snippets (+ embeddings) -> graph, for every snapshot in the table.

    Parts already built for the corpus (parsed files, symbol table, node table) are reused."""
    parsed = parsed if parsed is not None else X.parse(source_files)
    st = symbols if symbols is not None else cut_lineage(X.symbol_table(parsed))
    snippets = build_snippets(X.functions(parsed), X.classes(parsed), X.call_lists(parsed))
    # Ids follow from the content, so every ingest of a corpus gives the same ones; rows equal in all
    # of it are told apart by their count.
    content = ["snapshot_id", "snippet_id", "type", "file", "name", "text"]
    # (told apart by the contents' hash, which is sorted faster than they are; a collision gives two ids as well)
    nth = F.row_number().over(Window.partitionBy("same").orderBy("lineno"))
    numbered = snippets.withColumn("same", F.xxhash64(*content)).withColumn("doc_id", F.xxhash64(*content, nth)).drop("same")
    snippets = cut_lineage(embed(numbered))
    if nodes is None:
        nodes = cut_lineage(G.nodes(parsed))  # read by every endpoint check and name lookup
    edges = (G.contains_edges(parsed).unionByName(G.inherits_overrides(parsed, st))
             .unionByName(G.calls_edges(parsed, st)).unionByName(G.imports_edges(parsed))
             .unionByName(G.pattern_edges(parsed)))
    edges = cut_lineage(G.check_endpoints(edges, nodes))  # the graph store's edge table
    return {"parsed": parsed, "symbols": st, "snippets": snippets, "nodes": nodes, "edges": edges}


def run_issues(issues: DataFrame, kb: dict[str, DataFrame], provider_prefix: str = "stub", errors: bool = False) -> DataFrame:
    """Issues (issue_id, snapshot_id, repo, base_commit, problem_statement) -> one result row each.

    With ``errors`` a column ``error`` says which model call an issue failed at (a failed scoring call is no
    failure: the model score is then its default); the sink leaves such issues open."""
    q = analyse(issues, "problem_statement", f"{provider_prefix}-keywords", f"{provider_prefix}-queries", error="error")
    sn = kb["snippets"]
    # Dual retrieval, per snapshot: hybrid search of the vector query over that snapshot's snippets.
    qv = embed(q.select(F.col("issue_id").alias("vec_id"), F.col("vector_query").alias("text")))
    hy = hybrid(sn.select("snapshot_id", "doc_id", "text", "embedding"),
                q.select("snapshot_id", "issue_id", F.col("vector_query").alias("text")),
                doc_id="doc_id", query_id="issue_id", doc_vec="embedding", query_vectors=qv,
                by="snapshot_id")
    hits = typed_hits(hy, sn, q.select("issue_id"), "issue_id", HIT_TYPES)
    hit_lists = hits_text(hits, "issue_id")
    # Graph leg: the neighbourhood of the names the model's replies give (quoted in the graph query, or
    # among the keywords), whatever the text leg found.
    quoted = F.regexp_extract_all("cypher_query", F.lit("['\"]([^'\"]+)['\"]"), F.lit(1))
    keywords = F.regexp_extract_all("vector_query", F.lit(r"([\p{L}_][\p{L}\p{N}_.]*)"), F.lit(1))
    seeds = q.select("issue_id", "snapshot_id", F.explode(F.concat(*[F.coalesce(x, F.array().cast("array<string>")) for x in (quoted, keywords)])).alias("name")).distinct()
    gn = kb["nodes"].select("snapshot_id", "label", "id", F.when(F.col("label") == "File", F.col("props")["path"])
                            .otherwise(F.col("props")["name"]).alias("name"))
    ge = kb["edges"].select("snapshot_id", "src_label", "src_id", "rel", "dst_label", "dst_id")
    rows = neighbourhood(q.select("issue_id"), seeds, gn, ge, issue_id="issue_id", label="Function",
                         relations={"files": ("CONTAINS_FUNCTION", "in", "File"),
                                    "classes": ("CONTAINS_FUNCTION", "in", "Class"),
                                    "called": ("CALLS", "out", "Function")}, with_one_hop=False,
                         by=["snapshot_id"])
    graph = results_per_issue(rows, "issue_id", ["files", "classes", "called"]).select(
        "issue_id", F.to_json("results").alias("graph"))
    gen = (q.join(hit_lists, "issue_id", "left").join(graph, "issue_id", "left")
           .withColumn("p3", render(PATCH_TEMPLATE, issue=F.col("problem_statement"),
                                    hits=F.coalesce("hits", F.lit(NO_HITS)),
                                    graph=F.coalesce("graph", F.lit(NO_GRAPH)))))
    gen = predict(gen, "p3", "generated_patch", f"{provider_prefix}-patch", error="error")
    meta, cands = R.extract(gen.select("issue_id", F.col("generated_patch").alias("reply")), "issue_id")
    cands = cands.join(gen.select("issue_id", "problem_statement"), "issue_id")
    cands = predict(cands.withColumn("p4", render(SCORE_TEMPLATE, issue=F.col("problem_statement"),
                                                  patch=F.col("func"))), "p4", "score_reply",
                    f"{provider_prefix}-score")
    scored = S.score(cands, model_reply="score_reply")
    bundle = S.bundle(meta, scored, "issue_id")
    breakdown = F.struct("patch_id", "total", "patch_size", "syntax", "style", "exception", "docstring",
                         "variable", "pattern", "llm", "func")
    per_issue = scored.groupBy("issue_id").agg(
        F.array_sort(F.collect_list(breakdown)).alias("patch_scores"))
    allp = cands.groupBy("issue_id").agg(
        F.array_sort(F.collect_list(F.struct("patch_id", "func", "diff"))).alias("all_patches"))
    best = F.when(F.col("best_patch_id").isNotNull(),
                  F.struct(F.col("best_patch_id").alias("patch_id"), F.col("best_total").alias("total"),
                           F.col("best_func").alias("func")))
    return (gen.join(bundle, "issue_id", "left").join(per_issue, "issue_id", "left").join(allp, "issue_id", "left")
            .select((F.col("issue_idx") + 1).alias("serial_no"), "issue_id", "repo", "base_commit",
                    F.col("problem_statement").alias("issue"), "vector_query", "cypher_query",
                    F.col("analysis").alias("analysis_result"), "generated_patch",
                    F.coalesce("all_patches", F.array()).alias("all_patches"),
                    F.coalesce("patch_scores", F.array()).alias("patch_scores"),
                    best.alias("best_patch_dict"), F.col("best_total").alias("best_patch_score"),
                    F.col("best_func").alias("best_patch_code"), "file_name", "function_name",
                    F.lit(provider_prefix).alias("model_provider"), *(["error"] if errors else [])))


def issue_workflow(spark: SparkSession, sf: str) -> DataFrame:
    """Benchmark items as issues against the F1 corpus snapshot."""
    from . import code
    # the corpus's knowledge base: parsed once per application and shared with the code queries
    kb = ingest(parsed=code._parsed(spark, sf), symbols=code._symbols(spark, sf), nodes=code._nodes(spark, sf))
    b = table(spark, sf, "benchmark")
    issues = b.select(F.col("item_id").alias("issue_id"), F.col("item_id").alias("issue_idx"),
                      F.lit(F1.SNAPSHOT).alias("snapshot_id"), F.lit("parts").alias("repo"),
                      F.lit("HEAD").alias("base_commit"), F.col("text").alias("problem_statement"))
    return run_issues(issues, kb)
