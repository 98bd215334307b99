"""Registry of queries: key -> callable(spark, sf_dir) -> DataFrame."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import code, commits_fixture, corpus, graphs, patches, search, workflow

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "bm25_topk": search.bm25_topk,
    "bm25_fields_topk": search.bm25_fields_topk,
    "bm25f_topk": search.bm25f_topk,
    "bm25_stored_topk": search.bm25_stored_topk,
    "vector_topk": search.vector_topk,
    "vector_topk_indexed": search.vector_topk_indexed,
    "hybrid_topk": search.hybrid_topk,
    "hybrid_typed_hits": search.hybrid_typed_hits,
    "issue_slice": corpus.issue_slice,
    "snippet_count": corpus.snippet_count,
    "sink_batches": corpus.sink_batches,
    "issue_states": corpus.issue_states,
    "inline_comments": corpus.inline_comments,
    "node_upsert": graphs.node_upsert,
    "node_upsert_state": graphs.node_upsert_state,
    "edge_upsert": graphs.edge_upsert,
    "detach_delete": graphs.detach_delete,
    "neighbourhood": graphs.neighbourhood,
    "candidates": patches.candidates,
    "candidates_strict": patches.candidates_strict,
    "patch_scores": patches.patch_scores,
    "best_patch": patches.best_patch,
    "extraction_stats": patches.extraction_stats,
    "code_functions": code.code_functions,
    "code_snapshots": code.code_snapshots,
    "code_classes": code.code_classes,
    "code_bases_attrs": code.code_bases_attrs,
    "code_imports_aliases": code.code_imports_aliases,
    "code_calls": code.code_calls,
    "parse_errors": code.parse_errors,
    "symbol_table": code.symbol_table,
    "design_patterns": code.design_patterns,
    "pattern_findings": code.pattern_findings,
    "snippets": code.snippets,
    "graph_nodes": code.graph_nodes,
    "graph_contains": code.graph_contains,
    "graph_inherits_overrides": code.graph_inherits_overrides,
    "graph_calls": code.graph_calls,
    "graph_calls_as_coded": code.graph_calls_as_coded,
    "graph_imports": code.graph_imports,
    "neighbourhood_class": code.neighbourhood_class,
    "neighbourhood_hub": graphs.neighbourhood_hub,
    "neighbourhood_filtered": code.neighbourhood_filtered,
    "commit_graph": commits_fixture.commit_graph,
    "prompts": workflow.prompts,
    "parsed_queries": workflow.parsed_queries,
    "embed_rows": workflow.embed_rows,
    "issue_workflow": workflow.issue_workflow,
}
