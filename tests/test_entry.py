"""Driver contract and the DuckDB differential at sf0.001."""

import pytest

import __spark_entry__ as E
from conftest import SF0001


def test_contract(spark):
    df = E.entry(spark)
    assert df.count() > 0
    assert set(E.oracle_sql()) <= set(E.queries())


def test_entry_loads_without_the_training_data_libraries():
    import subprocess
    import sys
    code = "import sys; sys.modules['ahocorasick'] = None; import __spark_entry__ as E; print(len(E.queries()), any(k.startswith('op') for k in E.queries()))"
    done = subprocess.run([sys.executable, "-c", code], cwd=E._HERE, capture_output=True, text=True, check=True)
    n, some = done.stdout.split()
    assert int(n) >= 48 and some == "False"


FAST = ["bm25_topk", "hybrid_topk", "inline_comments", "node_upsert", "detach_delete", "candidates_strict",
        "patch_scores", "code_functions", "symbol_table", "graph_calls_as_coded", "commit_graph", "parsed_queries",
        "bm25f_topk", "bm25_stored_topk", "vector_topk_indexed", "code_snapshots", "sink_batches", "issue_states",
        "node_upsert_state", "neighbourhood_hub", "neighbourhood_filtered", "pattern_findings"]


@pytest.mark.parametrize("key", FAST)
def test_matches_oracle_at_sf0001(spark, key):
    import compare
    con = compare.duck(SF0001)
    sdf = E.queries()[key](spark, SF0001)
    a, ac = compare.rows_of(sdf.columns, [tuple(r) for r in sdf.collect()])
    res = con.execute(E.oracle_sql()[key])
    b, bc = compare.rows_of([d[0] for d in res.description], res.fetchall())
    assert ac == bc and a == b
