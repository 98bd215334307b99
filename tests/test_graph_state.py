"""The stored graph against one upsert over everything."""

import os
import random

from pyspark.sql import functions as F

from codeloom.operators.graph_state import GraphState
from codeloom.operators.upsert import EDGE_KEY, NODE_KEY, flatten_props, upsert_edges, upsert_nodes

NODES = "snapshot_id string, label string, id string, props map<string,string>, ord long"
EDGES = "snapshot_id string, src_label string, src_id string, rel string, dst_label string, dst_id string, props map<string,string>, ord long"


def _updates(rng, n, start):
    return [(rng.choice(["v1", "v2"]), rng.choice(["File", "Function"]), f"n{rng.randrange(30)}",
             {rng.choice("abc"): rng.choice(["1", "2", None])}, start + i) for i in range(n)]


def _files(path):
    return {os.path.join(d, f): os.path.getmtime(os.path.join(d, f)) for d, _, fs in os.walk(path) for f in fs if f.endswith(".parquet")}


def _flat(df, key):
    return sorted(tuple(r) for r in flatten_props(df, ["snapshot_id", *key]).collect())


def test_batches_equal_one_upsert_and_clashing_ids_stay_apart(spark, scratch):
    rng = random.Random(1)
    batches = [_updates(rng, 80, 0), _updates(rng, 3, 1_000), _updates(rng, 40, 2_000)]
    state = GraphState(spark, f"{scratch}/g", buckets=16)
    for b in batches:
        state.apply_nodes(spark.createDataFrame(b, NODES))
    everything = spark.createDataFrame([x for b in batches for x in b], NODES)
    assert _flat(state.nodes(), NODE_KEY) == _flat(upsert_nodes(everything, by=["snapshot_id"]), NODE_KEY)
    edge = [(s, a, f"n{rng.randrange(40)}", "CALLS", b, f"n{rng.randrange(40)}", {"w": str(i)}, i)
            for i in range(120) for s in ["v1", "v2"] for a, b in [("File", "Function")]]
    state.apply_edges(spark.createDataFrame(edge[:100], EDGES))
    state.apply_edges(spark.createDataFrame(edge[100:], EDGES))
    want = upsert_edges(spark.createDataFrame(edge, EDGES), state.nodes(), by=["snapshot_id"])
    assert _flat(state.edges(), EDGE_KEY) == _flat(want, EDGE_KEY)


def test_untouched_buckets_keep_their_files_and_lost_batches_change_nothing(spark, scratch):
    state = GraphState(spark, f"{scratch}/g", buckets=8)
    state.apply_nodes(spark.createDataFrame([("v1", "File", f"n{i}", {"a": str(i)}, i) for i in range(200)], NODES))
    before, old = _files(scratch), state.version()
    touched = state.apply_nodes(spark.createDataFrame([("v1", "File", "n7", {"a": "new"}, 0)], NODES))
    assert len(touched) == 1
    new = state.version()
    assert {b for b in old["nodes"] if new["nodes"][b] != old["nodes"][b]} == {str(touched[0])}
    assert before.items() <= _files(scratch).items()
    # data without a version file, as a lost batch leaves it
    state.nodes().limit(1).write.parquet(f"{scratch}/g/nodes/lost/bucket=0")
    got = {r.id: r.props["a"] for r in state.nodes().collect()}
    assert len(got) == 200 and got["n7"] == "new" and got["n8"] == "8"
    assert state.apply_nodes(spark.createDataFrame([], NODES)) == [] and state.version() == new
