"""Upsert, endpoint check, detach delete, lag: algebraic properties."""

import random


from codeloom.operators.upsert import detach_delete, upsert_edges, upsert_nodes

NODE_T = "label string, id string, props map<string,string>, ord long"
EDGE_T = "src_label string, src_id string, rel string, dst_label string, dst_id string, props map<string,string>, ord long"


def as_dict(df):
    return {(r.label, r.id): dict(r.props) for r in df.collect()}


def test_node_overlay_latest_wins_and_null_removes(spark):
    u = spark.createDataFrame([("U", "1", {"a": "x", "b": "y"}, 1), ("U", "1", {"a": "z", "b": None}, 2),
                               ("U", "2", {}, 1)], NODE_T)
    assert as_dict(upsert_nodes(u)) == {("U", "1"): {"a": "z"}, ("U", "2"): {}}


def test_upsert_is_idempotent_and_state_keeps_untouched_props(spark):
    u = spark.createDataFrame([("U", "1", {"a": "x"}, 1)], NODE_T)
    once = upsert_nodes(u)
    assert as_dict(upsert_nodes(u, once)) == as_dict(once)
    state = spark.createDataFrame([("U", "1", {"keep": "k", "a": "old"}, 0)], NODE_T).drop("ord")
    assert as_dict(upsert_nodes(u, state)) == {("U", "1"): {"a": "x", "keep": "k"}}


def test_edges_need_both_ends_and_merge_on_key(spark):
    nodes = upsert_nodes(spark.createDataFrame([("U", "1", {}, 0), ("U", "2", {}, 0)], NODE_T))
    e = spark.createDataFrame([("U", "1", "R", "U", "2", {"w": "1"}, 1), ("U", "1", "R", "U", "2", {"w": "2"}, 2),
                               ("U", "1", "R", "U", "3", {"w": "9"}, 1), ("U", "1", "R", "V", "2", {}, 1)], EDGE_T)
    from codeloom.operators.upsert import EdgeReport
    report = EdgeReport("t")
    got = [(r.dst_label, r.dst_id, dict(r.props)) for r in upsert_edges(e, nodes, report=report).collect()]
    assert got == [("U", "2", {"w": "2"})]
    assert report.dropped == 2


def test_detach_delete(spark):
    n = spark.createDataFrame([("A", "1"), ("A", "2"), ("B", "1")], "label string, id string")
    e = spark.createDataFrame([("A", "1", "R", "B", "1"), ("A", "2", "R", "B", "1"), ("B", "1", "R", "A", "1")],
                              "src_label string, src_id string, rel string, dst_label string, dst_id string")
    kn, ke = detach_delete(n, e, spark.createDataFrame([("A", "1")], "label string, id string"))
    assert sorted(tuple(r) for r in kn.collect()) == [("A", "2"), ("B", "1")]
    assert [tuple(r) for r in ke.collect()] == [("A", "2", "R", "B", "1")]


def test_upsert_hot_node_matches_naive_last_wins(spark):
    rnd = random.Random(3)
    rows = []
    for o in range(3000):
        node = "hot" if rnd.random() < 0.34 else str(rnd.randrange(100))
        prop = rnd.choice("abc")
        val = None if rnd.random() < 0.1 else str(rnd.randrange(10))
        rows.append(("N", node, {prop: val}, o))
    got = as_dict(upsert_nodes(spark.createDataFrame(rows, NODE_T)))
    want = {}
    for label, node, props, _ in sorted(rows, key=lambda r: r[3]):
        cur = want.setdefault((label, node), {})
        for k, v in props.items():
            if v is None:
                cur.pop(k, None)
            else:
                cur[k] = v
    assert got == want


def test_order_free_graph_is_invariant_under_file_permutation(spark):
    from codeloom.operators import codegraph as G
    from codeloom.operators import symbols as X
    from codeloom.plans import source_fixture as F1
    from conftest import SF0001
    files = F1.source_files(spark, SF0001).limit(60).collect()
    schema = "snapshot_id string, path string, content string, blob_sha string"

    def edge_set(rows, parts):
        df = spark.createDataFrame(rows, schema).repartition(parts)
        p = X.parse(df, persist=False)
        st = X.symbol_table(p)
        e = G.check_endpoints(G.calls_edges(p, st).unionByName(G.inherits_overrides(p, st)), G.nodes(p))
        return {tuple(r) for r in e.select("src_id", "rel", "dst_id").collect()}
    shuffled = list(files)
    random.Random(5).shuffle(shuffled)
    assert edge_set(files, 1) == edge_set(shuffled, 7)


def test_all_scores_lie_in_unit_interval(spark):
    import __spark_entry__ as E
    from conftest import SF0001
    s = E.queries()["patch_scores"](spark, SF0001).collect()
    cols = ["patch_size", "syntax", "style", "exception", "docstring", "variable", "pattern", "llm", "total"]
    assert s and all(0.0 <= r[c] <= 1.0 for r in s for c in cols)
    h = E.queries()["hybrid_topk"](spark, SF0001).collect()
    assert h and all(0.0 <= r.score <= 1.0 for r in h)


def test_pages_of_a_hub_and_of_small_nodes(spark):
    from codeloom.operators.match import neighbour_pages
    edges = [("F", "hub", "CALLS", "F", f"n{i:04d}") for i in range(2_500)] * 2 + [("F", "n0001", "CALLS", "F", "hub"), ("C", "hub", "HAS", "F", "x")]
    e = spark.createDataFrame(edges, "src_label string, src_id string, rel string, dst_label string, dst_id string").repartition(7)
    pids = spark.createDataFrame([("F", "hub"), ("F", "n0001"), ("F", "nobody")], "label string, pid string")
    rows = neighbour_pages(pids, e, page=100).collect()
    out = sorted((r.page, r.n, r.vals) for r in rows if (r.pid, r.dir) == ("hub", "out"))
    assert [p for p, _, _ in out] == list(range(25)) and {n for _, n, _ in out} == {100}
    assert [v for _, _, vals in out for v in vals] == [f"F:n{i:04d}" for i in range(2_500)]
    assert {(r.pid, r.dir): r.vals for r in rows if r.dir == "in" or r.pid != "hub"} == {
        ("hub", "in"): ["F:n0001"], ("n0001", "in"): ["F:hub"], ("n0001", "out"): ["F:hub"]}


def test_predicate_rows(spark):
    import pytest

    from codeloom.operators.match import filtered_nodes
    nodes = spark.createDataFrame([
        ("Function", "a/b/m.py::f", {"name": "f", "file_path": "a/b/m.py"}), ("Function", "a/bc/m.py::f", {"name": "f", "file_path": "a/bc/m.py"}),
        ("Function", "a/b/m.py::g", {"name": "g", "file_path": "a/b/m.py"}), ("Class", "a/b/m.py::f2", {"name": "f", "file_path": "a/b/m.py"})],
        "label string, id string, props map<string,string>")
    schema = "issue_id long, property string, operator string, value string"
    p = spark.createDataFrame([(1, "name", "=", "f"), (1, "file_path", "within", "a/b"), (2, "file_path", "within", "a"), (2, "label", "=", "Function"),
                               (3, "name", "=", "f"), (3, "name", "=", "g"), (4, "file_path", "within", "a/b/m.py"), (4, "name", "=", "g")], schema)
    got = sorted((r.issue_id, r.id) for r in filtered_nodes(nodes, p, issue_id="issue_id").collect())
    assert got == [(1, "a/b/m.py::f"), (1, "a/b/m.py::f2"), (2, "a/b/m.py::f"), (2, "a/b/m.py::g"), (2, "a/bc/m.py::f"), (4, "a/b/m.py::g")]
    with pytest.raises(Exception, match="unknown predicate operator"):
        filtered_nodes(nodes, spark.createDataFrame([(1, "name", "~", "f")], schema), issue_id="issue_id").collect()


def test_participants_of_either_label(spark):
    from codeloom.operators.codegraph import participant_edges
    nodes = spark.createDataFrame([("s", "Class", "m::A"), ("s", "Function", "m::A"), ("s", "Function", "m::f"), ("t", "Class", "m::f")], "snapshot_id string, label string, id string")
    found = spark.createDataFrame([("s", "P", "m::A", "Role"), ("s", "P", "m::f", None), ("s", "P", "gone", "x"), ("s", "P", "m::f", None)],
                                  "snapshot_id string, pattern string, participant string, role string")
    got = sorted((r.src_label, r.src_id, r.props["role"]) for r in participant_edges(found, nodes).collect())
    assert got == [("Class", "m::A", "Role"), ("Function", "m::f", "Participant")]
