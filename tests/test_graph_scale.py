"""Graph jobs send no table made of parsed files whole, and no list or product through one task."""

import random
import re

from codeloom.operators import codegraph as G
from codeloom.operators import match as M
from codeloom.operators import symbols as X
from codeloom.operators.snippets import build_snippets
from codeloom.session import cut_lineage

FILES = [("s", "a.py", "import os\nclass A(B):\n    def f(self):\n        self.g()\n        os.getpid()\n    def g(self):\n        return top()\n"),
         ("s", "b.py", "import a as q\nclass B:\n    def f(self):\n        return q.top()\ndef top():\n    return 1\n")]


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def graph(spark):
    parsed = X.parse(spark.createDataFrame(FILES, "snapshot_id string, path string, content string"))
    return parsed, cut_lineage(X.symbol_table(parsed)), cut_lineage(G.nodes(parsed))


def test_joins_of_parsed_tables_are_not_broadcast(spark):
    parsed, st, nodes = graph(spark)
    calls = G.check_endpoints(G.calls_edges(parsed, st), nodes)
    for df in (calls, G.check_endpoints(G.calls_edges(parsed, st, as_coded=True), nodes), G.check_endpoints(G.contains_edges(parsed), nodes),
               G.check_endpoints(G.inherits_overrides(parsed, st), nodes), build_snippets(X.functions(parsed), X.classes(parsed), X.call_lists(parsed))):
        assert "BroadcastExchange" not in plan(df)
    assert {(r.src_id, r.dst_id) for r in calls.collect()} == {("a.py::A.f", "a.py::A.g"), ("a.py::A.g", "b.py::top")}


def test_hybrid_by_snapshot_sends_no_vectors(spark):
    from codeloom.operators.hybrid import hybrid
    from codeloom.operators.vector import embed
    docs = embed(spark.createDataFrame([("s", i, f"word{i} common") for i in range(30)], "snapshot_id string, doc_id long, text string"))
    issues = embed(spark.createDataFrame([("s", 1, "word3 common")], "snapshot_id string, issue_id long, text string"))
    got = hybrid(docs, issues, query_id="issue_id", doc_vectors=docs.selectExpr("doc_id AS vec_id", "embedding"),
                 query_vectors=issues.selectExpr("issue_id AS vec_id", "embedding"), by="snapshot_id", depth=10)
    assert "MERGE" in got._jdf.queryExecution().analyzed().toString().upper() and got.first().doc_id == 3


def test_neighbourhood_is_the_same_with_many_ids(spark, monkeypatch):
    nodes = spark.createDataFrame([("F", "1", "f"), ("F", "2", "g"), ("F", "2", "g"), ("D", "x", "dx"), ("D", "y", None)], "label string, id string, name string")
    edges = spark.createDataFrame([("D", "x", "HAS", "F", "1"), ("D", "y", "HAS", "F", "1"), ("F", "1", "CALLS", "F", "2"), ("F", "9", "CALLS", "F", "1")],
                                  "src_label string, src_id string, rel string, dst_label string, dst_id string")
    issues = spark.createDataFrame([(1,), (2,), (3,), (None,)], "issue_id long")
    seeds = spark.createDataFrame([(1, "f"), (2, "f"), (2, "g"), (4, "f"), (3, "none")], "issue_id long, name string")
    rel = {"dirs": ("HAS", "in", "D"), "calls": ("CALLS", "out", "F")}

    def rows():
        out = M.neighbourhood(issues, seeds, nodes, edges, issue_id="issue_id", label="F", relations=rel)
        return sorted(map(str, out.collect()))
    few = rows()
    monkeypatch.setattr(M, "FEW_BYTES", 0)
    assert rows() == few
    f = "id='1', name='f', dirs=['dx'], calls=['g'], neighbours=['D:x', 'D:y', 'F:2', 'F:9'])"
    g = "id='2', name='g', dirs=[], calls=[], neighbours=['F:1'])"
    none = "id=None, name=None, dirs=[], calls=[], neighbours=[])"
    assert few == sorted([f"Row(issue_id=1, {f}", f"Row(issue_id=2, {f}", f"Row(issue_id=2, {g}", f"Row(issue_id=2, {g}", f"Row(issue_id=3, {none}", f"Row(issue_id=None, {none}"])


def test_pages_over_many_ranges(spark, monkeypatch):
    rng = random.Random(5)
    held = {p: sorted({f"N:{rng.randrange(400):03d}" for _ in range(k)}) for p, k in (("hub", 900), ("mid", 30), ("one", 1))}
    edges = spark.createDataFrame([("H", p, "R", "N", v[2:]) for p, vs in held.items() for v in vs * 3], "src_label string, src_id string, rel string, dst_label string, dst_id string")
    pids = spark.createDataFrame([("H", p) for p in held], "label string, pid string")
    monkeypatch.setattr(M, "RANGE_EDGES", 40)
    for few in (M.FEW_BYTES, 0):
        monkeypatch.setattr(M, "FEW_BYTES", few)
        pages = M.neighbour_pages(pids, edges, page=16)
        assert pages.rdd.getNumPartitions() > 8         # more than spark.sql.shuffle.partitions
        got = {}
        for r in sorted(pages.collect(), key=lambda r: (r.pid, r.page)):
            assert r.n == len(r.vals) and len(r.vals) <= 16
            got.setdefault(r.pid, []).extend(r.vals)
        assert got == held


def test_common_predicates_make_no_rows(spark):
    nodes = spark.createDataFrame([("F", f"f{i}", {"name": f"n{i}", "path": f"d{i % 3}/x/f{i}.py", "static": "true"}) for i in range(30)]
                                  + [("F", "two", {"path": "d9/a"}), ("F", "two", {"name": "later"}), ("C", "c", {"name": "n1"})],
                                  "label string, id string, props map<string,string>")
    p = [(k, *x) for k in range(5) for x in (("label", "=", "F"), ("static", "=", "true"), ("path", "within", "d1/x"), ("name", "=", f"n{k}"))]
    p += [(7, "path", "within", "d9"), (7, "name", "=", "later"), (8, "label", "=", None), (8, "label", "=", "F"), (9, "name", "=", "absent"), (9, "label", "=", "F")]
    found = M.filtered_nodes(nodes, spark.createDataFrame(p, "issue_id long, property string, operator string, value string"), issue_id="issue_id")
    assert sorted(map(tuple, found.collect())) == [(1, "F", "f1"), (4, "F", "f4"), (7, "F", "two")]
    # issues are not counted against the nodes that meet any one of their predicates
    assert not re.search(r"hashpartitioning\(issue_id#\d+L?, label", plan(found))
