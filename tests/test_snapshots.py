"""Many snapshots in one scan, and content-addressed parsing."""

import os

from codeloom.operators import symbols as X
from codeloom.operators.parse_store import ParseStore
from codeloom.sources import files


def _write(root, rel, data: bytes):
    p = os.path.join(root, rel)
    os.makedirs(os.path.dirname(p), exist_ok=True)
    with open(p, "wb") as f:
        f.write(data)


def test_one_scan_over_many_roots(spark, scratch):
    for rel in ("one/a.py", "one/sub/b.py", "two/a.py", "one/one/c.py", "one extra/d.py"):
        _write(scratch, rel, rel.encode())
    roots = {"s1": f"{scratch}/one", "s2": f"file://{scratch}/two/", "gone": f"{scratch}/missing", "inner": f"{scratch}/one/sub"}
    got = {(r.snapshot_id, r.path): r.content for r in files.snapshots(spark, roots).collect()}
    assert got == {("s1", "a.py"): "one/a.py", ("s1", "sub/b.py"): "one/sub/b.py", ("s1", "one/c.py"): "one/one/c.py",
                   ("s2", "a.py"): "two/a.py", ("inner", "b.py"): "one/sub/b.py"}
    assert files.snapshots(spark, {"gone": f"{scratch}/missing"}).collect() == []


def _snapshot(spark, name, n, changed):
    rows = [(name, f"f{i}.py", f"def f{i}():\n    return {i if i not in changed else -i}\n" if i % 7 else "", None) for i in range(n)]
    return spark.createDataFrame(rows, "snapshot_id string, path string, content string, blob_sha string")


def test_equal_blobs_are_parsed_once(spark):
    first, second = _snapshot(spark, "v1", 100, ()), _snapshot(spark, "v2", 100, range(1, 100, 10))
    store = ParseStore(spark)
    assert store.add(first).count() == 86                    # 85 different files and the empty one
    assert store.add(second).count() <= 10
    assert store.add(second).count() == 0
    for files_ in (first, second):
        want = sorted((r.snapshot_id, r.path, r.name, r.lineno) for r in X.functions(X.parse(files_)).collect())
        assert sorted((r.snapshot_id, r.path, r.name, r.lineno) for r in X.functions(store.parsed(files_)).collect()) == want


def test_broken_and_null_files(spark):
    rows = spark.createDataFrame([("s", "a.py", "def f(:\n", None), ("s", "b.py", None, None)],
                                 "snapshot_id string, path string, content string, blob_sha string")
    store = ParseStore(spark)
    store.add(rows)
    got = {r.path: r.parse_error for r in store.parsed(rows).collect()}
    assert got["a.py"] and got["b.py"] is None
