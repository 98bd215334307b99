"""S2-S9 on scratch folders."""

import os

from pyspark.sql import functions as F

from codeloom.sources import files, sinks


def _write(root, rel, data: bytes):
    p = os.path.join(root, rel)
    os.makedirs(os.path.dirname(p), exist_ok=True)
    with open(p, "wb") as f:
        f.write(data)


def test_snapshot_scan_recursive_glob_utf8_and_blob_sha(spark, scratch):
    _write(scratch, "a/b/m.py", b"def f():\n    return 1\n")
    _write(scratch, "a/readme.txt", b"not python")
    _write(scratch, "bad.py", b"x = '\xff'\n")
    df = files.source_files(spark, scratch, "snap")
    rows = {r.path: r for r in df.collect()}
    assert set(rows) == {"a/b/m.py", "bad.py"}
    assert rows["bad.py"].content == "x = '�'\n"
    # git hash-object of "def f():\n    return 1\n"
    import hashlib
    data = b"def f():\n    return 1\n"
    assert rows["a/b/m.py"].blob_sha == hashlib.sha1(b"blob %d\x00" % len(data) + data).hexdigest()
    assert set(r.path for r in files.source_files(spark, scratch, "snap", glob=None).collect()) == \
        {"a/b/m.py", "a/readme.txt", "bad.py"}


def test_whole_text(spark, scratch):
    _write(scratch, "reply.txt", b"line 1\nline 2\n")
    rows = files.whole_text(spark, os.path.join(scratch, "reply.txt")).collect()
    assert len(rows) == 1 and rows[0].value == "line 1\nline 2\n"


def test_collection_lifecycle(spark, scratch):
    path = os.path.join(scratch, "snippets")
    sinks.ensure_collection(spark, path)
    sinks.ensure_collection(spark, path)
    row = ("s1", "t", "function_code", "f.py", "f", 1, "f.py::func::f", None)
    df = spark.createDataFrame([row, row, ("s2", None, "comment", "g.py", "g", None, "x", None)], sinks.SNIPPET_SCHEMA)
    stats = sinks.append_snippets(df, path, quarantine=os.path.join(scratch, "bad"))
    assert stats == {"rows": 3, "failed": 1}
    counts = {(r.snapshot_id, r.type): r.n for r in sinks.collection_counts(spark, path).collect()}
    assert counts[("s1", "function_code")] == 2 and counts[(None, None)] == 2
    sinks.replace_snapshots(spark.createDataFrame([("s1", "u", "comment", "f.py", "f", None, "y", None)],
                                                  sinks.SNIPPET_SCHEMA), path)
    assert spark.read.parquet(path).count() == 1
    assert sinks.drop_snapshot(spark, path, "s1")


def test_drop_snapshot_of_any_name(spark, scratch):
    path = os.path.join(scratch, "snippets")
    ids = ["org/repo@abc", "..", "../other", "a=b", "x y%2F"]
    rows = [(i, "t", "comment", "f.py", "f", 1, "id", None) for i in ids]
    sinks.append_snippets(spark.createDataFrame(rows, sinks.SNIPPET_SCHEMA), path)
    for n, i in enumerate(ids, 1):
        assert sinks.drop_snapshot(spark, path, i) and not sinks.drop_snapshot(spark, path, i)
        assert spark.read.schema(sinks.SNIPPET_SCHEMA).parquet(path).count() == len(ids) - n
    assert os.path.isdir(path)


def test_results_are_resumable(spark, scratch):
    path = os.path.join(scratch, "results")
    r = spark.createDataFrame([(1, "a"), (2, "b")], "issue_id long, v string")
    assert sinks.append_results(r, path, "run1") == 2
    r2 = spark.createDataFrame([(2, "b"), (3, "c")], "issue_id long, v string")
    assert sinks.append_results(r2, path, "run2") == 1
    assert sorted(x.issue_id for x in spark.read.parquet(path).collect()) == [1, 2, 3]


def test_checkout_to_results_end_to_end(spark, scratch):
    from codeloom.plans.workflow import ingest, run_issues
    _write(scratch, "pkg/tags.py", b"def has_tag(d, t):\n    return t in d\n\ndef read(d):\n    return has_tag(d, 1)\n")
    _write(scratch, "pkg/util.py", b"import pkg.tags as T\n\nclass Reader:\n    def run(self):\n        return T.read({})\n")
    kb = ingest(files.source_files(spark, scratch, "snap"))
    issues = spark.createDataFrame([(1, 0, "snap", "org/repo", "abc", "has_tag fails in read")],
                                   "issue_id long, issue_idx long, snapshot_id string, repo string, "
                                   "base_commit string, problem_statement string")
    rows = run_issues(issues, kb).collect()
    assert len(rows) == 1 and len(rows[0]) == 17  # issue_id + the 16 result columns
    r = rows[0]
    assert r.serial_no == 1 and r.vector_query and r.best_patch_score is not None and r.all_patches
