"""The streamed issue loop processes each issue once, across restarts."""

import os

from codeloom.plans.workflow import ingest
from codeloom.sources.ledger import IssueResults
from codeloom.streaming.issues import ISSUE_SCHEMA, start


def test_stream_appends_each_issue_once(spark, scratch):
    src = [("s", "m.py", "def helper(v):\n    return check(v)\n\ndef check(v):\n    return v\n")]
    kb = ingest(spark.createDataFrame(src, "snapshot_id string, path string, content string"))
    inbox, out = os.path.join(scratch, "inbox"), os.path.join(scratch, "results")
    rows = [(1, 0, "s", "r", "c", "helper fails on check"), (2, 1, "s", "r", "c", "check returns v")]
    spark.createDataFrame(rows, ISSUE_SCHEMA).write.mode("append").parquet(inbox)
    progress = os.path.join(scratch, "progress")
    start(spark, inbox, kb, out, progress, name="t1").awaitTermination()
    done = lambda: sorted(r.issue_id for r in IssueResults(spark, out).done.read().collect())
    assert done() == [1, 2]
    # a restarted stream sees nothing new, and a re-delivered issue is skipped
    spark.createDataFrame(rows[:1], ISSUE_SCHEMA).write.mode("append").parquet(inbox)
    start(spark, inbox, kb, out, progress, name="t1").awaitTermination()
    assert done() == [1, 2]
    # a stream without its progress (another application) finds nothing to ask a model about
    from codeloom.operators import predict as P
    before = dict(P.PROVIDERS)

    def none():
        raise AssertionError("a model was asked for")
    P.PROVIDERS.update({k: none for k in before})
    try:
        start(spark, inbox, kb, out, os.path.join(scratch, "progress2"), name="t2").awaitTermination()
    finally:
        P.PROVIDERS.update(before)
    assert done() == [1, 2]


def test_an_issue_whose_model_call_failed_stays_open(spark, scratch):
    from codeloom.operators import predict as P
    from codeloom.plans.workflow import run_issues
    src = [("s", "m.py", "def helper(v):\n    return check(v)\n\ndef check(v):\n    return v\n")]
    kb = ingest(spark.createDataFrame(src, "snapshot_id string, path string, content string"))
    rows = [(1, 0, "s", "r", "c", "helper fails on check"), (2, 1, "s", "r", "c", "check returns v")]
    issues = spark.createDataFrame(rows, ISSUE_SCHEMA)

    def failing():
        def run(prompts):
            raise TimeoutError("the service is down")
        return run
    P.PROVIDERS.update({f"bad-{k}": P.PROVIDERS[f"stub-{k}"] for k in ("keywords", "queries", "score")} | {"bad-patch": failing})
    results = IssueResults(spark, f"{scratch}/results")
    try:
        assert results.write(run_issues(results.todo(issues), kb, "bad", errors=True), "run1") == {"rows": 0, "failed": 2}
        assert {(r.state, r.failures) for r in results.states(issues).collect()} == {("failed", 1)}
        assert "service is down" in results.failed.read().first()["error"]
        assert results.write(run_issues(results.todo(issues), kb, "stub", errors=True), "run2") == {"rows": 2, "failed": 0}
    finally:
        for k in ("keywords", "queries", "patch", "score"):
            P.PROVIDERS.pop(f"bad-{k}")
    assert {(r.issue_id, r.state) for r in results.states(issues).collect()} == {(1, "done"), (2, "done")}
    assert results.todo(issues).collect() == [] and len(results.done.read().columns) == 17
