"""Exactly-once batches and issue states."""

import os

from pyspark.sql import functions as F

from codeloom.sources.ledger import IssueResults, Ledger

SCHEMA = "k long, v string"


def test_a_repeated_batch_adds_nothing_and_bad_rows_are_counted(spark, scratch):
    t = Ledger(spark, f"{scratch}/t", SCHEMA)
    assert t.read().collect() == [] and t.committed() == {}
    rows = spark.createDataFrame([(1, "a"), (2, None), (3, "c")], SCHEMA)
    assert t.write(rows, "b/1", bad=F.col("v").isNull()) == {"rows": 2, "failed": 1}
    assert t.write(rows, "b/1", bad=F.col("v").isNull()) == {"rows": 2, "failed": 1}
    assert t.write(rows, "b2") == {"rows": 3, "failed": 0}
    assert t.read().count() == 5 and set(t.committed()) == {"b/1", "b2"}
    assert set(os.listdir(scratch)) == {"t"}


def test_data_of_an_uncommitted_attempt_is_not_read_and_is_replaced(spark, scratch):
    t = Ledger(spark, f"{scratch}/t", SCHEMA)
    t.write(spark.createDataFrame([(1, "a")], SCHEMA), "one")
    spark.createDataFrame([(9, "lost"), (10, "lost")], SCHEMA).write.parquet(f"{scratch}/t/batch=two")      # died before its commit
    assert [r.k for r in t.read().collect()] == [1]
    t.write(spark.createDataFrame([(2, "b")], SCHEMA), "two")
    assert sorted(r.k for r in t.read().collect()) == [1, 2]


def test_two_writers_of_one_batch(spark, scratch):
    t = Ledger(spark, f"{scratch}/t", SCHEMA)
    assert t._commit("x", {"rows": 1, "failed": 0}) and not t._commit("x", {"rows": 2, "failed": 0})
    assert t.info("x") == {"rows": 1, "failed": 0}


def test_states(spark, scratch):
    issues = spark.createDataFrame([(1,), (2,), (3,)], "issue_id long")
    r = IssueResults(spark, f"{scratch}/r")
    assert {x.state for x in r.states(issues).collect()} == {"open"}
    schema = "issue_id long, answer string, error string"
    assert r.write(spark.createDataFrame([(1, "x", None), (2, None, "down")], schema), "a") == {"rows": 1, "failed": 1}
    assert r.write(spark.createDataFrame([(2, None, "down"), (1, "again", None)], schema), "b") == {"rows": 0, "failed": 1}
    assert {(x.issue_id, x.state, x.failures) for x in r.states(issues).collect()} == {(1, "done", 0), (2, "failed", 2), (3, "open", 0)}
    assert sorted(x.issue_id for x in r.todo(issues).collect()) == [2, 3]
    assert r.write(spark.createDataFrame([(2, "y", None)], schema), "c") == {"rows": 1, "failed": 0}
    assert sorted((x.issue_id, x.answer) for x in r.done.read().collect()) == [(1, "x"), (2, "y")]
