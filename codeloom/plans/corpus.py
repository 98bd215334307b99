"""Issue slice, collection counts and comment extraction over the provided tables."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.snippets import explode_comments
from ..sources.issues import issue_slice as _slice
from ..sources.tables import table


def issues_from_documents(spark: SparkSession, sf: str) -> DataFrame:
    """documents seen as an issue table: doc_id is the stored 0-based row index."""
    d = table(spark, sf, "documents")
    return d.select(F.col("doc_id").alias("issue_idx"), F.col("source").alias("repo"),
                    F.col("lang").alias("base_commit"), F.col("text").alias("problem_statement"))


def issue_slice(spark: SparkSession, sf: str) -> DataFrame:
    return _slice(issues_from_documents(spark, sf)).select(
        "issue_idx", "serial_no", "repo", "base_commit", "problem_statement")


def snippet_count(spark: SparkSession, sf: str) -> DataFrame:
    """Objects per (snapshot, type), per snapshot, and in total (rollup)."""
    d = table(spark, sf, "documents")
    return (d.rollup(F.col("lang").alias("snapshot_id"), F.col("source").alias("type"))
            .agg(F.count(F.lit(1)).alias("n")))


def inline_comments(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "documents")
    return explode_comments(d, "text", ["doc_id"])


# Shorter snippets are rejected by the sink's rule in ``sink_batches``.
LEAST_CHARS = 30


def sink_batches(spark: SparkSession, sf: str) -> DataFrame:
    """The collection ingested in three batches, one of them delivered twice; objects per type, failures per batch."""
    from ..session import ensure_checkpoint_dir
    from ..sources.ledger import Ledger
    d = table(spark, sf, "documents").select("doc_id", "text", F.col("source").alias("type"))
    t = Ledger(spark, f"{ensure_checkpoint_dir(spark)}/snippets-{uuid.uuid4().hex}", "doc_id long, text string, type string")
    bad = F.coalesce(F.length("text") < LEAST_CHARS, F.lit(True))
    for i in (0, 1, 1, 2):
        t.write(d.where(F.pmod("doc_id", F.lit(3)) == i), f"batch-{i}", bad=bad)
    failed = spark.createDataFrame([("failed", b, x["failed"]) for b, x in t.committed().items()], "kind string, name string, n long")
    return t.read().groupBy(F.col("type").alias("name")).agg(F.count("*").alias("n")).select(F.lit("rows").alias("kind"), "name", "n").unionByName(failed)


def _down_for_some():
    """A stand-in for a model whose service fails on some prompts (by their length) and answers the others."""
    def run(prompts):
        if any(len(p) % 3 == 1 for p in prompts):
            raise TimeoutError("the service is down")
        return [str(len(p)) for p in prompts]
    return run


def _answering():
    return lambda prompts: [str(len(p)) for p in prompts]


def issue_states(spark: SparkSession, sf: str) -> DataFrame:
    """S8 with P4: a run whose model fails on some issues leaves those open; the next run, on what is open, ends them."""
    from ..operators.predict import predict
    from ..session import cut_lineage, ensure_checkpoint_dir
    from ..sources.ledger import IssueResults
    issues = table(spark, sf, "benchmark").select(F.col("item_id").alias("issue_id"), "text")
    results = IssueResults(spark, f"{ensure_checkpoint_dir(spark)}/issue-results-{uuid.uuid4().hex}")
    states = []
    for run, model in (("first", _down_for_some), ("second", _answering)):
        answered = predict(results.todo(issues), "text", "answer", model, batch_size=1, error="error")
        results.write(answered.select("issue_id", "answer", F.lit(run).alias("run"), "error"), run)
        states.append(cut_lineage(results.states(issues)))
    first, second = states
    done = results.done.read().select("issue_id", "answer", "run")
    return (first.select("issue_id", F.col("state").alias("after_first")).join(second.select("issue_id", F.col("state").alias("after_second"), "failures"), "issue_id")
            .join(done, "issue_id").select("issue_id", "after_first", "after_second", "failures", "answer", "run"))
