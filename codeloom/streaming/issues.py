"""The workflow's resumable issue loop as a stream.

New issue files landing in a folder are read with ``readStream``; each
micro-batch runs the same batch job (``run_issues``) against the
ingested knowledge base and appends its result rows through the exactly-once
sink (finished issues are skipped, a repeated micro-batch writes nothing, issues
whose model calls failed stay open and are tried again with the next files).  Stream progress lives under the
session's checkpoint folder, so a restarted query resumes where it stopped.
No new operator: this is W2-W4 + S8 driven by file arrival.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from ..plans.workflow import run_issues
from ..sources.ledger import IssueResults

ISSUE_SCHEMA = T.StructType([
    T.StructField("issue_id", T.LongType()), T.StructField("issue_idx", T.LongType()),
    T.StructField("snapshot_id", T.StringType()), T.StructField("repo", T.StringType()),
    T.StructField("base_commit", T.StringType()), T.StructField("problem_statement", T.StringType()),
])


def start(spark: SparkSession, issue_dir: str, kb: dict[str, DataFrame], results_path: str,
          progress_path: str, name: str = "issues", available_now: bool = True, provider_prefix: str = "stub"):
    """Start the stream; returns the StreamingQuery.  ``kb`` comes from ``plans.workflow.ingest``.

    ``progress_path`` (shared, kept between applications) holds the stream's progress, so a restart
    reads new files only; issues that already have a result are left out before any model runs.
    """
    issues = spark.readStream.schema(ISSUE_SCHEMA).parquet(issue_dir)

    def each(batch: DataFrame, batch_id: int) -> None:
        results = IssueResults(spark, results_path)
        # Failed issues of earlier files are tried again beside the new ones.
        known = spark.read.schema(ISSUE_SCHEMA).parquet(issue_dir)
        again = known.join(results.failed.read().select("issue_id").distinct(), "issue_id", "left_semi")
        todo = results.todo(batch.unionByName(again.select(*batch.columns)).dropDuplicates(["issue_id"]))
        if not todo.isEmpty():
            results.write(run_issues(todo, kb, provider_prefix, errors=True), f"batch-{batch_id}")

    w = issues.writeStream.foreachBatch(each).option("checkpointLocation", progress_path).queryName(name)
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="30 seconds")
    return w.start()
