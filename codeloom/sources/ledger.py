"""S4/S5/S8 exactly-once batches: data folders that count once a manifest entry names them.

A table is a folder with one data folder a batch (``batch=<id>``) and a manifest ``_batches`` with one small
file a committed batch.  A batch is written to its own folder, over whatever an earlier attempt left there, and
then committed by creating its entry, which only one writer can do.  A repeated batch finds its entry and writes
nothing; a run that was lost between the two steps left data that no reader sees.  Readers read the folders of committed
batches only.

Issue results add states: a result row is ``done``; a row with an error goes to a second table of failures and
leaves its issue ``open`` to later runs (``todo``), however often it failed before.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.observation import Observation

from ..session import cut_lineage


class Ledger:
    """The batches of one table under ``path``: rows of ``schema`` (a DDL string or StructType), or of what its files hold."""

    def __init__(self, spark: SparkSession, path: str, schema=None):
        self.spark, self.path = spark, path.rstrip("/")
        self.schema = None if schema is None else spark.createDataFrame([], schema).schema
        self._jvm = spark._jvm
        self._fs = self._path("").getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _path(self, name: str):
        return self._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}" if name else self.path)

    def _folder(self, batch: str) -> str:
        # As Spark escapes partition values, so that no id reaches outside the table.
        return "batch=" + self._jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils.escapePathName(batch)

    def _entry(self, batch: str):
        return self._path(f"_batches/{self._folder(batch)}.json")

    def committed(self) -> dict[str, dict]:
        """Batch id -> {rows, failed} of every committed batch."""
        at = self._path("_batches")
        if not self._fs.exists(at):
            return {}
        out = {}
        for status in self._fs.listStatus(at):
            stream = self._fs.open(status.getPath())
            try:
                entry = json.loads(self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
            finally:
                stream.close()
            out[entry["batch"]] = {k: entry[k] for k in ("rows", "failed")}
        return out

    def info(self, batch: str) -> dict | None:
        """{rows, failed} of one batch, None if it is not committed; reads one entry."""
        if not self._fs.exists(self._entry(batch)):
            return None
        stream = self._fs.open(self._entry(batch))
        try:
            entry = json.loads(self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()
        return {k: entry[k] for k in ("rows", "failed")}

    def write(self, rows: DataFrame, batch: str, bad=None) -> dict:
        """Append ``rows`` as ``batch`` unless it is committed; rows where ``bad`` holds are counted, not written.

        Returns the batch's {rows, failed}, counted while it was written.
        """
        known = self.info(batch)
        if known is not None:
            return known
        bad = F.lit(False) if bad is None else F.coalesce(bad, F.lit(False))
        seen = Observation()
        told = rows.observe(seen, F.count(F.lit(1)).alias("n"), F.count_if(bad).alias("failed"))
        # An earlier attempt's data is replaced: its entry is missing, so nobody has read it.
        told.where(~bad).select(*(self.schema.names if self.schema else rows.columns)).write.mode("overwrite").parquet(f"{self.path}/{self._folder(batch)}")
        done = {"rows": int(seen.get["n"]) - int(seen.get["failed"]), "failed": int(seen.get["failed"])}
        return done if self._commit(batch, done) else self.info(batch)

    def _commit(self, batch: str, done: dict) -> bool:
        """Create the batch's entry; False if another writer has."""
        try:
            out = self._fs.create(self._entry(batch), False)
        except Exception:  # noqa: BLE001 - Java's: it exists
            if self._fs.exists(self._entry(batch)):
                return False
            raise
        try:
            out.write(bytearray(json.dumps({"batch": batch, **done}), "utf-8"))
        finally:
            out.close()
        return True

    def read(self, schema=None) -> DataFrame:
        """The rows of all committed batches; ``schema`` where only some columns are wanted."""
        schema = schema or self.schema
        folders = [f"{self.path}/{self._folder(b)}" for b in sorted(self.committed())]
        if not folders:
            if schema is None:
                raise ValueError("no batch is committed and no schema is given")
            return self.spark.createDataFrame([], schema)
        reader = self.spark.read if schema is None else self.spark.read.schema(schema)
        return reader.parquet(*folders)


class IssueResults:
    """Results and failures of issues, written batch by batch; ``key`` names an issue, ``error`` says why a row failed."""

    def __init__(self, spark: SparkSession, path: str, key: str = "issue_id", error: str = "error", key_type: str = "long"):
        self.key, self.error, self._key = key, error, f"{key} {key_type}"
        self.done, self.failed = Ledger(spark, f"{path}/done"), Ledger(spark, f"{path}/failed", f"{key} {key_type}, {error} string")

    def _finished(self) -> DataFrame:
        return self.done.read(self._key).distinct()

    def todo(self, issues: DataFrame) -> DataFrame:
        """The issues without a result: never tried, or failed so far."""
        return issues.join(self._finished(), self.key, "left_anti")

    def write(self, results: DataFrame, batch: str) -> dict:
        """Store a run's rows (with the error column): results apart from failures, issues that are done not again."""
        known = self.done.info(batch)
        if known is not None:
            return known
        rows = cut_lineage(results)         # read twice
        # Failures are stored first: a run lost between the two repeats both.
        self.failed.write(rows.where(F.col(self.error).isNotNull()), batch)
        done = self.done.write(self.todo(rows.where(F.col(self.error).isNull()).drop(self.error)), batch)
        return {"rows": done["rows"], "failed": self.failed.info(batch)["rows"]}

    def states(self, issues: DataFrame) -> DataFrame:
        """The issues' key with ``state`` (done, failed, open) and ``failures``, how many batches they failed in."""
        done = self._finished().withColumn("_done", F.lit(True))
        failed = self.failed.read().groupBy(self.key).agg(F.count("*").alias("failures"))
        j = issues.select(self.key).join(done, self.key, "left").join(failed, self.key, "left")
        state = F.when(F.col("_done"), "done").when(F.col("failures") > 0, "failed").otherwise("open")
        return j.select(self.key, state.alias("state"), F.coalesce("failures", F.lit(0)).alias("failures"))
