"""Content-addressed parsing (S2 + X1): a blob is parsed once, whatever snapshots and paths hold it.

The store is a table of parsed blobs by blob sha, appended to.  Adding a snapshot's files leaves known
blobs out by an anti join, parses each distinct new blob once, and appends; reading joins the files'
narrow rows (snapshot, path, sha) to the stored symbols.  So a snapshot that shares 90% of its files
with an earlier one costs a tenth of its parsing.

One writer at a time; a file without a sha gets that of its content; a null content is an empty file.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.pyparse import ARROW_SCHEMA, SPARK_SCHEMA, parse_batches
from ..session import cut_lineage, ensure_checkpoint_dir

_KEY = "snapshot_id string, path string, "
_SYMBOLS = [n for n in ARROW_SCHEMA.names if n not in ("snapshot_id", "path")]
_STORED = "blob_sha string, " + SPARK_SCHEMA.removeprefix(_KEY)


class ParseStore:
    def __init__(self, spark: SparkSession, path: str | None = None):
        self.spark, self.path = spark, path or f"{ensure_checkpoint_dir(spark)}/parse-store-{uuid.uuid4().hex}"

    def _named(self, files: DataFrame) -> DataFrame:
        content = F.coalesce("content", F.lit(""))
        return files.select("snapshot_id", "path", content.alias("content"), F.coalesce("blob_sha", F.sha1(content)).alias("blob_sha"))

    def blobs(self) -> DataFrame:
        """The stored rows: blob_sha, parse_error and the symbol arrays; none before the first ``add``."""
        p = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        if not p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(p):
            return self.spark.createDataFrame([], _STORED)
        return self.spark.read.schema(_STORED).parquet(self.path)

    def add(self, files: DataFrame) -> DataFrame:
        """Parse the blobs of ``files`` (snapshot_id, path, content, blob_sha) that the store lacks; returns their shas (blob_sha)."""
        lacking = self._named(files).join(self.blobs().select("blob_sha"), "blob_sha", "left_anti")
        # Equal contents are combined before the exchange.
        once = lacking.groupBy("blob_sha").agg(F.min("content").alias("content"))
        rows = once.select(F.lit("").alias("snapshot_id"), F.col("blob_sha").alias("path"), "content")
        parsed = cut_lineage(rows.mapInArrow(parse_batches, SPARK_SCHEMA).select(F.col("path").alias("blob_sha"), *_SYMBOLS))
        parsed.write.mode("append").parquet(self.path)
        return parsed.select("blob_sha")

    def parsed(self, files: DataFrame) -> DataFrame:
        """What ``symbols.parse`` gives for these files, with blob_sha, from the store; files that were never added are left out."""
        at = self._named(files).select("snapshot_id", "path", "blob_sha")
        return at.join(self.blobs(), "blob_sha").select("snapshot_id", "path", "blob_sha", *_SYMBOLS)
