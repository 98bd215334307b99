"""Collections and result tables on parquet paths, partitioned by snapshot."""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.observation import Observation

SNIPPET_SCHEMA = T.StructType([
    T.StructField("snapshot_id", T.StringType()), T.StructField("text", T.StringType()),
    T.StructField("type", T.StringType()), T.StructField("file", T.StringType()),
    T.StructField("name", T.StringType()), T.StructField("lineno", T.IntegerType()),
    T.StructField("snippet_id", T.StringType()),
    T.StructField("embedding", T.ArrayType(T.FloatType())),
])


def _fs(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def ensure_collection(spark: SparkSession, path: str, schema: T.StructType = SNIPPET_SCHEMA,
                      partition_by: str = "snapshot_id") -> DataFrame:
    """S3: create the collection once (empty, with its schema); reuse it if it exists."""
    fs, p = _fs(spark, path)
    if not fs.exists(p):
        spark.createDataFrame([], schema).write.partitionBy(partition_by).parquet(path)
    return spark.read.schema(schema).parquet(path)


def append_snippets(df: DataFrame, path: str, quarantine: str | None = None,
                    partition_by: str = "snapshot_id") -> dict:
    """S4 + S5: append (no key dedupe; repeated snippet ids persist), count failures.

    Rows without text or type are not ingested; they go to ``quarantine`` if given.
    Returns {'rows': n, 'failed': m} observed during the write itself.
    """
    bad = F.col("text").isNull() | F.col("type").isNull()
    obs = Observation("ingest")
    # With a quarantine both halves read one stored result, so embeddings are computed once.
    df = df.persist(StorageLevel.DISK_ONLY) if quarantine else df
    tagged = df.observe(obs, F.count(F.lit(1)).alias("rows"), F.count_if(bad).alias("failed"))
    tagged.filter(~bad).write.mode("append").partitionBy(partition_by).parquet(path)
    stats = obs.get
    if quarantine:
        if stats.get("failed", 0):
            df.filter(bad).write.mode("append").parquet(quarantine)
        df.unpersist()
    return stats


def collection_counts(spark: SparkSession, path: str) -> DataFrame:
    """Objects per (snapshot, type), per snapshot and in total."""
    c = spark.read.parquet(path)
    return c.rollup("snapshot_id", "type").agg(F.count(F.lit(1)).alias("n"))


def replace_snapshots(df: DataFrame, path: str, partition_by: str = "snapshot_id") -> None:
    """S7 (re-ingest): overwrite only the snapshot partitions present in ``df``."""
    (df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
     .partitionBy(partition_by).parquet(path))


def drop_snapshot(spark: SparkSession, path: str, snapshot_id: str, partition_by: str = "snapshot_id") -> bool:
    """S7 (delete): remove one snapshot's partition from a collection or graph table."""
    # The folder name as Spark writes it: owner/name@sha is escaped, so no id reaches outside the table.
    name = spark.sparkContext._jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils.escapePathName(snapshot_id)
    fs, p = _fs(spark, f"{path.rstrip('/')}/{partition_by}={name}")
    return bool(fs.delete(p, True)) if fs.exists(p) else False


def append_results(results: DataFrame, path: str, run_id: str, key: str = "issue_id",
                   skip_finished: bool = True) -> int:
    """Resumable result sink.  Appends this run's rows under ``run_id``; with
    ``skip_finished`` issues already present are not written again (left anti join).
    Returns the number of rows written."""
    spark = results.sparkSession
    out = results.withColumn("run_id", F.lit(run_id))
    fs, p = _fs(spark, path)
    if skip_finished and fs.exists(p):
        done = spark.read.parquet(path).select(key).distinct()
        out = out.join(done, key, "left_anti")
    obs = Observation("results")
    out.observe(obs, F.count(F.lit(1)).alias("written")).write.mode("append").partitionBy("run_id").parquet(path)
    return int(obs.get.get("written", 0))


def unfinished(issues: DataFrame, path: str, key: str = "issue_id") -> DataFrame:
    """The issues without a row in the result table; asked before any model runs."""
    fs, p = _fs(issues.sparkSession, path)
    if not fs.exists(p):
        return issues
    return issues.join(issues.sparkSession.read.parquet(path).select(key).distinct(), key, "left_anti")
