"""S2 snapshot file scan and S9 whole-text source."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SOURCE_GLOB = "*.py"


def git_blob_sha(content: Column) -> Column:
    """sha1 of 'blob <size>\\0' + bytes: the id git gives the file's content."""
    header = F.encode(F.concat(F.lit("blob "), F.octet_length(content).cast("string"), F.lit("\u0000")), "UTF-8")
    return F.sha1(F.concat(header, content))


def source_files(spark: SparkSession, root: str, snapshot_id: str, glob: str | None = SOURCE_GLOB) -> DataFrame:
    """(snapshot_id, path, content, blob_sha) for every file under ``root`` matching ``glob``.

    Recursive; ``glob=None`` keeps every file.  Content is decoded as UTF-8
    with invalid bytes replaced by U+FFFD; unreadable files are skipped.
    ``path`` is relative to ``root``; it is also the walk-order key (bytewise).
    """
    return snapshots(spark, {snapshot_id: root}, glob)


# Roots of one scan, at most: they are a literal map in its plan.
MAX_ROOTS = 10_000


def snapshots(spark: SparkSession, roots: dict[str, str], glob: str | None = SOURCE_GLOB) -> DataFrame:
    """``source_files`` of many snapshots (snapshot id -> root) in one scan; the snapshot follows from the path.

    A root that is missing or cannot be listed gives no rows.  Where a root lies in another, its files belong to both.
    """
    if len(roots) > MAX_ROOTS:
        raise ValueError(f"more than {MAX_ROOTS} roots; scan them in several calls")
    jvm, conf = spark._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    there: dict[str, list[str]] = {}
    for snapshot, root in roots.items():
        path = jvm.org.apache.hadoop.fs.Path(root)
        fs = path.getFileSystem(conf)
        try:
            fs.listStatus(path)
            # As the scan writes paths: with the file system's scheme, without a slash at the end.
            there.setdefault(fs.resolvePath(path).toUri().toString().rstrip("/"), []).append(snapshot)
        except Exception:  # noqa: BLE001 - Java's: not found, no permission
            continue
    columns = "snapshot_id string, path string, content string, blob_sha string"
    if not there:
        return spark.createDataFrame([], columns)
    r = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("ignoreCorruptFiles", "true")
    if glob:
        r = r.option("pathGlobFilter", glob)
    # A root within another is read by the outer one's scan.
    outer = [u for u in there if not any(u.startswith(v + "/") for v in there)]
    plain = lambda c: F.regexp_replace(F.regexp_replace(c, "^([a-zA-Z0-9]+):/+", "$1:/"), "/+$", "")
    known = F.create_map(*[x for u, ids in there.items() for x in (plain(F.lit(u)), F.array(*map(F.lit, sorted(ids))))])
    parts = F.split("whole", "/")
    folders = F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda n: F.array_join(F.slice(parts, 1, n), "/"))
    owners = F.flatten(F.filter(F.transform(folders, lambda d: F.transform(F.element_at("known", d), lambda x: F.struct(x.alias("id"), d.alias("root")))),
                                lambda x: x.isNotNull()))
    found = r.load(outer).withColumn("whole", plain(F.col("path"))).withColumn("known", known)
    rows = found.select("whole", "content", F.explode(owners).alias("o"))
    return rows.select(F.col("o.id").alias("snapshot_id"), F.expr("substring(whole, length(o.root) + 2)").alias("path"),
                       F.make_valid_utf8(F.col("content").cast("string")).alias("content"),
                       git_blob_sha(F.col("content")).alias("blob_sha"))


def whole_text(spark: SparkSession, path: str) -> DataFrame:
    """Each file as one row (path, value) with its whole text."""
    return spark.read.text(path, wholetext=True).select(F.input_file_name().alias("path"), "value")
