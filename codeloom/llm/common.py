"""Shared helpers of the training-data operators.

Column access is positional-safe (`pick`), intermediate results that several jobs
read are Parquet tables in the shared checkpoint folder (`staged`), and training
rows are chosen by hash against a count (`bounded_sample`), never by order.
"""

from __future__ import annotations

import gc
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir

# A word of every operator here: a run of characters that are not ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
BLANKS = " \t\n\x0b\x0c\r"

_HASH_RANGE = 1 << 20


def pick(df: DataFrame, **wanted: str) -> DataFrame:
    """Columns by exact name under new names: ``pick(docs, doc_id="long", text="string")``.

    Input columns are renamed by position first, so extra columns, columns that differ
    only in case and columns called like an operator's own cannot clash.  The first
    column of a repeated name is taken.  A missing column raises ValueError.
    """
    names = list(df.columns)
    plain = df.toDF(*[f"c{i}" for i in range(len(names))])
    out = []
    for name, kind in wanted.items():
        if name not in names:
            raise ValueError(f"column {name!r} is missing")
        out.append(F.col(f"c{names.index(name)}").cast(kind).alias(name))
    return plain.select(*out)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def held_out(doc_id: Column, divisor: int, remainder: int) -> Column:
    """True where crc32 of the id's text has this remainder; false for a null id."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % divisor == remainder, F.lit(False))


def staged(df: DataFrame, tag: str, row_group: int | None = None) -> DataFrame:
    """``df`` as a Parquet table in the shared folder: survives lost executors, cuts lineage.

    ``row_group``: bytes written and read at once, for wide rows."""
    spark = df.sparkSession
    path = f"{ensure_checkpoint_dir(spark)}/llm-{tag}-{uuid.uuid4().hex}"
    write = df.write.option("compression", "zstd")
    if row_group:
        write = write.option("parquet.block.size", row_group).option("parquet.block.size.row.check.min", 4)
    write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.staged_path = path
    return out


def bucketed(df: DataFrame, key: str, tag: str) -> DataFrame:
    """``df``, one row a key, as a table bucketed by ``key``: joins on it move only their other side.  ``discard`` drops it."""
    spark = df.sparkSession
    n, name = int(spark.conf.get("spark.sql.shuffle.partitions")), f"llm_{tag}_{uuid.uuid4().hex}"
    rest = [F.min(c).alias(c) for c in df.columns if c != key]
    dealt = df.repartition(n, key).groupBy(key).agg(*rest)       # repeats go in the buckets' own partitions
    dealt.write.format("parquet").option("compression", "zstd").bucketBy(n, key).sortBy(key).saveAsTable(name)
    out = spark.table(name)
    out.staged_table = name
    return out


FILTER_BITS = 1 << 24


def likely(rows: DataFrame, wanted: DataFrame, key: list[str]) -> DataFrame:
    """The rows whose key is, up to hash collisions, one of ``wanted``'s: spares a join the others' shuffle.

    A bitmap of FILTER_BITS bits, at most FILTER_BITS / 64 rows of 16 bytes, is sent to ``rows``; where it is full it drops nothing.
    """
    spot = lambda: F.pmod(F.xxhash64(*key), F.lit(FILTER_BITS))
    words = (wanted.select(spot().alias("at")).groupBy(F.shiftright("at", 6).alias("word"))
             .agg(F.bit_or(F.expr("shiftleft(1L, cast(at & 63 as int))")).alias("bits")))
    marked = rows.withColumn("at", spot()).withColumn("word", F.shiftright("at", 6)).join(F.broadcast(words), "word")
    return marked.where(F.expr("(bits & shiftleft(1L, cast(at & 63 as int))) <> 0")).drop("at", "word", "bits")


def discard(*tables: DataFrame) -> None:
    """Delete staged tables that no later job reads, and let the shuffles behind them go."""
    for t in tables:
        if hasattr(t, "staged_table"):
            t.sparkSession.sql(f"DROP TABLE IF EXISTS {t.staged_table}")
            continue
        jvm, jsc = t.sparkSession._jvm, t.sparkSession.sparkContext._jsc
        path = jvm.org.apache.hadoop.fs.Path(t.staged_path)
        path.getFileSystem(jsc.hadoopConfiguration()).delete(path, True)
    if tables:
        release(tables[0].sparkSession)


def release(spark: SparkSession) -> None:
    """Shuffle files of finished jobs are removed once the driver's JVM has collected their owners."""
    gc.collect()
    spark._jvm.System.gc()


def bounded_sample(df: DataFrame, key: Column, most: int, by: str | None = None, seed: int = 17) -> DataFrame:
    """About ``most`` rows (per value of ``by``), chosen by a hash of ``key`` against the row count.

    Repeatable, order-free and without a sort; the bound holds in expectation.  ``by`` must have few
    values: callers have them on the driver.
    """
    where = F.pmod(F.xxhash64(key, F.lit(seed)), F.lit(_HASH_RANGE))
    if by is None:
        n = df.count()
        return df if n <= most else df.where(where < int(_HASH_RANGE * most / n))
    counts = df.groupBy(by).count()
    keep = counts.select(F.col(by).alias("_by"), F.least(F.lit(1.0), F.lit(float(most)) / F.col("count")).alias("_share"))
    # One row a value of ``by`` (languages, labels): sent to the rows, so no text is dealt by it.
    return (df.join(F.broadcast(keep), df[by] == keep["_by"]).where(where < F.col("_share") * _HASH_RANGE).drop("_by", "_share"))


def labelled_sample(docs: DataFrame, marks: DataFrame, most: int, seed: int) -> tuple[DataFrame, dict[int, int]]:
    """One row of ``docs`` (doc_id, text) for each of about ``most`` labelled ids a label, and the labels' counts.

    Of rows that repeat an id the text with the smallest hash is taken, whatever their order.

    The sample is drawn from the (doc_id, label) table, so its ids are few and are sent to the
    documents; no text is shuffled.  The counts are one number a label, two labels.
    """
    sizes = {r["label"]: r["count"] for r in marks.groupBy("label").count().collect()}
    ids = bounded_sample(marks, F.col("doc_id"), most, by="label", seed=seed)
    rows = docs.join(F.broadcast(ids), "doc_id").groupBy("doc_id", "label").agg(F.min(F.struct(F.xxhash64("text").alias("h"), "text")).alias("r"))
    return rows.select("doc_id", "r.text", "label"), sizes


def text_slices(batch_texts, most_bytes: int = 1 << 21):
    """(from, to) row ranges of an Arrow string array whose text stays near ``most_bytes``; one longer text stands alone."""
    import numpy as np
    n = len(batch_texts)
    if not n:
        return
    offsets = np.frombuffer(batch_texts.buffers()[1], dtype=offset_type(batch_texts))[batch_texts.offset:batch_texts.offset + n + 1]
    at = 0
    while at < n:
        end = int(np.searchsorted(offsets, offsets[at] + most_bytes, side="right")) - 1
        end = min(n, max(end, at + 1))
        yield at, end
        at = end


def offset_type(array):
    import numpy as np
    import pyarrow as pa
    return np.int64 if pa.types.is_large_string(array.type) else np.int32
