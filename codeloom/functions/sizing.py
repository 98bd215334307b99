"""Broadcast only behind a proven size bound."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Row bound of a side that is sent whole; for rows of fixed width (ids, vectors).
DEFAULT_MAX_BROADCAST_ROWS = 2_000_000
# Byte bound of a side with strings.
MAX_BROADCAST_BYTES = 64 << 20


def fits(df: DataFrame, max_rows: int) -> bool:
    """True if ``df`` has at most ``max_rows`` rows.

    The probe stops after ``max_rows + 1`` rows, so its cost is bounded even
    when the answer is no.
    """
    return df.limit(max_rows + 1).count() <= max_rows


def fits_bytes(df: DataFrame, strings: list[str | Column], row_bytes: int = 48, max_bytes: int = MAX_BROADCAST_BYTES) -> bool:
    """True if the rows of ``df``, with these string columns and ``row_bytes`` for the rest of a row, fit ``max_bytes``."""
    size = sum([F.coalesce(F.octet_length(c), F.lit(0)) for c in strings], F.lit(row_bytes))
    return (df.agg(F.sum(size.cast("long"))).first()[0] or 0) <= max_bytes


def exchanged(df: DataFrame) -> DataFrame:
    """A join side of any size that is never sent whole, whatever its plan's estimate says.

    The estimate does not count the rows that exploded arrays or Python stages make, and a checkpoint
    keeps it, so tables made of parsed files look small and would be broadcast through the driver at any size.
    The merge join splits keys that are a large share of the other side.
    """
    return df.hint("merge")


def spread(df: DataFrame, *keys: str, min_partitions: int | None = None) -> DataFrame:
    """Hash-repartition ``df`` on ``keys`` only if it has fewer partitions than the
    cluster can run at once.

    Used before CPU-heavy row work (parsing, tokenizing, Python batches): a
    large input already arrives in many splits and is left alone, so no text
    is shuffled at scale; a few big files are spread over all cores.
    Asking for the partitions of an aggregated input runs its shuffles; use it on table scans.
    """
    spark = df.sparkSession
    target = min_partitions or spark.sparkContext.defaultParallelism
    if df.rdd.getNumPartitions() >= target:
        return df
    return df.repartition(target, *keys) if keys else df.repartition(target)
