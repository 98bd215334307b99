"""V6 top-k per query."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SCORE_DECIMALS = 6


def top_k(df: DataFrame, partition: Sequence[str], score: str, tie: Sequence[str],
          k: int, rank_col: str = "rank") -> DataFrame:
    """Rows with rank <= k per partition, by score desc then ``tie`` asc.

    Catalyst plans this as a WindowGroupLimit below the shuffle, so each task
    sends at most k rows per partition key.
    """
    w = Window.partitionBy(*partition).orderBy(F.col(score).desc(), *[F.col(t).asc() for t in tie])
    return (df.withColumn(rank_col, F.row_number().over(w))
            .filter(F.col(rank_col) <= k))


def rounded(c: Column | str, decimals: int = SCORE_DECIMALS) -> Column:
    """Scores are rounded before ranking so float summation order cannot reorder ties."""
    return F.round(F.col(c) if isinstance(c, str) else c, decimals)
