"""S1 issue table scan with an explicit row index."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# The reference processes rows 11..20 of its issue table (0-based, inclusive).
START_IDX = 11
END_IDX = 20


def issue_slice(issues: DataFrame, idx_col: str = "issue_idx", lo: int = START_IDX,
                hi: int = END_IDX) -> DataFrame:
    """Rows whose stored 0-based index lies in [lo, hi]; serial_no = index + 1.

    The index must be a stored column (file order recorded at ingest), never
    a generated id; the predicate then prunes row groups at the scan.
    """
    return (issues.filter(F.col(idx_col).between(lo, hi))
            .withColumn("serial_no", F.col(idx_col) + 1))
