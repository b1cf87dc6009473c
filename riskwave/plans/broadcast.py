"""Broadcast behind a size check.

A side is broadcast only after a bounded probe proves it has at most
``max_rows`` rows (``limit(max_rows + 1).count()`` touches at most that
many rows).  Beyond the bound the plain DataFrame is returned and the
join stays a shuffle join that AQE may still convert at runtime when the
materialised side turns out small."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

DEFAULT_MAX_ROWS = 100_000


def bounded_broadcast(df: DataFrame, max_rows: int = DEFAULT_MAX_ROWS) -> DataFrame:
    n = df.limit(max_rows + 1).count()
    return F.broadcast(df) if n <= max_rows else df
