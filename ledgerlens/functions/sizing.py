"""Size checks that decide between a broadcast and a shuffle."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def row_count_at_most(df: DataFrame, max_rows: int) -> bool:
    """True when ``df`` has at most ``max_rows`` rows.

    A plain COUNT: on a stored parquet table it needs no column data (row
    counts come from the row-group metadata) and each task sends one partial
    count to the final sum. A ``limit(n + 1)`` check would instead send up to
    n + 1 rows from every partition to a single task.
    """
    return df.count() <= max_rows


def broadcast_if_bounded(df: DataFrame, max_rows: int) -> DataFrame:
    """Hint a broadcast only after a count proves the side small.

    A side above the bound is returned unchanged: the planner shuffles it, and
    AQE may still broadcast it once real sizes are known. Meant for stored or
    checkpointed data; counting a derived frame would compute it twice.
    """
    return F.broadcast(df) if row_count_at_most(df, max_rows) else df
