"""Workbook-style reports: pivot with totals, rollups with a grand total."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlens.functions import metrics as M

# Fixed value: the label of the grand-total row, as in the workbook.
GRAND_TOTAL = "Grand Total"


def rate_tag(rate) -> str:
    """Column tag for a discount rate: 0.08 -> d008."""
    return f"d{int((Decimal(str(rate)) * 100).to_integral_value()):03d}"


def segment_discount_pivot(cells: DataFrame, row: str = "customer_segment",
                           col: str = "discount") -> DataFrame:
    """Sum of profit and of sales per (segment, rate), with all totals, as rows.

    ``cells`` has ``row``, ``col``, ``profit`` and ``sales`` at any grain. The pivot table's
    totals are the rows with ``row_total`` / ``col_total`` = 1: per segment over its rates,
    per rate over all segments, and the grand total. Any number of rates; ``wide`` lays
    the rows out as columns.
    """
    out = cells.cube(row, col).agg(
        M.as_money(F.sum("profit")).alias("profit"), M.as_money(F.sum("sales")).alias("sales"),
        F.grouping(row).cast("long").alias("row_total"), F.grouping(col).cast("long").alias("col_total"))
    named = F.when(F.col("row_total") == 1, F.lit(GRAND_TOTAL)).otherwise(F.col(row))
    return out.withColumn(row, named).select(
        row, F.col(col).cast("double").alias(col), "profit", "sales", "row_total", "col_total")


def wide(pivot: DataFrame, rates: list, row: str = "customer_segment", col: str = "discount"
         ) -> DataFrame:
    """The pivot as a table: a row per segment, columns for the caller's ``rates``.

    Empty cells stay NULL, as blanks in the workbook; totals cover every rate.
    """
    aggs = []
    for v in rates:
        hit = (F.col(col) == F.lit(float(v))) & (F.col("col_total") == 0)
        aggs += [F.max(F.when(hit, F.col(m))).alias(f"{m}_{rate_tag(v)}") for m in ("profit", "sales")]
    aggs += [F.max(F.when(F.col("col_total") == 1, F.col(m))).alias(f"total_{m}")
             for m in ("profit", "sales")]
    return pivot.groupBy("row_total", row).agg(*aggs).orderBy("row_total", row).drop("row_total")


def mean_with_grand_total(df: DataFrame, key: str, value: str, name: str, folded: bool = False
                          ) -> DataFrame:
    """Mean of ``value`` per ``key`` plus a grand-total row.

    The total is the mean over all rows, not the mean of the means: ROLLUP
    computes it from the same partial aggregates. ``folded`` rows hold sums and counts.
    """
    mean = M.folded_mean(value) if folded else M.mean(value)
    return (df.rollup(key).agg(M.rounded(mean).alias(name),
                               F.grouping_id().cast("long").alias("grand_total"))
            .orderBy("grand_total", key))


def sum_by_two_with_grand_total(df: DataFrame, outer: str, inner: str, value: str,
                                name: str) -> DataFrame:
    """Sum per (outer, inner) plus one grand-total row, no subtotals.

    GROUPING SETS ((outer, inner), ()) in one aggregation; written flat, the
    outer key on every row.
    """
    return (df.groupingSets([[outer, inner], []], outer, inner)
            .agg(F.sum(value).cast("double").alias(name),
                 F.grouping_id().cast("long").alias("grand_total"))
            .orderBy("grand_total", outer, inner))
