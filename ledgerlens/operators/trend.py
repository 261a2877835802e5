"""Period totals and growth against the previous period.

Fixed values: the output column names are those of the reports that users of the reference
read today.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerlens.functions import metrics as M


def period_growth(df: DataFrame, periods: list[Column], value: str = "sales",
                  names: tuple[str, str, str] = ("current", "previous", "growth_percent"),
                  digits: int = 2) -> DataFrame:
    """Total per period, the previous period's total (LAG) and % change.

    ``periods`` are aliased columns; the series is ordered by them. The
    window runs over one row per period (years, quarters), which is small by
    construction, so a single ordered partition is fine here.
    """
    cur, prev, growth = names
    totals = df.groupBy(*periods).agg(F.round(F.sum(value), digits).alias(cur))
    key_names = [c for c in totals.columns if c != cur]
    w = Window.orderBy(*key_names)
    return (totals.withColumn(prev, F.lag(cur, 1).over(w))
            .withColumn(growth, F.round(M.ratio(F.col(cur) - F.col(prev), F.col(prev)) * 100, 2))
            .select(*key_names, F.col(cur).cast("double").alias(cur),
                    F.col(prev).cast("double").alias(prev), growth)
            .orderBy(*key_names))


def quarter_label(month: Column) -> Column:
    """'Q1'..'Q4' from a month number."""
    return F.concat(F.lit("Q"), F.ceil(month / 3).cast("int").cast("string"))


def pooled_quarter_growth(df: DataFrame, date_col: str = "order_date", value: str = "sales",
                          names=("current_quarter_sales", "prv_quarter_sale", "qoq_growth_percent")
                          ) -> DataFrame:
    """Quarter growth with months pooled over all years, as the reference computes it.

    Month totals (rounded to 2) -> quarter totals -> LAG over Q1..Q4. Kept on
    numbers to the end (the reference reused formatted text in arithmetic).
    """
    months = df.groupBy(F.month(date_col).alias("_m")).agg(
        F.round(F.sum(value), 2).alias("_month_total"))
    quarters = months.groupBy(quarter_label(F.col("_m")).alias("quarter")).agg(
        F.sum("_month_total").alias("_q"))
    cur, prev, growth = names
    w = Window.orderBy("quarter")
    return (quarters.withColumn("_prev", F.lag("_q", 1).over(w))
            .select("quarter", F.col("_q").cast("double").alias(cur),
                    F.col("_prev").cast("double").alias(prev),
                    F.round(M.ratio(F.col("_q") - F.col("_prev"), F.col("_prev")) * 100, 2).alias(growth))
            .orderBy("quarter"))
