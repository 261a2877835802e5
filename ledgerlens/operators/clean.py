"""Typing and cleaning of raw order lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DateType

# Sales are rounded once, from their full value; discount and profit keep the digits
# given (up to ten places).
EXACT = "decimal(38,18)"
CLEAN_TYPES = {
    "row_id": "bigint",
    "sales": "decimal(18,2)",
    "quantity": "int",
    "discount": "decimal(18,10)",
    "profit": "decimal(28,10)",
}
DATE_COLUMNS = ("order_date", "ship_date")


def parse_us_date(x) -> Column:
    """Month-first date text to DATE.

    ``11/8/2016`` and ``11-8-2016`` read month/day/year as in the reference. An
    ISO ``2016-11-08`` also contains '-', which the reference would misread;
    here it is tried as ISO when the month-first reading fails. Anything
    unparseable becomes NULL instead of failing the job.
    """
    c = F.col(x) if isinstance(x, str) else x
    t = F.trim(c)
    return (F.when(t.contains("/"), F.try_to_date(t, "M/d/yyyy"))
            .when(t.contains("-"), F.coalesce(F.try_to_date(t, "M-d-yyyy"),
                                              F.try_to_date(t, "yyyy-M-d")))
            .otherwise(t.try_cast("date")))


def clean_orders(df: DataFrame, round_sales: int = 2) -> DataFrame:
    """Parse both dates, fix the numeric types, round sales.

    Narrow transformations only: no shuffle. Columns that are already typed
    (a DATE, a decimal) pass through unchanged, so the job can run twice.
    """
    types = dict(df.dtypes)
    out = df
    for d in DATE_COLUMNS:
        if d in types and not isinstance(df.schema[d].dataType, DateType):
            out = out.withColumn(d, parse_us_date(d))
    for c, t in CLEAN_TYPES.items():
        if c not in types:
            continue
        if c == "sales":
            num = F.trim(F.col(c)).try_cast(EXACT) if types[c] == "string" else F.col(c)
            out = out.withColumn(c, F.round(num, round_sales).cast(t))
        elif types[c] == "string":
            out = out.withColumn(c, F.trim(F.col(c)).try_cast(t))
    return out
