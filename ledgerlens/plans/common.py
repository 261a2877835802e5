"""Helpers shared by the registered queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerlens.plans.oracle import with_sales
from ledgerlens.sources.star import SALES_COLUMNS, sales_lines

# money and rate columns are exact DECIMAL inside; reports return DOUBLE
MONEY = ("sales", "profit", "discount")

SHIP_DAYS_SQL = "date_diff('day', order_date, ship_date)"


def money_out(cols):
    return [F.col(c).cast("double").alias(c) if c in MONEY else F.col(c) for c in cols]


def money_out_sql(cols):
    return ", ".join(f"CAST({c} AS DOUBLE) AS {c}" if c in MONEY else c for c in cols)


def scan(spark, d):
    """The whole flat sales view."""
    return sales_lines(spark, d).select(*money_out(SALES_COLUMNS))


SCAN_SQL = with_sales(f"SELECT {money_out_sql(SALES_COLUMNS)} FROM sales")
