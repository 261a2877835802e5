"""Headline figures: totals, margins, distinct counts, order value."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlens.functions import metrics as M


def kpi_summary(df: DataFrame, where: Column | None = None,
                customer_key: str = "customer_id", order_key: str = "order_id",
                product_key: str = "product_id") -> DataFrame:
    """Revenue, profit, margin %, distinct customers/orders/products, mean ship days.

    One pass: Spark turns the three COUNT(DISTINCT) into one Expand plus a
    two-phase aggregate, each distinct key deduplicated map-side first.
    """
    src = df.where(where) if where is not None else df
    aggs = [
        M.total("sales").alias("revenue"),
        M.total("profit").alias("net_profit"),
        M.margin_pct().alias("profit_margin"),
        F.countDistinct(customer_key).alias("distinct_customers"),
        F.countDistinct(order_key).alias("distinct_orders"),
        F.countDistinct(product_key).alias("distinct_products"),
    ]
    if "order_date" in df.columns and "ship_date" in df.columns:
        aggs.append(M.rounded(M.mean(M.ship_days())).alias("avg_shipping_days"))
    return src.agg(*aggs)


def order_value(df: DataFrame, dims: list[str] = (), order_key: str = "order_id",
                name: str = "avg_order_value", digits: int = 2) -> DataFrame:
    """Mean order total: sum the lines of each order, then average over orders.

    The first aggregation is partial on every executor, so an order with very
    many lines is folded before the shuffle.
    """
    dims = list(dims)
    per_order = df.groupBy(*dims, order_key).agg(F.sum("sales").alias("_order_total"))
    return per_order.groupBy(*dims).agg(M.rounded(M.mean("_order_total"), digits).alias(name))
