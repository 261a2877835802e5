"""Customer behaviour: repeat buying, shipping experience."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlens.functions import metrics as M
from ledgerlens.functions.bands import shipping_experience


def repeat_buyers(df: DataFrame, customer_key: str = "customer_name",
                  order_key: str = "order_id") -> DataFrame:
    """Customers with exactly one distinct order against those with more."""
    per_customer = df.groupBy(customer_key).agg(F.countDistinct(order_key).alias("_orders"))
    return per_customer.agg(
        M.count_if(F.col("_orders") == 1).alias("ordered_only_once"),
        M.count_if(F.col("_orders") > 1).alias("ordered_more_than_once"),
    )


def shipping_vs_repeat(df: DataFrame, customer_key: str = "customer_id",
                       order_key: str = "order_id", mean_days: Column | None = None
                       ) -> DataFrame:
    """Mean lifetime orders and customer count per shipping-delay band.

    Per customer: distinct orders and mean shipping days; the mean picks a
    band (>= 5, >= 3, else, NULL in the last); then the bands are averaged.
    ``mean_days`` replaces the line-level mean, e.g. for rows folded per order.
    """
    days = mean_days if mean_days is not None else M.mean(M.ship_days())
    per_customer = df.groupBy(customer_key).agg(
        F.countDistinct(order_key).alias("_orders"),
        days.alias("_avg_ship"))
    return (per_customer.groupBy(shipping_experience("_avg_ship").alias("shipping_experience"))
            .agg(M.rounded(M.mean("_orders")).alias("avg_lifetime_orders"),
                 M.rows().alias("total_customers_in_group"))
            .orderBy(F.col("avg_lifetime_orders").desc(), "shipping_experience"))
