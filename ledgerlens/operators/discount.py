"""Full-price against discounted sales: how much discounting costs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlens.functions import metrics as M


def _full_price():
    return F.col("discount") == 0


def _discounted():
    return F.col("discount") > 0


def discount_split(df: DataFrame, dims=("category",)) -> DataFrame:
    """Four conditional sums per group: profit and sales at full price and discounted."""
    return df.groupBy(*dims).agg(
        M.sum_if(_full_price(), "profit").alias("full_profit"),
        M.sum_if(_full_price(), "sales").alias("full_sales"),
        M.sum_if(_discounted(), "profit").alias("disc_profit"),
        M.sum_if(_discounted(), "sales").alias("disc_sales"),
    )


def margin_damage(df: DataFrame, dims=("category",)) -> DataFrame:
    """Full-price margin %, discounted margin %, and the drop in points."""
    split = discount_split(df, dims)
    full = F.round(M.ratio("full_profit", "full_sales") * 100, 2)
    disc = F.round(M.ratio("disc_profit", "disc_sales") * 100, 2)
    return (split.select(*dims, full.alias("full_price_margin_pct"),
                         disc.alias("discounted_margin_pct"))
            .withColumn("margin_drop_pct",
                        F.round(F.col("full_price_margin_pct") - F.col("discounted_margin_pct"), 2))
            .orderBy(F.col("margin_drop_pct").desc_nulls_last(), *dims))


def profit_difference(df: DataFrame, dims=("category",)) -> DataFrame:
    """Full-price profit, discounted profit and their difference.

    Ordered by the difference: the reference named a column it does not have.
    """
    split = discount_split(df, dims)
    return (split.select(*dims, M.as_money("full_profit").alias("full_profit"),
                         M.as_money("disc_profit").alias("disc_profit"),
                         F.round(F.col("full_profit") - F.col("disc_profit"), 2)
                         .cast("double").alias("difference_profit"))
            .orderBy(F.col("difference_profit").desc_nulls_last(), *dims))
