"""Product reports: totals against the product mean, popularity rank."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlens.functions import metrics as M
from ledgerlens.operators.ranking import dense_rank_desc
from ledgerlens.session import stored


def product_totals(df: DataFrame, keys=("product_id", "product_name")) -> DataFrame:
    """Exact sales and profit per product."""
    return df.groupBy(*keys).agg(F.sum("sales").alias("total_sales"),
                                 F.sum("profit").alias("total_profit"))


def _materialized_totals(df: DataFrame, keys) -> DataFrame:
    """Product totals written once to the scratch folder.

    The report reads them twice (the means, then the filter); Spark does not
    share the aggregation between a query and its scalar subquery, so without
    this the line table would be aggregated twice.
    """
    return stored(product_totals(df, keys))


def _means(totals: DataFrame):
    """Mean product sales and profit as one scalar subquery (a one-row struct)."""
    return totals.select(F.struct(M.mean("total_sales").alias("s"),
                                  M.mean("total_profit").alias("p"))).scalar()


def star_products(df: DataFrame, keys=("product_id", "product_name")) -> DataFrame:
    """Products whose sales and profit are both above the mean product."""
    totals = _materialized_totals(df, keys)
    means = _means(totals)
    out = totals.where((F.col("total_sales") > means.getField("s"))
                       & (F.col("total_profit") > means.getField("p")))
    return (out.select(*keys, M.rounded("total_sales").cast("double").alias("s"),
                       M.rounded("total_profit").cast("double").alias("p"))
            .orderBy(F.col("s").desc(), *keys))


def dead_weight_products(df: DataFrame, keys=("product_id", "product_name")) -> DataFrame:
    """Products with rounded sales above the mean product and rounded profit < 0."""
    totals = _materialized_totals(df, keys)
    rounded = totals.select(*keys, M.rounded("total_sales").alias("s"),
                            M.rounded("total_profit").alias("p"))
    out = rounded.where((F.col("s") > _means(totals).getField("s")) & (F.col("p") < 0))
    return (out.select(*keys, F.col("s").cast("double").alias("s"),
                       F.col("p").cast("double").alias("p"))
            .orderBy(F.col("s").desc(), *keys))


def popularity_rank(df: DataFrame, keys=("product_id", "product_name"),
                    count_name: str = "product_counting", rank_name: str = "popular_rank"
                    ) -> DataFrame:
    """Lines per product and DENSE_RANK of that count, most bought first."""
    return rank_counts(df.groupBy(*keys).agg(M.rows().alias(count_name)), keys, count_name, rank_name)


def rank_counts(counts: DataFrame, keys=("product_id", "product_name"),
                count_name: str = "product_counting", rank_name: str = "popular_rank") -> DataFrame:
    """DENSE_RANK of counted products.

    The rank is computed on the distinct counts (few) and joined back, not by
    a window over all products in one task.
    """
    return dense_rank_desc(counts, count_name, rank_name).select(
        *keys, count_name, rank_name).orderBy(rank_name, *keys)
