"""Profit leakage: where and at which discounts money is lost, and what-if caps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerlens.functions import metrics as M
from ledgerlens.functions.bands import bucket_level, discount_bucket


def _loss() -> Column:
    return F.col("profit") < 0


def loss_overview(df: DataFrame, order_key: str = "order_id") -> DataFrame:
    """Losing lines, losing orders, money lost, mean discount % on losses."""
    return df.where(_loss()).agg(
        M.rows().alias("total_losing_rows"),
        F.countDistinct(order_key).alias("total_losing_orders"),
        M.total("profit").alias("total_money_lost"),
        M.mean_pct("discount", 1).alias("avg_discount_on_losses"),
    )


def loss_share(df: DataFrame) -> DataFrame:
    """Percent of lines that lose money, in one pass; NULL without lines."""
    return df.agg(M.ratio(M.count_if(_loss()) * 100.0, M.rows()).alias("per_of_loss"))


def total_loss(df: DataFrame) -> DataFrame:
    """Sum of profit over losing lines."""
    return df.where(_loss()).agg(M.total("profit").alias("total_loss"))


def loss_by(df: DataFrame, dims: list[str], name: str, order: bool = True) -> DataFrame:
    """Sum of profit over losing lines per dimension, worst first."""
    out = df.where(_loss()).groupBy(*dims).agg(M.total("profit").alias(name))
    return out.orderBy(F.col(name).asc(), *dims) if order else out


def worst_per_group(df: DataFrame, group: list[str], within: list[str], name: str,
                    digits: int | None = 2) -> DataFrame:
    """Of the losing lines, the worst ``within`` combination of each ``group``.

    Aggregates first; the window then runs over one row per group, never over
    sale lines.
    """
    agg = df.where(_loss()).groupBy(*group, *within).agg(F.sum("profit").alias("_loss"))
    w = Window.partitionBy(*group).orderBy(F.col("_loss").asc(), *within)
    best = agg.withColumn("_rn", F.row_number().over(w)).where("_rn = 1")
    val = F.round("_loss", digits) if digits is not None else F.col("_loss")
    return best.select(*group, *within, val.cast("double").alias(name)).orderBy(name, *group)


def loss_top(df: DataFrame, dims=("region", "category", "sub_category"), n: int = 10) -> DataFrame:
    """Top-n net-losing (dims x six-way discount bucket) groups, numbered.

    Groups by the six buckets but prints the three-level label, so one
    (region, category, sub-category, High) can show twice, as in the reference.
    Partial aggregate -> shuffle on the keys -> HAVING -> per-partition top n ->
    merge; the row number runs over the n survivors only.
    """
    dims = list(dims)
    grouped = (df.withColumn("discount_bucket", discount_bucket("discount"))
               .groupBy(*dims, "discount_bucket")
               .agg(F.sum("profit").alias("raw_loss"))
               .where(F.col("raw_loss") < 0))
    order = [F.col("raw_loss").asc(), *[F.col(d).asc() for d in dims], F.col("discount_bucket").asc()]
    top = grouped.orderBy(*order).limit(n)
    w = Window.orderBy(*order)
    return top.select(
        F.row_number().over(w).cast("long").alias("rank"),
        *dims,
        bucket_level("discount_bucket").alias("disc_bucket"),
        M.money_text("raw_loss", negative=True).alias("total_loss"),
        F.col("raw_loss").cast("double").alias("raw_loss"),
    )


def loss_impact(df: DataFrame, customer_key: str = "customer_id") -> DataFrame:
    """Total loss, loss as % of all revenue, customers affected, in one pass."""
    loss = F.sum(F.when(_loss(), F.col("profit")))
    return df.agg(
        M.money_text(loss, negative=True).alias("total_profit_loss"),
        F.round(M.ratio(F.abs(loss), F.sum("sales")) * 100, 2).alias("percent_of_total_revenue_lost"),
        F.countDistinct(F.when(_loss(), F.col(customer_key))).alias("customers_affected"),
        F.abs(loss).cast("double").alias("loss_amount"),
    )


def loss_impact_folded(per_order: DataFrame, customer_key: str = "customer_id") -> DataFrame:
    """P18 over orders folded with ``loss`` (sum of losing profit, ``loss_n``
    losing lines) and ``sales``: same figures, customers counted once per order."""
    loss = F.sum("loss")
    return per_order.agg(
        M.money_text(loss, negative=True).alias("total_profit_loss"),
        F.round(M.ratio(F.abs(loss), F.sum("sales")) * 100, 2).alias("percent_of_total_revenue_lost"),
        F.countDistinct(F.when(F.col("loss_n") > 0, F.col(customer_key))).alias("customers_affected"),
        F.abs(loss).cast("double").alias("loss_amount"),
    )


def recovered_if(df: DataFrame, cond: Column, name: str, with_count: str | None = None,
                 folded: bool = False) -> DataFrame:
    """Loss recovered if the lines matching ``cond`` stopped.

    ``folded``: ``df`` holds losing lines already summed per order (``profit``
    and ``n_lines``), so only ``cond`` is applied here.
    """
    lost = F.abs(F.sum("profit"))
    cols = [M.money_text(lost).alias(name), lost.cast("double").alias(name + "_amount")]
    if with_count:
        cols.append((M.folded_rows() if folded else M.rows()).alias(with_count))
    return df.where(cond if folded else _loss() & cond).agg(*cols)


def discount_cap_recovery(df: DataFrame, cap: float = 0.30) -> DataFrame:
    """What-if: stop every line discounted above ``cap``."""
    from decimal import Decimal
    return recovered_if(df, F.col("discount") > F.lit(Decimal(str(cap))),
                        "loss_recovered_if_discount_capped")


def drop_segment_recovery(df: DataFrame, region: str, sub_category: str,
                          ignore_case: bool = False) -> DataFrame:
    """What-if: stop one sub-category in one region (P20)."""
    cond = (M.same_text("region", region, ignore_case)
            & M.same_text("sub_category", sub_category, ignore_case))
    return recovered_if(df, cond, "loss_recovered", with_count="orders_affected")


def drop_segment_recovery_folded(per_order: DataFrame, region: str, ignore_case: bool = False
                                 ) -> DataFrame:
    """P20 over losing lines of the sub-category already summed per order; the
    region, an order-level column, is tested after the fold."""
    return recovered_if(per_order, M.same_text("region", region, ignore_case), "loss_recovered",
                        with_count="orders_affected", folded=True)
