"""Recency / frequency / monetary scoring and customer segments."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerlens.functions import metrics as M
from ledgerlens.operators.ranking import highest_per_group
from ledgerlens.operators.selection import ntile_by_cuts
from ledgerlens.session import stored

# ---------------------------------------------------------------------------
# Fixed values that must equal the reference's segment labels, in the order
# the rules are tried (first match wins). Scores run 1..4, 4 is best.
# (label, lowest and highest recency, frequency and monetary score)
SEGMENT_RULES = [
    ("A_ Champion", (4, 4), (4, 4), (4, 4)),
    ("B_ Loyal Customer", (4, 4), (3, 4), (4, 4)),
    ("C_Potential Loyalist", (3, 4), (3, 4), (3, 4)),
    ("D_New Customer", (4, 4), (1, 1), (1, 4)),
    ("E_At Risk Customer", (1, 2), (3, 4), (1, 4)),
    ("F_Lost Customer", (1, 1), (1, 1), (1, 4)),
]
OTHER_LABEL = "Regular Shopper"            # as in the SQL script
OTHER_LABEL_EXPORT = "G_Regular Shopper"   # as in the workbook export
# ---------------------------------------------------------------------------


def latest_date(df: DataFrame, date_col: str = "order_date") -> Column:
    """The newest date in the whole table, as a scalar subquery (one row)."""
    return df.select(F.max(date_col)).scalar()


def recency(df: DataFrame, customer: str = "customer_name", date_col: str = "order_date"
            ) -> DataFrame:
    """Last purchase per customer and days from it to the newest date in the data."""
    # stored once: the newest date overall, the newest of the per-customer dates, is a
    # scalar subquery over this same table
    last = stored(df.groupBy(customer).agg(F.max(date_col).alias("last_purchase_date")))
    return (last.withColumn("recency_days",
                            F.datediff(latest_date(last, "last_purchase_date"),
                                       F.col("last_purchase_date")).cast("long"))
            .orderBy("recency_days", customer))


def latest_row_per_customer(df: DataFrame, customer: str = "customer_name", by: str = "order_id",
                            row_order=("row_id",), rank_col: str = "rw_no") -> DataFrame:
    """One row per customer: the one with the highest ``by``, ties by ``row_order``.

    The reference takes the highest order id as text, not the newest date; ``by``
    chooses, and its type decides how it compares. Aggregates only, so a customer with
    many rows is folded on every executor before the shuffle.
    """
    picked = highest_per_group(df, [customer], by, list(row_order))
    return picked.withColumn(rank_col, F.lit(1).cast("long"))


def rfm_raw(df: DataFrame, customer: str = "customer_name", date_col: str = "order_date",
            order_key: str = "order_id", value: str = "sales") -> DataFrame:
    """Recency days, distinct orders, summed value per customer."""
    # per customer, stored once: the newest date overall is a scalar subquery over this
    # table, and the scores select their cuts from it; monetary stays an exact decimal
    # (segment totals sum it)
    raw = stored(df.groupBy(customer).agg(
        F.max(date_col).alias("_last"),
        F.countDistinct(order_key).alias("frequency"),
        F.round(F.sum(value), 2).alias("monetary")))
    return raw.select(
        customer,
        F.datediff(latest_date(raw, "_last"), F.col("_last")).cast("long").alias("recency"),
        "frequency",
        "monetary")


def rfm_scores(raw: DataFrame, customer: str = "customer_name", tiles: int = 4) -> DataFrame:
    """NTILE scores: recency newest-best, frequency and monetary highest-best.

    Ties are broken by the customer key so that scores repeat run to run. The cuts of all
    three are selected together by narrowing counts; no sort, no single-task window.
    """
    return ntile_by_cuts(raw, tiles, [customer], {"r_score": ("recency", False),
                                                  "f_score": ("frequency", True),
                                                  "m_score": ("monetary", True)})


def segment_label(r="r_score", f="f_score", m="m_score", other: str = OTHER_LABEL) -> Column:
    """The label of the first of ``SEGMENT_RULES`` that holds."""
    out = F.lit(other)
    for label, *ranges in reversed(SEGMENT_RULES):
        hit = F.lit(True)
        for name, (low, high) in zip((r, f, m), ranges):
            hit = hit & F.col(name).between(low, high)
        out = F.when(hit, F.lit(label)).otherwise(out)
    return out


def rfm_segments(df: DataFrame, customer: str = "customer_name", other: str = OTHER_LABEL,
                 **kw) -> DataFrame:
    """Raw RFM, scores and segment label per customer."""
    scored = rfm_scores(rfm_raw(df, customer, **kw), customer)
    return scored.withColumn("customer_segment", segment_label(other=other))


def segment_shares(segments: DataFrame) -> DataFrame:
    """Per segment: share of revenue and of customers, in percent.

    Aggregates to at most seven rows first; the window total runs over those.
    """
    per = segments.groupBy("customer_segment").agg(
        M.rows().alias("total_customers"),
        F.round(F.sum("monetary"), 2).alias("total_revenue"))
    everything = Window.partitionBy()
    return (per.select(
        "customer_segment",
        F.round(M.ratio(F.col("total_revenue"), F.sum("total_revenue").over(everything)) * 100, 2)
        .alias("per_contribute"),
        F.round(M.ratio(F.col("total_customers"), F.sum("total_customers").over(everything)) * 100, 2)
        .alias("per_engage"))
        .orderBy("customer_segment"))
