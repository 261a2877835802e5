"""RFM segmentation."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerlens.operators import rfm as R
from ledgerlens.plans.common import money_out, money_out_sql
from ledgerlens.plans.oracle import r, ratio, with_sales
from ledgerlens.plans.registry import register
from ledgerlens.operators.ranking import first_per_group
from ledgerlens.operators.skew import hot_key_rows, hot_keys, salted_join
from ledgerlens.session import stored
from ledgerlens.sources.star import (LINE_COLUMNS, LINEITEM_COLUMNS, ORDER_COLUMNS, ROW_ORDER,
                                     SALES_COLUMNS, order_dimension, sales_by_order, sales_lines,
                                     with_part_columns)

def rfm_input(spark, d):
    """Customer, date and sales of each order, lines folded per order first."""
    return sales_by_order(spark, d, ["customer_name", "order_date"], sums=["sales"])

# Orders first, then customers; the newest date stands on its own.
RAW_SQL = """per_order AS (
        SELECT order_id, customer_name, order_date, SUM(sales) AS amount
        FROM sales GROUP BY order_id, customer_name, order_date),
    newest AS (SELECT MAX(order_date) AS day FROM per_order),
    raw AS (
        SELECT customer_name, MIN(date_diff('day', order_date, day))::BIGINT AS recency,
               COUNT(*) AS frequency, ROUND(SUM(amount), 2) AS monetary
        FROM per_order CROSS JOIN newest GROUP BY customer_name)"""


def tile_sql(position: str, total: str = "total", tiles: int = 4) -> str:
    """The bucket of a position from 1: the larger buckets come first."""
    size, extra = f"({total} // {tiles})", f"({total} % {tiles})"
    larger = f"{extra} * ({size} + 1)"
    return (f"CASE WHEN {position} <= {larger} THEN ({position} - 1) // ({size} + 1) + 1 "
            f"ELSE {extra} + ({position} - {larger} - 1) // greatest({size}, 1) + 1 END")


SCORED_SQL = f"""placed AS (
        SELECT *, COUNT(*) OVER () AS total,
               row_number() OVER (ORDER BY -recency, customer_name) AS r_at,
               row_number() OVER (ORDER BY frequency, customer_name) AS f_at,
               row_number() OVER (ORDER BY monetary, customer_name) AS m_at
        FROM raw),
    scored AS (
        SELECT customer_name, recency, frequency, monetary, {tile_sql('r_at')} AS r_score,
               {tile_sql('f_at')} AS f_score, {tile_sql('m_at')} AS m_score FROM placed)"""


def segment_case_sql(other: str = R.OTHER_LABEL) -> str:
    """The fixed rules as SQL."""
    def holds(ranges) -> str:
        return " AND ".join(f"{name}_score BETWEEN {low} AND {high}"
                            for name, (low, high) in zip("rfm", ranges))

    cases = "\n".join(f"WHEN {holds(ranges)} THEN '{label}'" for label, *ranges in R.SEGMENT_RULES)
    return f"CASE {cases} ELSE '{other}' END"


def segmented_sql(other: str = R.OTHER_LABEL) -> str:
    """CTE list (without WITH) ending in ``seg``: one labelled row per customer."""
    return f"""{RAW_SQL},
    {SCORED_SQL},
    seg AS (SELECT *, {segment_case_sql(other)} AS customer_segment FROM scored)"""


@register("r01_recency", with_sales("""
    SELECT customer_name, MAX(order_date) AS last_purchase_date,
           CAST(date_diff('day', MAX(order_date), (SELECT MAX(order_date) FROM sales))
                AS BIGINT) AS recency_days
    FROM sales GROUP BY customer_name ORDER BY recency_days, customer_name"""), "R01")
def r01(spark, d):
    return R.recency(sales_by_order(spark, d, ["customer_name", "order_date"]))


@register("r02_distinct_customer_names", with_sales(
    "SELECT COUNT(DISTINCT customer_name) AS distinct_customers FROM sales"), "R02")
def r02(spark, d):
    return sales_by_order(spark, d, ["customer_name"]).agg(
        F.countDistinct("customer_name").alias("distinct_customers"))


@register("r03_latest_row_per_customer", with_sales(f"""
    SELECT {money_out_sql(SALES_COLUMNS)}, CAST(rw_no AS BIGINT) AS rw_no FROM (
        SELECT *, ROW_NUMBER() OVER (PARTITION BY customer_name
                                     ORDER BY CAST(order_id AS VARCHAR) DESC, {", ".join(ROW_ORDER)}) AS rw_no
        FROM sales) t
    WHERE rw_no = 1 ORDER BY order_id, line_number"""), "R03")
def r03(spark, d):
    # each customer's highest order id as text is found among the orders that have lines
    # (one scan of the order ids, one of the orders); the chosen orders, one per customer,
    # are stored, and only their lines are folded to the first one; parts join the picks
    line_only = [c for c in LINE_COLUMNS if c in LINEITEM_COLUMNS]
    per_order = stored(sales_lines(spark, d, ["order_id"]).groupBy("order_id").agg(
        F.count(F.lit(1)).alias("_lines")))
    orders = order_dimension(spark, d, {"orders", "customer", "nation", "region"}).select(
        "order_id", *ORDER_COLUMNS).join(per_order, "order_id")
    rest = [c for c in orders.columns if c != "customer_name"]
    best = F.max_by(F.struct(*rest), F.col("order_id").cast("string")).alias("_best")
    chosen = stored(orders.groupBy("customer_name").agg(best).select("customer_name", "_best.*"))
    hot = hot_keys(chosen, ["order_id"], "_lines", hot_key_rows(spark))
    lines = sales_lines(spark, d, [*line_only, "list_price"])
    mine = salted_join(lines, chosen.select("order_id"), ["order_id"], hot)
    picks = first_per_group(mine, ["order_id"], ROW_ORDER)
    full = with_part_columns(spark, d, picks).join(chosen.drop("_lines"), "order_id")
    return full.withColumn("rw_no", F.lit(1).cast("long")).select(
        *money_out(SALES_COLUMNS), "rw_no").orderBy("order_id", "line_number")


@register("r04_rfm_raw", with_sales(f"""
    WITH {RAW_SQL}
    SELECT customer_name, recency, frequency, CAST(monetary AS DOUBLE) AS monetary FROM raw"""), "R04")
def r04(spark, d):
    raw = R.rfm_raw(rfm_input(spark, d))
    return raw.withColumn("monetary", F.col("monetary").cast("double"))


@register("r05_rfm_scores", with_sales(f"""
    WITH {RAW_SQL}, {SCORED_SQL}
    SELECT customer_name, recency, frequency, CAST(monetary AS DOUBLE) AS monetary,
           r_score, f_score, m_score FROM scored"""), "R05")
def r05(spark, d):
    scored = R.rfm_scores(R.rfm_raw(rfm_input(spark, d)))
    return scored.withColumn("monetary", F.col("monetary").cast("double"))


@register("r06_rfm_segments", with_sales(f"""
    WITH {segmented_sql()}
    SELECT customer_name, recency, frequency, CAST(monetary AS DOUBLE) AS monetary,
           r_score, f_score, m_score, customer_segment FROM seg"""), "R06")
def r06(spark, d):
    seg = R.rfm_segments(rfm_input(spark, d))
    return seg.withColumn("monetary", F.col("monetary").cast("double"))


@register("r07_segment_shares", with_sales(f"""
    WITH {segmented_sql()},
    whole AS (SELECT SUM(monetary) AS revenue, COUNT(*) AS customers FROM seg)
    SELECT customer_segment,
           {r(ratio('SUM(monetary)', 'any_value(revenue)') + ' * 100')} AS per_contribute,
           {r(ratio('COUNT(*)', 'any_value(customers)') + ' * 100')} AS per_engage
    FROM seg CROSS JOIN whole GROUP BY customer_segment ORDER BY customer_segment"""), "R07")
def r07(spark, d):
    return R.segment_shares(R.rfm_segments(rfm_input(spark, d)))
