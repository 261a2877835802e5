"""Workbook reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerlens.functions import metrics as M
from ledgerlens.functions.money import parse_money
from ledgerlens.operators import report as X
from ledgerlens.operators import rfm as R
from ledgerlens.plans.oracle import mean, money_text, r, with_sales
from ledgerlens.plans.registry import register
from ledgerlens.plans.rfm import segmented_sql
from ledgerlens.session import stored
from ledgerlens.sources.star import sales_cells, sales_lines, with_order_columns

_PIVOT_SQL = with_sales(f"""
    WITH {segmented_sql(R.OTHER_LABEL_EXPORT)}
    SELECT CASE WHEN GROUPING(customer_segment) = 1 THEN '{X.GRAND_TOTAL}' ELSE customer_segment END
               AS customer_segment,
           CAST(sales.discount AS DOUBLE) AS discount,
           CAST(SUM(sales.profit) AS DOUBLE) AS profit, CAST(SUM(sales.sales) AS DOUBLE) AS sales,
           CAST(GROUPING(customer_segment) AS BIGINT) AS row_total,
           CAST(GROUPING(sales.discount) AS BIGINT) AS col_total
    FROM sales JOIN seg ON seg.customer_name = sales.customer_name
    GROUP BY CUBE (customer_segment, sales.discount)""")


@register("x01_segment_discount_pivot", _PIVOT_SQL, "X01")
def x01(spark, d):
    # one fold of the lines per (order, rate), before any order or customer join; the
    # segments and the cells both come from it
    lines = sales_lines(spark, d, ["order_id", "discount", "profit", "sales"])
    folded = lines.groupBy("order_id", "discount").agg(F.sum("profit").alias("profit"),
                                                       F.sum("sales").alias("sales"))
    per_rate = stored(with_order_columns(spark, d, folded, ["customer_name", "order_date"]))
    segments = R.rfm_segments(per_rate, other=R.OTHER_LABEL_EXPORT).select(
        "customer_name", "customer_segment")
    per_customer = per_rate.groupBy("customer_name", "discount").agg(
        F.sum("profit").alias("profit"), F.sum("sales").alias("sales"))
    return X.segment_discount_pivot(per_customer.join(segments, "customer_name")).orderBy(
        "row_total", "customer_segment", "col_total", "discount")


@register("x02_avg_profit_by_discount_with_total", with_sales(f"""
    SELECT CAST(discount AS DOUBLE) AS discount, {r(mean('profit'))} AS avg_profit,
           CAST(GROUPING(discount) AS BIGINT) AS grand_total
    FROM sales GROUP BY ROLLUP (discount)"""), "X02")
def x02(spark, d):
    out = X.mean_with_grand_total(sales_cells(spark, d, ["discount"], ["profit"]), "discount", "profit",
                                  "avg_profit", folded=True)
    return out.select(out["discount"].cast("double").alias("discount"), "avg_profit", "grand_total")


@register("x03_profit_by_region_subcat_with_total", with_sales("""
    SELECT region, sub_category AS sub_cat, CAST(SUM(profit) AS DOUBLE) AS profit,
           CAST(GROUPING(region, sub_category) AS BIGINT) AS grand_total
    FROM sales GROUP BY GROUPING SETS ((region, sub_category), ())"""), "X03")
def x03(spark, d):
    s = sales_cells(spark, d, ["region", "sub_category"], ["profit"]).withColumnRenamed(
        "sub_category", "sub_cat")
    return X.sum_by_two_with_grand_total(s, "region", "sub_cat", "profit", "profit")


@register("x04_money_text_roundtrip", with_sales(f"""
    SELECT region, sub_category AS sub_cat,
           CASE WHEN SUM(profit) < 0 THEN '-' ELSE '' END || {money_text('SUM(profit)')} AS profit_text,
           CAST(SUM(profit) AS DOUBLE) AS profit
    FROM sales GROUP BY 1, 2"""), "X04")
def x04(spark, d):
    """Profit per region and sub-category shown as money text, then read back.

    The text is the reports' display form (sign, currency mark, digit-group
    commas); ``parse_money`` must return the exact amount.
    """
    s = sales_lines(spark, d, ["region", "sub_category", "profit"])
    sums = s.groupBy("region", F.col("sub_category").alias("sub_cat")).agg(
        F.sum("profit").alias("_p"))
    text = F.concat(F.when(F.col("_p") < 0, F.lit("-")).otherwise(F.lit("")), M.money_text("_p"))
    shown = sums.select("region", "sub_cat", text.alias("profit_text"))
    return shown.select("region", "sub_cat", "profit_text",
                        parse_money("profit_text").cast("double").alias("profit"))
