"""KPIs, dimension breakdowns and trends.

Fixed values: the output column names are those of the reports that users of the reference
read today.
"""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import functions as F

from ledgerlens.functions import metrics as M
from ledgerlens.functions.distinct import key_bitmaps, merged_count
from ledgerlens.operators.breakdown import breakdown, top1
from ledgerlens.operators.kpi import kpi_summary, order_value
from ledgerlens.operators.ranking import top_per_group
from ledgerlens.operators.trend import period_growth, pooled_quarter_growth, quarter_label
from ledgerlens.plans.common import SCAN_SQL, SHIP_DAYS_SQL, scan
from ledgerlens.plans.oracle import margin_pct, mean, r, ratio, with_sales
from ledgerlens.plans.registry import register
from ledgerlens.session import stored
from ledgerlens.sources.lattice import distinct_keys
from ledgerlens.sources.star import (order_cells, part_categories, sales_by_order, sales_cells,
                                     sales_lines)

# Parameters adapted to the test tables: the region literal is
# lower case on purpose (the data says 'ASIA'), and the minimum discount of a
# "discount-only" customer is one step above zero.
REGION_LITERAL = "asia"
MIN_DISCOUNT_ONLY = Decimal("0.08")
LOW_MARGIN_PCT = 5
LOSS_PRODUCTS_LIMIT = 50

register("e01_scan_sales", SCAN_SQL, "E01")(scan)


@register("e02_revenue_profit_margin", with_sales(f"""
    SELECT CAST(SUM(sales) AS DOUBLE) AS revenue, CAST(SUM(profit) AS DOUBLE) AS net_profit,
           {margin_pct()} AS profit_margin FROM sales"""), "E02")
def e02(spark, d):
    return sales_lines(spark, d, ["sales", "profit"]).agg(
        M.total("sales").alias("revenue"), M.total("profit").alias("net_profit"),
        M.margin_pct().alias("profit_margin"))


@register("e03_distinct_customers", with_sales(
    "SELECT COUNT(DISTINCT customer_id) AS distinct_customers FROM sales"), "E03")
def e03(spark, d):
    kept = distinct_keys(spark, d, ["customer_id"])
    if kept is not None:
        return kept.withColumnRenamed("customer_id", "distinct_customers")
    return sales_by_order(spark, d, ["customer_id"]).agg(
        F.countDistinct("customer_id").alias("distinct_customers"))


@register("e04_distinct_orders", with_sales(
    "SELECT COUNT(DISTINCT order_id) AS distinct_orders FROM sales"), "E04")
def e04(spark, d):
    kept = distinct_keys(spark, d, ["order_id"])
    if kept is not None:
        return kept.withColumnRenamed("order_id", "distinct_orders")
    return sales_lines(spark, d, ["order_id"]).agg(
        F.countDistinct("order_id").alias("distinct_orders"))


@register("e05_distinct_products", with_sales(
    "SELECT COUNT(DISTINCT product_id) AS distinct_products FROM sales"), "E05")
def e05(spark, d):
    kept = distinct_keys(spark, d, ["product_id"])
    if kept is not None:
        return kept.withColumnRenamed("product_id", "distinct_products")
    return sales_lines(spark, d, ["product_id"]).agg(
        F.countDistinct("product_id").alias("distinct_products"))


@register("e05b_distinct_keys_by_segment", with_sales("""
    SELECT segment, COUNT(DISTINCT customer_id) AS distinct_customers, COUNT(DISTINCT order_id) AS distinct_orders,
           COUNT(DISTINCT product_id) AS distinct_products
    FROM sales GROUP BY ROLLUP (segment)"""), ("E03", "E04", "E05"))
def e05b(spark, d):
    """The three counts per segment and over all, from one pass over the lines: bitmaps by
    segment are stored and united for the total."""
    keys = ["customer_id", "order_id", "product_id"]
    maps = stored(key_bitmaps(sales_lines(spark, d, ["segment", *keys]), keys, ["segment"]))
    per = merged_count(maps, keys, ["segment"])
    every = merged_count(maps, keys).withColumn("segment", F.lit(None).cast("string"))
    named = [F.col(k).alias(f"distinct_{k[:-3]}s") for k in keys]
    return per.unionByName(every).select("segment", *named)


@register("e06_avg_order_value", with_sales(f"""
    SELECT {r(mean('t'))} AS avg_order_value
    FROM (SELECT order_id, SUM(sales) AS t FROM sales GROUP BY order_id) o"""), "E06")
def e06(spark, d):
    return order_value(sales_by_order(spark, d, [], sums=["sales"]))


@register("e07_avg_order_value_by_segment", with_sales(f"""
    SELECT segment, {r(mean('t'))} AS avg_by_segment
    FROM (SELECT segment, order_id, SUM(sales) AS t FROM sales GROUP BY 1, 2) o
    GROUP BY segment ORDER BY segment"""), "E07")
def e07(spark, d):
    return order_value(sales_by_order(spark, d, ["segment"], sums=["sales"]), ["segment"],
                       name="avg_by_segment").orderBy("segment")


@register("e08_avg_shipping_days", with_sales(f"""
    SELECT {r(mean(SHIP_DAYS_SQL))} AS avg_shipping_days FROM sales"""),
    "E08")
def e08(spark, d):
    return order_cells(spark, d, ["order_date"], day_sums=["ship_date"]).agg(
        M.rounded(M.folded_mean_ship_days()).alias("avg_shipping_days"))


@register("e09_distinct_categories", with_sales(
    "SELECT DISTINCT category FROM sales ORDER BY category"), "E09")
def e09(spark, d):
    # products sold are distinct first, so the part join sees products, not lines
    sold = sales_lines(spark, d, ["product_id"]).distinct()
    return sold.join(part_categories(spark, d), "product_id").select("category").distinct().orderBy(
        "category")


def _top1_sql(dim: str, expr: str, name: str, desc: bool = True, where: str = "") -> str:
    direction = "DESC NULLS LAST" if desc else "ASC NULLS FIRST"
    w = f"WHERE {where}" if where else ""
    return with_sales(f"""
    SELECT {dim}, {expr} AS {name} FROM sales {w}
    GROUP BY {dim} ORDER BY {name} {direction}, {dim} LIMIT 1""")


@register("e10_top_category_by_revenue",
          _top1_sql("category", "CAST(SUM(sales) AS DOUBLE)", "highest_revenue"), "E10")
def e10(spark, d):
    return top1(sales_cells(spark, d, ["category"], ["sales"]), "category", M.total("sales"),
                "highest_revenue")


@register("e11_top_category_by_profit",
          _top1_sql("category", "CAST(SUM(profit) AS DOUBLE)", "highest_profit"), "E11")
def e11(spark, d):
    return top1(sales_cells(spark, d, ["category"], ["profit"]), "category", M.total("profit"),
                "highest_profit")


@register("e12_lowest_margin_category",
          _top1_sql("category", margin_pct(), "worst_perf_despite_high_sale", desc=False), "E12")
def e12(spark, d):
    return top1(sales_cells(spark, d, ["category"], ["sales", "profit"]), "category",
                M.margin_pct(), "worst_perf_despite_high_sale", descending=False)


@register("e13_top_region_by_revenue",
          _top1_sql("region", "CAST(SUM(sales) AS DOUBLE)", "highest_region_revenue"), "E13")
def e13(spark, d):
    return top1(order_cells(spark, d, ["region"], sums=["sales"]), "region", M.total("sales"),
                "highest_region_revenue")


@register("e14_region_margin_ratio", with_sales(f"""
    SELECT region, {r(ratio('SUM(profit)', 'SUM(sales)'))} AS highest_profit_margin_region
    FROM sales GROUP BY region ORDER BY 2 DESC NULLS LAST, region"""), "E14")
def e14(spark, d):
    return breakdown(order_cells(spark, d, ["region"], sums=["sales", "profit"]), ["region"],
                     [M.margin_ratio().alias("highest_profit_margin_region")],
                     order=[F.col("highest_profit_margin_region").desc_nulls_last(), "region"])


@register("e15_top_category_in_region", _top1_sql(
    "category", "CAST(SUM(sales) AS DOUBLE)", "highest_revenue",
    where=f"lower(region) = lower('{REGION_LITERAL}')"), "E15")
def e15(spark, d):
    s = sales_cells(spark, d, ["region", "category"], ["sales"])
    # the reference's text compare ignores case
    return top1(s, "category", M.total("sales"), "highest_revenue",
                where=F.lower(F.col("region")) == F.lower(F.lit(REGION_LITERAL)))


@register("e16_top_category_per_region", with_sales("""
    SELECT region, category, CAST(rev AS DOUBLE) AS highest_revenue FROM (
        SELECT region, category, SUM(sales) AS rev,
               ROW_NUMBER() OVER (PARTITION BY region ORDER BY SUM(sales) DESC, category) AS rn
        FROM sales GROUP BY 1, 2) t
    WHERE rn = 1 ORDER BY region DESC"""), "E16")
def e16(spark, d):
    agg = sales_cells(spark, d, ["region", "category"], ["sales"]).groupBy("region", "category").agg(
        F.sum("sales").alias("_rev"))
    best = top_per_group(agg, ["region"], [F.col("_rev").desc(), "category"])
    return best.select("region", "category", M.as_money("_rev").alias("highest_revenue")).orderBy(
        F.col("region").desc())


@register("e17_top_region_by_discount_sum",
          _top1_sql("region", "CAST(SUM(discount) AS DOUBLE)", "highest_discount"), "E17")
def e17(spark, d):
    return top1(order_cells(spark, d, ["region"], sums=["discount"]), "region",
                M.total("discount"),
                "highest_discount")


@register("e18_top_segment_by_revenue",
          _top1_sql("segment", "CAST(SUM(sales) AS DOUBLE)", "high_expense"), "E18")
def e18(spark, d):
    return top1(order_cells(spark, d, ["segment"], sums=["sales"]), "segment", M.total("sales"),
                "high_expense")


@register("e19_segment_margin", with_sales(f"""
    SELECT segment, CAST(SUM(sales) AS DOUBLE) AS total_sales, CAST(SUM(profit) AS DOUBLE) AS total_profit,
           {margin_pct()} AS profit_margin_percent
    FROM sales GROUP BY segment ORDER BY profit_margin_percent DESC NULLS LAST, segment"""), "E19")
def e19(spark, d):
    # sorted on the number, not on formatted text
    return breakdown(order_cells(spark, d, ["segment"], sums=["sales", "profit"]), ["segment"],
                     [M.total("sales").alias("total_sales"), M.total("profit").alias("total_profit"),
                      M.margin_pct().alias("profit_margin_percent")],
                     order=[F.col("profit_margin_percent").desc_nulls_last(), "segment"])


@register("e20_segment_discount_and_line_value", with_sales(f"""
    SELECT segment, {r(mean('discount') + ' * 100')} AS avg_discount_percent,
           {r(mean('sales'))} AS avg_line_value
    FROM sales GROUP BY segment ORDER BY avg_discount_percent, segment"""), "E20")
def e20(spark, d):
    return breakdown(order_cells(spark, d, ["segment"], sums=["discount", "sales"]), ["segment"],
                     [M.folded_mean_pct("discount").alias("avg_discount_percent"),
                      M.rounded(M.folded_mean("sales")).alias("avg_line_value")],
                     order=["avg_discount_percent", "segment"])


@register("e21_ship_mode_usage", with_sales("""
    SELECT ship_mode, COUNT(*) AS counting FROM sales GROUP BY 1 ORDER BY counting DESC, ship_mode"""),
    "E21")
def e21(spark, d):
    return breakdown(order_cells(spark, d, ["ship_mode"]), ["ship_mode"],
                     [M.folded_rows().alias("counting")],
                     order=[F.col("counting").desc(), "ship_mode"])


@register("e22_ship_days_by_mode", with_sales(f"""
    SELECT ship_mode, {mean(SHIP_DAYS_SQL)} AS avg_time
    FROM sales GROUP BY ship_mode"""), "E22")
def e22(spark, d):
    s = order_cells(spark, d, ["ship_mode", "order_date"], day_sums=["ship_date"])
    return breakdown(s, ["ship_mode"], [M.folded_mean_ship_days().alias("avg_time")])


@register("e23_margin_by_ship_mode", with_sales(f"""
    SELECT ship_mode, {margin_pct()} AS profit_margin FROM sales GROUP BY 1
    ORDER BY profit_margin DESC NULLS LAST, ship_mode"""), "E23")
def e23(spark, d):
    return breakdown(order_cells(spark, d, ["ship_mode"], sums=["sales", "profit"]), ["ship_mode"],
                     [M.margin_pct().alias("profit_margin")],
                     order=[F.col("profit_margin").desc_nulls_last(), "ship_mode"])


@register("e24_margin_by_year", with_sales(f"""
    SELECT CAST(year(order_date) AS BIGINT) AS years, {margin_pct()} AS profit_margin_per_year
    FROM sales GROUP BY 1 ORDER BY profit_margin_per_year DESC NULLS LAST, years"""), "E24")
def e24(spark, d):
    # numeric sort (the reference sorted formatted text)
    return breakdown(order_cells(spark, d, ["order_date"], sums=["sales", "profit"]),
                     [F.year("order_date").cast("long").alias("years")],
                     [M.margin_pct().alias("profit_margin_per_year")],
                     order=[F.col("profit_margin_per_year").desc_nulls_last(), "years"])


@register("e25_sales_profit_by_year", with_sales("""
    SELECT CAST(year(order_date) AS BIGINT) AS years, CAST(SUM(sales) AS DOUBLE) AS total_sales,
           CAST(SUM(profit) AS DOUBLE) AS total_profit
    FROM sales GROUP BY 1 ORDER BY years"""), "E25")
def e25(spark, d):
    return breakdown(order_cells(spark, d, ["order_date"], sums=["sales", "profit"]),
                     [F.year("order_date").cast("long").alias("years")],
                     [M.total("sales").alias("total_sales"), M.total("profit").alias("total_profit")],
                     order=["years"])


@register("e26_yoy_sales_growth", with_sales(f"""
    WITH a AS (SELECT CAST(year(order_date) AS BIGINT) AS sales_year, ROUND(SUM(sales), 2) AS cur
               FROM sales GROUP BY 1),
    l AS (SELECT sales_year, cur, LAG(cur, 1) OVER (ORDER BY sales_year) AS prev FROM a)
    SELECT sales_year, CAST(cur AS DOUBLE) AS current_year_sales, CAST(prev AS DOUBLE) AS previous_year_sales,
           {r(ratio('cur - prev', 'prev') + ' * 100')} AS yoy_sales_growth_percent
    FROM l ORDER BY sales_year"""), "E26")
def e26(spark, d):
    return period_growth(order_cells(spark, d, ["order_date"], sums=["sales"]),
                         [F.year("order_date").cast("long").alias("sales_year")],
                         names=("current_year_sales", "previous_year_sales",
                                "yoy_sales_growth_percent"))


@register("e27_qoq_growth_pooled", with_sales(f"""
    WITH m AS (SELECT month(order_date) AS mo, ROUND(SUM(sales), 2) AS t FROM sales GROUP BY 1),
    q AS (SELECT 'Q' || CAST(CAST(ceil(mo / 3.0) AS INTEGER) AS VARCHAR) AS quarter, SUM(t) AS qt
          FROM m GROUP BY 1),
    l AS (SELECT quarter, qt, LAG(qt, 1) OVER (ORDER BY quarter) AS prev FROM q)
    SELECT quarter, CAST(qt AS DOUBLE) AS current_quarter_sales, CAST(prev AS DOUBLE) AS prv_quarter_sale,
           {r(ratio('qt - prev', 'prev') + ' * 100')} AS qoq_growth_percent
    FROM l ORDER BY quarter"""), "E27")
def e27(spark, d):
    return pooled_quarter_growth(order_cells(spark, d, ["order_date"], sums=["sales"]))


@register("e27b_qoq_growth_series", with_sales(f"""
    WITH a AS (SELECT CAST(year(order_date) AS BIGINT) AS sales_year,
                      'Q' || CAST(quarter(order_date) AS VARCHAR) AS quarter,
                      ROUND(SUM(sales), 2) AS cur FROM sales GROUP BY 1, 2),
    l AS (SELECT *, LAG(cur, 1) OVER (ORDER BY sales_year, quarter) AS prev FROM a)
    SELECT sales_year, quarter, CAST(cur AS DOUBLE) AS current_quarter_sales,
           CAST(prev AS DOUBLE) AS prv_quarter_sale,
           {r(ratio('cur - prev', 'prev') + ' * 100')} AS qoq_growth_percent
    FROM l ORDER BY sales_year, quarter"""), "E27")
def e27b(spark, d):
    return period_growth(order_cells(spark, d, ["order_date"], sums=["sales"]),
                         [F.year("order_date").cast("long").alias("sales_year"),
                          quarter_label(F.month("order_date")).alias("quarter")],
                         names=("current_quarter_sales", "prv_quarter_sale", "qoq_growth_percent"))


@register("e28_loss_making_products", with_sales(f"""
    SELECT product_id, product_name, CAST(SUM(sales) AS DOUBLE) AS prd_sale, {margin_pct()} AS prd_margin
    FROM sales GROUP BY product_id, product_name HAVING SUM(profit) < 0
    ORDER BY prd_margin ASC NULLS FIRST, product_id LIMIT {LOSS_PRODUCTS_LIMIT}"""), "E28")
def e28(spark, d):
    s = sales_lines(spark, d, ["product_id", "product_name", "sales", "profit"], salt_parts=True)
    return breakdown(s, ["product_id", "product_name"],
                     [M.total("sales").alias("prd_sale"), M.margin_pct().alias("prd_margin"),
                      F.sum("profit").alias("_net")],
                     having=F.col("_net") < 0,
                     order=[F.col("prd_margin").asc_nulls_first(), "product_id"],
                     limit=LOSS_PRODUCTS_LIMIT).drop("_net")


@register("e29_by_discount_rate", with_sales(f"""
    SELECT CAST(discount AS DOUBLE) AS discount, CAST(SUM(sales) AS DOUBLE) AS total_sales,
           CAST(SUM(profit) AS DOUBLE) AS total_profit, {margin_pct()} AS group_profit_margin
    FROM sales GROUP BY sales.discount ORDER BY 1"""), "E29")
def e29(spark, d):
    return breakdown(sales_cells(spark, d, ["discount"], ["sales", "profit"]), ["discount"],
                     [M.total("sales").alias("total_sales"), M.total("profit").alias("total_profit"),
                      M.margin_pct().alias("group_profit_margin")],
                     order=["discount"]).withColumn("discount", F.col("discount").cast("double"))


@register("e30_margin_by_subcat", with_sales(f"""
    SELECT sub_category, {margin_pct()} AS sub_category_profit_margin FROM sales GROUP BY 1
    ORDER BY 2 ASC NULLS FIRST, 1"""), "E30")
def e30(spark, d):
    return breakdown(sales_cells(spark, d, ["sub_category"], ["sales", "profit"]), ["sub_category"],
                     [M.margin_pct().alias("sub_category_profit_margin")],
                     order=[F.col("sub_category_profit_margin").asc_nulls_first(), "sub_category"])


@register("e31_low_margin_region_category", with_sales(f"""
    SELECT region, category, {margin_pct()} AS profit_margin FROM sales GROUP BY 1, 2
    HAVING {margin_pct()} < {LOW_MARGIN_PCT} ORDER BY region, category"""), "E31")
def e31(spark, d):
    # HAVING tests the rounded value, as the reference does
    return breakdown(sales_cells(spark, d, ["region", "category"], ["sales", "profit"]),
                     ["region", "category"], [M.margin_pct().alias("profit_margin")],
                     having=F.col("profit_margin") < LOW_MARGIN_PCT, order=["region", "category"])


def discount_only_customers(spark, d, names=("total_orders_placed", "avg_discount_received",
                                               "lowest_discount_they_ever_accepted"),
                            min_discount=MIN_DISCOUNT_ONLY):
    """Customers whose lowest discount ever is at least ``min_discount``.

    Counts lines (the reference's COUNT(order id)); folded per order first.
    """
    n, avg_name, low_name = names
    s = sales_by_order(spark, d, ["customer_name"], sums=["discount"], mins=["discount"])
    return breakdown(s, ["customer_name"],
                     [M.folded_rows().alias(n), M.folded_mean_pct("discount").alias(avg_name),
                      F.min("discount_min").alias("_low")],
                     having=F.col("_low") >= F.lit(min_discount),
                     order=[F.col(n).desc(), "customer_name"]).select(
        "customer_name", n, avg_name, F.col("_low").cast("double").alias(low_name))


def discount_only_sql(names=("total_orders_placed", "avg_discount_received",
                             "lowest_discount_they_ever_accepted")):
    n, avg_name, low_name = names
    return with_sales(f"""
    SELECT customer_name, COUNT(order_id) AS {n}, {r(mean('discount') + ' * 100')} AS {avg_name},
           CAST(MIN(discount) AS DOUBLE) AS {low_name}
    FROM sales GROUP BY customer_name HAVING MIN(discount) >= {MIN_DISCOUNT_ONLY}
    ORDER BY {n} DESC, customer_name""")


@register("e32_discount_only_customers", discount_only_sql(), "E32")
def e32(spark, d):
    return discount_only_customers(spark, d)
