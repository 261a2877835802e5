"""RFM rules, shares and workbook reports on hand-written rows."""

import datetime as dt
from decimal import Decimal

from pyspark.sql import functions as F

from ledgerlens.operators import report as X
from ledgerlens.operators import rfm as R
from ledgerlens.operators.kpi import kpi_summary, order_value
from ledgerlens.operators.trend import period_growth, pooled_quarter_growth


def test_segment_rules_first_match_wins(spark):
    cases = [((4, 4, 4), "A_ Champion"), ((4, 3, 4), "B_ Loyal Customer"),
             ((3, 3, 3), "C_Potential Loyalist"), ((4, 4, 3), "C_Potential Loyalist"),
             ((4, 1, 1), "D_New Customer"), ((2, 3, 1), "E_At Risk Customer"),
             ((1, 1, 4), "F_Lost Customer"), ((1, 2, 2), "Regular Shopper"),
             ((3, 1, 1), "Regular Shopper")]
    df = spark.createDataFrame([c for c, _ in cases], "r_score long, f_score long, m_score long")
    got = [r[0] for r in df.select(R.segment_label()).collect()]
    assert got == [label for _, label in cases]


def _sales(spark):
    d = dt.date
    rows = [
        ("ann", 1, d(2020, 1, 1), Decimal("10.00"), Decimal("1.00"), Decimal("0")),
        ("ann", 2, d(2020, 3, 1), Decimal("30.00"), Decimal("-2.00"), Decimal("0.2")),
        ("bob", 3, d(2019, 1, 1), Decimal("5.00"), Decimal("0.50"), Decimal("0")),
        ("cyd", 4, d(2020, 2, 1), Decimal("100.00"), Decimal("20.00"), Decimal("0.2")),
        ("cyd", 4, d(2020, 2, 1), Decimal("1.00"), Decimal("0.10"), Decimal("0")),
    ]
    return spark.createDataFrame(rows, "customer_name string, order_id long, order_date date, "
                                       "sales decimal(18,2), profit decimal(18,2), "
                                       "discount decimal(4,2)")


def test_rfm_raw_and_fewer_customers_than_tiles(spark):
    raw = {r["customer_name"]: r for r in R.rfm_raw(_sales(spark)).collect()}
    assert raw["ann"]["recency"] == 0 and raw["ann"]["frequency"] == 2
    assert raw["bob"]["recency"] == (dt.date(2020, 3, 1) - dt.date(2019, 1, 1)).days
    assert raw["cyd"]["monetary"] == Decimal("101.00")
    seg = R.rfm_segments(_sales(spark)).collect()
    assert len(seg) == 3
    # three customers, four tiles: scores 1, 2, 3 in each ordering
    assert sorted(r["m_score"] for r in seg) == [1, 2, 3]


def test_segment_shares_sum_to_100(spark):
    shares = R.segment_shares(R.rfm_segments(_sales(spark))).collect()
    assert abs(sum(r["per_engage"] for r in shares) - 100) < 0.05
    assert abs(sum(r["per_contribute"] for r in shares) - 100) < 0.05


def test_pivot_body_equals_totals(spark):
    sales = _sales(spark)
    seg = R.rfm_segments(sales, other=R.OTHER_LABEL_EXPORT)
    cells = sales.join(seg.select("customer_name", "customer_segment"), "customer_name")
    pv = X.segment_discount_pivot(cells)
    rows = pv.collect()
    grand = [r for r in rows if r.row_total and r.col_total][0]
    assert grand.customer_segment == X.GRAND_TOTAL and grand.sales == 146.0
    for pick in (lambda r: not r.row_total and r.col_total, lambda r: r.row_total and not r.col_total,
                 lambda r: not r.row_total and not r.col_total):
        assert abs(sum(r.profit for r in rows if pick(r)) - grand.profit) < 1e-9
    table = X.wide(pv, [Decimal("0"), Decimal("0.2")]).collect()
    assert table[-1].customer_segment == X.GRAND_TOTAL
    assert abs(table[-1].profit_d000 + table[-1].profit_d020 - table[-1].total_profit) < 1e-9
    assert sum(r.total_sales for r in table[:-1]) == table[-1].total_sales == 146.0


def test_pivot_of_300_rates(spark):
    cells = spark.range(600).select(
        F.concat(F.lit("s"), F.col("id") % 2).alias("customer_segment"),
        (F.floor(F.col("id") / 2) / 1000).cast("decimal(5,3)").alias("discount"),
        F.lit(1).alias("profit"), F.lit(2).alias("sales"))
    rows = X.segment_discount_pivot(cells).collect()
    assert len(rows) == 600 + 300 + 2 + 1
    assert [r.sales for r in rows if r.row_total and r.col_total] == [1200.0]


def test_latest_row_ranks_text_ids(spark):
    df = spark.createDataFrame([("a", "CA-9", 1), ("a", "CA-10", 2), ("a", "CA-9", 0), ("b", "US-1", 5)],
                               "customer_name string, order_id string, row_id long")
    got = R.latest_row_per_customer(df).collect()
    assert sorted((r.customer_name, r.order_id, r.row_id) for r in got) == [("a", "CA-9", 0), ("b", "US-1", 5)]


def test_mean_with_grand_total_is_mean_of_rows(spark):
    out = X.mean_with_grand_total(_sales(spark), "discount", "profit", "avg").collect()
    total = [r for r in out if r["grand_total"] == 1][0]
    assert total["avg"] == round((1 - 2 + 0.5 + 20 + 0.1) / 5, 2)


def test_kpis_and_order_value(spark):
    df = _sales(spark).withColumn("customer_id", F.col("customer_name")).withColumn(
        "product_id", F.lit(1))
    k = kpi_summary(df).first()
    assert k["revenue"] == 146.0 and k["distinct_orders"] == 4
    assert order_value(df).first()[0] == round(146 / 4, 2)


def test_growth_first_period_null(spark):
    g = period_growth(_sales(spark), [F.year("order_date").alias("y")],
                      names=("cur", "prev", "g")).collect()
    assert g[0]["prev"] is None and g[0]["g"] is None
    assert g[1]["cur"] == 141.0 and g[1]["g"] == round((141 - 5) / 5 * 100, 2)
    q = pooled_quarter_growth(_sales(spark)).collect()
    assert [r["quarter"] for r in q] == ["Q1"]
