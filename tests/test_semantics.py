"""Semantics the reports must keep on hand-written rows."""

from decimal import Decimal

from pyspark.sql import functions as F

from ledgerlens.functions import metrics as M
from ledgerlens.operators.breakdown import breakdown, top1
from ledgerlens.operators.customers import repeat_buyers, shipping_vs_repeat
from ledgerlens.operators.discount import margin_damage
from ledgerlens.operators.leakage import loss_impact, loss_top

D = Decimal
SCHEMA = ("region string, category string, sub_category string, customer_id string, "
          "order_id long, discount decimal(4,2), sales decimal(18,2), profit decimal(18,2)")


def frame(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


def test_margin_is_ratio_of_sums_and_null_on_zero_sales(spark):
    df = frame(spark, [
        ("West", "A", "s1", "c1", 1, D("0"), D("100.00"), D("50.00")),
        ("West", "A", "s1", "c1", 2, D("0"), D("900.00"), D("-40.00")),
        ("West", "Z", "s2", "c2", 3, D("0"), D("0.00"), D("-5.00")),
    ])
    got = {r["category"]: r["m"] for r in
           df.groupBy("category").agg(M.margin_pct().alias("m")).collect()}
    assert got["A"] == 1.0        # (50 - 40) / 1000, not the mean of 50% and -4.4%
    assert got["Z"] is None       # zero sales: NULL, not an error under ANSI mode


def test_case_insensitive_region_filter(spark):
    df = frame(spark, [("West", "A", "s", "c", 1, D("0"), D("5.00"), D("1.00")),
                       ("west", "B", "s", "c", 2, D("0"), D("7.00"), D("1.00")),
                       ("East", "C", "s", "c", 3, D("0"), D("99.00"), D("1.00"))])
    out = top1(df, "category", M.total("sales"), "rev",
               where=F.lower(F.col("region")) == F.lower(F.lit("WEST"))).collect()
    assert [(r["category"], r["rev"]) for r in out] == [("B", 7.0)]


def test_having_tests_the_rounded_value(spark):
    # mean discount 0.304 rounds to 0.30 and must fail "> 0.3"; 0.306 -> 0.31 passes
    rows = [("R", "A", "low", "c", i, D(x), D("1.00"), D("0.00"))
            for i, x in enumerate(["0.30", "0.30", "0.31", "0.30", "0.31"])]
    rows += [("R", "A", "high", "c", 10 + i, D(x), D("1.00"), D("0.00"))
             for i, x in enumerate(["0.31", "0.31", "0.30", "0.31", "0.30"])]
    # low: mean 0.304; high: mean 0.306
    df = frame(spark, rows)
    out = breakdown(df, ["sub_category"], [M.rounded(M.mean("discount")).alias("avg_d")],
                    having=F.col("avg_d") > 0.3).collect()
    assert [r["sub_category"] for r in out] == ["high"]


def test_loss_top_keeps_six_buckets_under_three_labels(spark):
    # 0.35 and 0.45 are different buckets with the same printed level (High)
    df = frame(spark, [("R", "A", "s", "c", 1, D("0.35"), D("1.00"), D("-10.00")),
                       ("R", "A", "s", "c", 2, D("0.45"), D("1.00"), D("-20.00")),
                       ("R", "A", "s", "c", 3, D("0.00"), D("1.00"), D("5.00"))])
    out = loss_top(df, n=10).collect()
    assert [(r["rank"], r["disc_bucket"], r["total_loss"]) for r in out] == [
        (1, "High", "-$20.00"), (2, "High", "-$10.00")]


def test_loss_impact_counts_customers_with_losses(spark):
    df = frame(spark, [("R", "A", "s", "c1", 1, D("0"), D("100.00"), D("-10.00")),
                       ("R", "A", "s", "c2", 2, D("0"), D("300.00"), D("20.00")),
                       ("R", "A", "s", "c1", 3, D("0"), D("100.00"), D("-30.00"))])
    r = loss_impact(df).first()
    assert r["total_profit_loss"] == "-$40.00"
    assert r["percent_of_total_revenue_lost"] == 8.0     # 40 / 500 of all revenue
    assert r["customers_affected"] == 1


def test_margin_damage_subtracts_rounded_margins(spark):
    df = frame(spark, [("R", "A", "s", "c", 1, D("0"), D("3.00"), D("1.00")),
                       ("R", "A", "s", "c", 2, D("0.2"), D("3.00"), D("-1.00"))])
    r = margin_damage(df).first()
    assert (r["full_price_margin_pct"], r["discounted_margin_pct"]) == (33.33, -33.33)
    assert r["margin_drop_pct"] == 66.66


def test_repeat_buyers_and_shipping_bands_edges(spark):
    import datetime as dt
    rows = [("c1", 1, dt.date(2020, 1, 1), dt.date(2020, 1, 6)),   # 5 days -> delayed
            ("c2", 2, dt.date(2020, 1, 1), dt.date(2020, 1, 4)),   # 3 days -> average
            ("c2", 3, dt.date(2020, 1, 1), dt.date(2020, 1, 4)),
            ("c3", 4, dt.date(2020, 1, 1), None)]                  # NULL mean -> fast
    df = spark.createDataFrame(rows, "customer_id string, order_id long, order_date date, "
                                     "ship_date date")
    r = repeat_buyers(df, "customer_id").first()
    assert (r["ordered_only_once"], r["ordered_more_than_once"]) == (2, 1)
    bands = {r["shipping_experience"]: (r["avg_lifetime_orders"], r["total_customers_in_group"])
             for r in shipping_vs_repeat(df).collect()}
    assert bands == {"Delayed Shipping (5+ Days)": (1.0, 1),
                     "Average Shipping (3-5 Days)": (2.0, 1),
                     "Fast Shipping (Under 3 Days)": (1.0, 1)}
