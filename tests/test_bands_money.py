"""Band edges, labels and money-text parsing."""

import os
from decimal import Decimal

from pyspark.sql import functions as F

from ledgerlens.functions.bands import (DISCOUNT_BUCKET_LABELS, DISCOUNT_TIER_LABELS, SHIPPING_LABELS, bucket_level, discount_bucket, discount_tier,
                                        shipping_experience)
from ledgerlens.functions.money import parse_money
from ledgerlens.sources.workbook import read_money_table

EDGES = ["0", "0.1", "0.2", "0.3", "0.32", "0.4", "0.41", "0.8", None, "-0.1"]


def _discounts(spark):
    rows = [(Decimal(x) if x is not None else None,) for x in EDGES]
    return spark.createDataFrame(rows, "discount decimal(4,2)")


def test_discount_tier_edges(spark):
    got = [r[0] for r in _discounts(spark).select(discount_tier()).collect()]
    assert [DISCOUNT_TIER_LABELS.index(x) for x in got] == [0, 1, 1, 2, 2, 2, 3, 3, 3, 1]


def test_discount_bucket_edges_and_levels(spark):
    df = _discounts(spark).select(discount_bucket().alias("b"))
    got = [r[0] for r in df.collect()]
    assert [DISCOUNT_BUCKET_LABELS.index(x) for x in got] == [0, 1, 2, 3, 4, 4, 5, 5, 5, 5]
    levels = [r[0] for r in df.select(bucket_level("b")).collect()]
    assert levels == ["Low", "Low", "Medium", "Medium", "High", "High", "High", "High", "High",
                      "High"]


def test_shipping_bands(spark):
    df = spark.createDataFrame([(5.0,), (4.99,), (3.0,), (2.9,), (None,)], "a double")
    got = [r[0] for r in df.select(shipping_experience("a")).collect()]
    assert [SHIPPING_LABELS.index(x) for x in got] == [0, 1, 1, 2, 2]


def test_band_counts_sum_to_rows(spark):
    df = spark.range(0, 81).select((F.col("id") / 100).cast("decimal(4,2)").alias("discount"))
    total = df.groupBy(discount_bucket().alias("b")).count().agg(F.sum("count")).first()[0]
    assert total == 81


def test_parse_money(spark):
    df = spark.createDataFrame([("? 1,07,194.61",), ("-? 468.25",), ("",), (None,), ("? 4.11",),
                                ("$21,909.40",), ("n/a",), ("(468.25)",), ("$ (1,000.00)",)], "t string")
    got = [r[0] for r in df.select(parse_money("t")).collect()]
    assert got == [Decimal("107194.61"), Decimal("-468.25"), None, None, Decimal("4.11"),
                   Decimal("21909.40"), None, Decimal("-468.25"), Decimal("-1000.00")]


def test_read_money_table(spark, tmpdir_path):
    p = os.path.join(tmpdir_path, "block.csv")
    with open(p, "w", encoding="utf-8") as f:
        f.write("Customer Type,profit,sales\n")
        f.write('A_ Champion,"? 32,959.38","? 1,07,194.61"\n')
        f.write('B_ Loyal Customer,-? 468.25,\n')
    df = read_money_table(spark, p, ["segment", "profit", "sales"], ["profit", "sales"])
    rows = {r["segment"]: (r["profit"], r["sales"]) for r in df.collect()}
    assert rows["A_ Champion"] == (Decimal("32959.38"), Decimal("107194.61"))
    assert rows["B_ Loyal Customer"] == (Decimal("-468.25"), None)


def test_write_report_csv_round_trip(spark, tmpdir_path):
    from ledgerlens.sources.workbook import write_report_csv
    df = spark.createDataFrame([("A_ Champion", 1.5), ("Grand Total", 1.5)], "seg string, v double")
    p = os.path.join(tmpdir_path, "report")
    write_report_csv(df, p)
    back = spark.read.option("header", True).schema("seg string, v double").csv(p)
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, df.collect()))
