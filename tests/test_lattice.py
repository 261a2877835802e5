"""Reports from the stored lattice equal those from the lines, and mergeable distinct counts."""

import os
import random
import shutil
import tempfile

import pytest
from pyspark.sql import functions as F

from conftest import SF_SMALL
from __spark_entry__ import oracle_sql, queries
from ledgerlens.functions.distinct import key_bitmaps, merged_count
from ledgerlens.plans.verify import compare, duck_connection
from ledgerlens.sources import lattice as X
from ledgerlens.sources.star import STAR_TABLES, sales_lines
from test_plans_streaming import plan_text

FROM_CELLS = [
    "e08_avg_shipping_days", "e10_top_category_by_revenue", "e11_top_category_by_profit",
    "e12_lowest_margin_category", "e13_top_region_by_revenue", "e14_region_margin_ratio",
    "e15_top_category_in_region", "e16_top_category_per_region", "e17_top_region_by_discount_sum",
    "e18_top_segment_by_revenue", "e19_segment_margin", "e20_segment_discount_and_line_value",
    "e21_ship_mode_usage", "e22_ship_days_by_mode", "e23_margin_by_ship_mode", "e24_margin_by_year",
    "e25_sales_profit_by_year", "e26_yoy_sales_growth", "e27_qoq_growth_pooled", "e27b_qoq_growth_series",
    "e29_by_discount_rate", "e30_margin_by_subcat", "e31_low_margin_region_category", "p02_discount_tiers",
    "p03_heavy_discount_by_subcat", "p04_heavy_discount_by_region", "p05_full_price_losses",
    "p10_loss_by_category", "p11_loss_by_subcat", "p12_worst_subcat_per_category", "p13_loss_by_region",
    "p14_worst_combo_per_region", "p15_loss_by_segment", "p16_discount_buckets", "p17_loss_top10",
    "p21_discount_tipping_point", "x02_avg_profit_by_discount_with_total",
    "x03_profit_by_region_subcat_with_total"]
FROM_KEYS = ["e03_distinct_customers", "e04_distinct_orders", "e05_distinct_products", "c16_distinct_order_count"]


@pytest.fixture(scope="module")
def lattice(spark):
    path = os.path.join(tempfile.mkdtemp(prefix="ll-lattice-"), "nodes")
    nodes = X.build_lattice(spark, SF_SMALL, path)
    spark.conf.set(X.LATTICE_CONF, path)
    yield nodes
    spark.conf.unset(X.LATTICE_CONF)


def test_coarser_nodes_are_smaller(lattice):
    assert lattice[0][0] == X.DIMENSIONS and len(lattice) > 5
    assert all(rows * 2 <= lattice[0][1] for _, rows in lattice[1:])


@pytest.mark.parametrize("name", FROM_CELLS + FROM_KEYS)
def test_reports_from_the_lattice(spark, lattice, name):
    df = queries()[name](spark, SF_SMALL)
    plan = plan_text(df)
    assert "lineitem" not in plan and "orders.parquet" not in plan
    assert compare(df, duck_connection(SF_SMALL), oracle_sql()[name]) == []


def test_keys_by_dimension_and_of_losing_lines(spark, lattice):
    lines = sales_lines(spark, SF_SMALL, ["region", "segment", "order_id", "customer_id", "profit"])
    got = X.distinct_keys(spark, SF_SMALL, ["order_id", "customer_id"], ["region"], losing=True)
    want = lines.where("profit < 0").groupBy("region").agg(F.countDistinct("order_id"), F.countDistinct("customer_id"))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_an_appended_file_makes_it_stale(spark):
    folder = tempfile.mkdtemp(prefix="ll star ")  # a path with a space
    for t in STAR_TABLES:
        os.makedirs(os.path.join(folder, f"{t}.parquet"))
        shutil.copy(f"{SF_SMALL}/{t}.parquet", os.path.join(folder, f"{t}.parquet", "a.parquet"))
    path = os.path.join(folder, "nodes")
    X.build_lattice(spark, folder, path)
    before = spark.conf.get(X.LATTICE_CONF, None)
    spark.conf.set(X.LATTICE_CONF, path)
    try:
        assert X.cells(spark, folder, ["region"], ["sales"]) is not None
        assert X.cells(spark, SF_SMALL, ["region"], ["sales"]) is None  # another source
        shutil.copy(f"{SF_SMALL}/lineitem.parquet", os.path.join(folder, "lineitem.parquet", "b.parquet"))
        assert X.cells(spark, folder, ["region"], ["sales"]) is None
        doubled = queries()["e29_by_discount_rate"](spark, folder)
        assert "lineitem" in plan_text(doubled)
    finally:
        spark.conf.unset(X.LATTICE_CONF)
        if before:
            spark.conf.set(X.LATTICE_CONF, before)


def test_what_the_lattice_does_not_hold(spark, lattice):
    assert X.cells(spark, SF_SMALL, ["customer_name"], ["sales"]) is None
    assert X.cells(spark, SF_SMALL, ["region"], ["list_price"]) is None
    assert X.distinct_keys(spark, SF_SMALL, ["supplier_id"]) is None


@pytest.mark.parametrize("kind", ["dense", "sparse", "negative", "mixed"])
def test_merged_counts_equal_count_distinct(spark, kind):
    rnd = random.Random(kind)
    draw = {"dense": lambda: rnd.randrange(70_000), "sparse": lambda: rnd.randrange(10 ** 17),
            "negative": lambda: -rnd.randrange(40_000),
            "mixed": lambda: rnd.choice([None, 0, rnd.randrange(-50, 50), rnd.randrange(10 ** 12), 1 << 62])}[kind]
    rows = [(rnd.choice(["a", "b", None]), i % 2, draw(), rnd.choice([None, 5])) for i in range(6000)]
    df = spark.createDataFrame(rows, "g string, h int, k long, m long")
    maps = key_bitmaps(df, ["k", "m"], ["g", "h"])
    for dims in ([], ["g"], ["h"], ["g", "h"]):
        got = merged_count(maps, ["k", "m"], dims)
        want = df.groupBy(*dims).agg(F.countDistinct("k"), F.countDistinct("m"))
        assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, map(tuple, want.collect())))
    assert merged_count(key_bitmaps(df.limit(0), ["k"]), ["k"]).collect() == [(0,)]
