"""Reports on a materialized flat table equal the star-join results."""

import os
import tempfile

import pytest

from __spark_entry__ import oracle_sql, queries
from ledgerlens.plans.verify import compare, duck_connection
from ledgerlens.sources.star import SALES_TABLE_CONF, materialize_sales, sales_lines

from conftest import SF_ORACLE, SF_SMALL

SAMPLE = ["c08_missing_value_audit", "c13_rows_of_repeated_orders", "c14_extra_lines_per_order",
          "c21_dedupe_lines", "e02_revenue_profit_margin", "e06_avg_order_value",
          "e08_avg_shipping_days", "e13_top_region_by_revenue", "e20_segment_discount_and_line_value",
          "e26_yoy_sales_growth", "e32_discount_only_customers", "i03_one_time_vs_repeat",
          "i08_star_products", "i11_product_popularity", "i20_shipping_delay_vs_repeat",
          "i21_favourite_ship_mode_per_segment", "p04_heavy_discount_by_region",
          "p07_worst_discounted_line_per_order", "p17_loss_top10", "p18_loss_impact",
          "p20_drop_region_subcat_recovery", "r03_latest_row_per_customer", "r06_rfm_segments",
          "x01_segment_discount_pivot", "x03_profit_by_region_subcat_with_total"]


@pytest.fixture(scope="module")
def flat(spark):
    path = os.path.join(tempfile.mkdtemp(prefix="ll-flat-"), "sales")
    materialize_sales(spark, SF_SMALL, path)
    spark.conf.set(SALES_TABLE_CONF, path)
    yield path
    spark.conf.unset(SALES_TABLE_CONF)


@pytest.fixture(scope="module")
def con():
    return duck_connection(SF_SMALL)


def test_flat_table_is_used_only_for_its_source(spark, flat):
    plan = sales_lines(spark, SF_SMALL, ["order_id", "region"])._jdf.queryExecution().toString()
    assert "orders.parquet" not in plan and "sales" in plan
    other = sales_lines(spark, SF_ORACLE, ["order_id", "region"])._jdf.queryExecution().toString()
    assert "orders.parquet" in other


@pytest.mark.parametrize("name", SAMPLE)
def test_query_on_flat_table_matches_sql(spark, flat, con, name):
    df = queries()[name](spark, SF_SMALL)
    assert compare(df, con, oracle_sql()[name]) == []


def test_appended_lines_are_read_and_make_the_flat_table_stale(spark):
    """A table that grows between two calls is read in full, with and without a flat copy."""
    from ledgerlens.sources.star import STAR_TABLES
    src = tempfile.mkdtemp(prefix="ll-grow-")
    for t in STAR_TABLES:
        spark.read.parquet(f"{SF_SMALL}/{t}.parquet").coalesce(1).write.parquet(f"{src}/{t}.parquet")
    count = lambda: queries()["c15_row_count"](spark, src).first()[0]
    before = count()
    path = os.path.join(tempfile.mkdtemp(prefix="ll-flat-"), "sales")
    old = spark.conf.get(SALES_TABLE_CONF, None)
    materialize_sales(spark, src, path)
    spark.conf.set(SALES_TABLE_CONF, path)
    try:
        assert "orders.parquet" not in sales_lines(spark, src, ["order_date"])._jdf.queryExecution().toString()
        spark.read.parquet(f"{SF_SMALL}/lineitem.parquet").limit(1000).write.mode("append").parquet(
            f"{src}/lineitem.parquet")
        assert "orders.parquet" in sales_lines(spark, src, ["order_date"])._jdf.queryExecution().toString()
        assert count() == before + 1000
        # a dimension that grows is read again too
        spark.read.parquet(f"{SF_SMALL}/part.parquet").selectExpr(
            "p_partkey + 1000000 as p_partkey", "* except (p_partkey)").write.mode("append").parquet(
            f"{src}/part.parquet")
        assert queries()["e05_distinct_products"](spark, src).count() == 1
    finally:
        spark.conf.unset(SALES_TABLE_CONF)
        if old:
            spark.conf.set(SALES_TABLE_CONF, old)
