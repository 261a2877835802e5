"""Names that differ in case only: one group each where the session ignores case."""

import tempfile

import pytest
from pyspark.sql import functions as F

from conftest import SF_SMALL
from __spark_entry__ import oracle_sql, queries
from ledgerlens.plans.verify import compare, duck_connection
from ledgerlens.sources.star import IGNORE_CASE_CONF, STAR_TABLES

NAMES = ["e09_distinct_categories", "e10_top_category_by_revenue", "e13_top_region_by_revenue",
         "e14_region_margin_ratio", "e16_top_category_per_region", "e17_top_region_by_discount_sum",
         "e18_top_segment_by_revenue", "e19_segment_margin", "e20_segment_discount_and_line_value",
         "e21_ship_mode_usage", "e31_low_margin_region_category", "i21_favourite_ship_mode_per_segment",
         "p17_loss_top10", "r02_distinct_customer_names", "x03_profit_by_region_subcat_with_total"]


@pytest.fixture(scope="module")
def mixed(spark):
    """The small tables with half of the names in lower case; every name also stays as it was."""
    folder = tempfile.mkdtemp(prefix="ll-case-")
    read = {t: spark.read.parquet(f"{SF_SMALL}/{t}.parquet") for t in STAR_TABLES}

    def half(t, key, *cols):
        read[t] = read[t].withColumns({c: F.when(F.col(key) % 2 == 1, F.lower(c)).otherwise(F.col(c)) for c in cols})

    half("orders", "o_orderkey", "o_orderpriority")
    half("customer", "c_custkey", "c_mktsegment")
    half("part", "p_partkey", "p_type", "p_brand")
    # two rows to a region; the nations of one region point to either
    read["region"] = read["region"].unionByName(read["region"].withColumns(
        {"r_regionkey": F.col("r_regionkey") + 100, "r_name": F.lower("r_name")}))
    read["nation"] = read["nation"].withColumn("n_regionkey", F.when(
        F.col("n_nationkey") % 2 == 1, F.col("n_regionkey") + 100).otherwise(F.col("n_regionkey")))
    for t, df in read.items():
        df.withColumns({c: F.col(c).cast(x) for c, x in spark.read.parquet(f"{SF_SMALL}/{t}.parquet").dtypes}) \
            .coalesce(1).write.parquet(f"{folder}/{t}.parquet")
    return folder


@pytest.fixture()
def ignoring(spark):
    spark.conf.set(IGNORE_CASE_CONF, "true")
    yield
    spark.conf.unset(IGNORE_CASE_CONF)


@pytest.mark.parametrize("name", NAMES)
def test_one_row_per_name(spark, mixed, ignoring, name):
    """The same rows as from the tables in one spelling."""
    assert compare(queries()[name](spark, mixed), duck_connection(SF_SMALL), oracle_sql()[name]) == []


def test_names_are_told_apart_by_default(spark, mixed):
    assert queries()["e14_region_margin_ratio"](spark, mixed).count() > \
        queries()["e14_region_margin_ratio"](spark, SF_SMALL).count()
