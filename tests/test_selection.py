"""Selected NTILE edges equal Spark's windows, with ties, nulls and few rows."""

import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from conftest import SF_ORACLE, SF_SMALL
from __spark_entry__ import queries
from ledgerlens.operators.selection import edge_positions, ntile_by_cuts, select_positions
from ledgerlens.session import stored
from test_plans_streaming import plan_text

ORDERS = {"r": ("a", False), "f": ("b", True), "m": ("c", True)}


def frame(spark, n, distinct, seed):
    rnd = random.Random(seed)

    def value(top):
        return None if rnd.random() < 0.1 else rnd.randrange(top)
    rows = [(f"k{i:05d}" if i else "\U0001F600é", value(distinct), value(3),
             None if rnd.random() < 0.05 else round(rnd.uniform(-50, 50), 2)) for i in range(n)]
    rnd.shuffle(rows)
    return spark.createDataFrame(rows, "name string, a long, b long, c double")


@pytest.mark.parametrize("n,distinct,tiles,sample", [
    (0, 1, 4, 50), (1, 1, 4, 50), (3, 2, 4, 50), (5, 1, 4, 2), (50, 3, 4, 50), (997, 21, 4, 20),
    (2500, 1, 4, 40), (2500, 2500, 7, 40), (400, 400, 10, 5)])
def test_tiles_match_windows(spark, n, distinct, tiles, sample):
    df = stored(frame(spark, n, distinct, seed=n + tiles))
    got = ntile_by_cuts(df, tiles, ["name"], ORDERS, sample_rows=sample)
    want = df
    for name, (value, asc) in ORDERS.items():
        by = F.col(value).asc() if asc else F.col(value).desc()
        want = want.withColumn(name, F.ntile(tiles).over(Window.orderBy(by, "name")).cast("long"))
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))


def test_one_value_for_a_third_of_the_rows(spark):
    rows = [(f"n{i:06d}", 7 if i % 3 == 0 else i) for i in range(9000)]
    df = stored(spark.createDataFrame(rows, "name string, v long").repartition(9))
    order = sorted(rows, key=lambda r: (r[1], r[0]))
    positions = [1, 2500, 3001, 3002, 9000]
    found = select_positions(df, ["name"], [("v", True)], positions, 9000, sample_rows=60)[0]
    assert [f[-1] for f in found] == [order[p - 1][0] for p in positions]


def test_edge_positions():
    assert edge_positions(10, 4) == [3, 6, 8]
    assert edge_positions(3, 4) == [1, 2, 3]
    assert edge_positions(0, 4) == [0, 0, 0]


@pytest.mark.parametrize("name", ["r05_rfm_scores", "r06_rfm_segments"])
def test_scores_need_no_sort_and_no_shuffle(spark, name):
    plan = plan_text(queries()[name](spark, SF_SMALL))
    main = plan.split("Subquery")[0]
    assert "Exchange" not in main and "Sort" not in main and "Window" not in main
    assert "rangepartitioning" not in plan and "Scan ExistingRDD" not in plan


def test_segments_on_the_larger_tables(spark):
    """Several rounds of narrowing give the windows' scores."""
    got = queries()["r05_rfm_scores"](spark, SF_ORACLE)
    want = got
    for name, (value, asc) in {"r_score": ("recency", False), "f_score": ("frequency", True),
                               "m_score": ("monetary", True)}.items():
        by = F.col(value).asc() if asc else F.col(value).desc()
        want = want.withColumn(name, F.ntile(4).over(Window.orderBy(by, "customer_name")).cast("long"))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
