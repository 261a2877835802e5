"""Distributed ranks equal Spark's single-partition windows."""

import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from ledgerlens.operators.ranking import (dense_rank_desc, first_per_group, global_positions,
                                          ntile, rank_within_groups, top_per_group)


def _random_frame(spark, n, distinct, seed):
    rnd = random.Random(seed)
    rows = [(f"k{i:05d}", rnd.randrange(distinct)) for i in range(n)]
    return spark.createDataFrame(rows, "name string, v long")


@pytest.mark.parametrize("n,distinct,tiles", [(1, 1, 4), (3, 2, 4), (50, 3, 4), (997, 21, 4),
                                              (400, 400, 7), (0, 1, 4)])
def test_ntile_matches_window(spark, n, distinct, tiles):
    df = _random_frame(spark, n, distinct, seed=n)
    order = [F.col("v").desc(), F.col("name")]
    ours = {r["name"]: r["t"] for r in ntile(df, tiles, order, "t").collect()}
    ref = {r["name"]: r["t"] for r in
           df.withColumn("t", F.ntile(tiles).over(Window.orderBy(*order))).collect()}
    assert ours == ref
    if n:
        sizes = {}
        for t in ours.values():
            sizes[t] = sizes.get(t, 0) + 1
        assert max(sizes.values()) - min(sizes.values()) <= 1


def test_global_positions_are_a_permutation(spark):
    df = _random_frame(spark, 500, 5, seed=7)
    pos = global_positions(df, ["v", "name"], "p", "N").collect()
    assert sorted(r["p"] for r in pos) == list(range(500))
    assert {r["N"] for r in pos} == {500}


def test_dense_rank_matches_window(spark):
    df = _random_frame(spark, 300, 17, seed=3)
    ours = {r["name"]: r["dr"] for r in dense_rank_desc(df, "v", "dr").collect()}
    ref = {r["name"]: r["dr"] for r in df.withColumn(
        "dr", F.dense_rank().over(Window.orderBy(F.col("v").desc()))).collect()}
    assert ours == ref


def test_rank_within_groups_with_a_hot_key(spark):
    rnd = random.Random(11)
    rows = []
    for i in range(900):
        key = "hot" if i % 3 == 0 else f"g{rnd.randrange(40)}"   # a third of rows in one key
        rows.append((key, i, rnd.randrange(5)))
    df = spark.createDataFrame(rows, "k string, id long, x long")
    ref = {r["id"]: r["rn"] for r in df.withColumn(
        "rn", F.row_number().over(Window.partitionBy("k").orderBy("x", "id"))).collect()}
    # hot threshold below the hot key's size: it takes the distributed path
    ours = {r["id"]: r["rn"] for r in rank_within_groups(df, ["k"], ["x", "id"], "rn",
                                                         hot_rows=100).collect()}
    assert ours == ref
    # every key is hot
    ours = {r["id"]: r["rn"] for r in rank_within_groups(df, ["k"], ["x", "id"], "rn",
                                                         hot_rows=0).collect()}
    assert ours == ref
    # no key is hot: a plain window per key
    ours = {r["id"]: r["rn"] for r in rank_within_groups(df, ["k"], ["x", "id"], "rn").collect()}
    assert ours == ref


def test_first_per_group_matches_row_number(spark):
    rnd = random.Random(5)
    rows = [(f"o{rnd.randrange(30)}", i, rnd.randrange(-50, 50)) for i in range(400)]
    df = spark.createDataFrame(rows, "k string, id long, profit long")
    ours = sorted(map(tuple, first_per_group(df, ["k"], ["profit", "id"]).collect()))
    w = Window.partitionBy("k").orderBy("profit", "id")
    ref = sorted(map(tuple, df.withColumn("rn", F.row_number().over(w)).where("rn = 1")
                     .drop("rn").collect()))
    assert ours == ref


def test_top_per_group_keeps_ties(spark):
    df = spark.createDataFrame([("a", "x", 3), ("a", "y", 3), ("a", "z", 1), ("b", "x", 2)],
                               "g string, m string, n long")
    got = top_per_group(df, ["g"], [F.col("n").desc()], ties=True).collect()
    assert sorted((r["g"], r["m"]) for r in got) == [("a", "x"), ("a", "y"), ("b", "x")]


@pytest.mark.parametrize("n,tiles", [(0, 4), (1, 4), (3, 4), (997, 4), (400, 7)])
def test_ntile_many_matches_separate_windows(spark, n, tiles):
    from ledgerlens.operators.ranking import ntile_many
    rnd = random.Random(n)
    rows = [(f"c{i:05d}", rnd.randrange(30), rnd.randrange(1, 6),
             round(rnd.uniform(0, 500), 2)) for i in range(n)]
    df = spark.createDataFrame(rows, "name string, rec long, freq long, mon double").withColumn(
        "mon", F.col("mon").cast("decimal(18,2)"))
    ours = {r["name"]: (r["r"], r["f"], r["m"]) for r in ntile_many(
        df, tiles, ["name"], {"r": ("rec", False), "f": ("freq", True), "m": ("mon", True)}
    ).collect()}

    def win(col, asc):
        o = F.col(col).asc() if asc else F.col(col).desc()
        return F.ntile(tiles).over(Window.orderBy(o, F.col("name")))
    ref = {r["name"]: (r["r"], r["f"], r["m"]) for r in df.select(
        "name", win("rec", False).alias("r"), win("freq", True).alias("f"),
        win("mon", True).alias("m")).collect()}
    assert ours == ref


def test_salted_join_equals_plain_join(spark):
    from ledgerlens.operators.skew import hot_keys, salted_join
    rnd = random.Random(21)
    big = spark.createDataFrame(
        [("hot" if i % 3 == 0 else f"k{rnd.randrange(50)}", i, rnd.randrange(9)) for i in range(3000)],
        "k string, id long, x long")
    small = spark.createDataFrame([("hot", "H")] + [(f"k{j}", f"v{j}") for j in range(40)],
                                  "k string, label string")
    counts = big.groupBy("k").count().withColumnRenamed("count", "n")
    hot = hot_keys(counts, ["k"], "n", 100)
    assert hot is not None and {r["k"]: r["_salts"] for r in hot.collect()} == {"hot": 10}
    ours = sorted(map(tuple, salted_join(big, small, ["k"], hot).select("k", "id", "x", "label").collect()))
    ref = sorted(map(tuple, big.join(small, "k").select("k", "id", "x", "label").collect()))
    assert ours == ref
    assert hot_keys(counts, ["k"], "n", 10_000) is None


def test_more_hot_keys_than_a_broadcast_holds(spark, monkeypatch):
    """Hot lists of any length: every key hot, and the list too long to broadcast."""
    from pyspark.sql import Window
    from ledgerlens.operators import skew
    from ledgerlens.operators.ranking import rank_within_groups
    monkeypatch.setattr(skew, "BROADCAST_KEYS", 5)
    big = spark.range(2000).select((F.col("id") % 200).alias("k"), F.col("id"))
    small = spark.range(0, 200, 2).select(F.col("id").alias("k"), (F.col("id") * 3).alias("v"))
    hot = skew.hot_keys(big.groupBy("k").agg(F.count(F.lit(1)).alias("n")), ["k"], "n", 1)
    assert hot.count() == 200
    ours = skew.salted_join(big, small, ["k"], hot).select("k", "id", "v").collect()
    assert sorted(map(tuple, ours)) == sorted(map(tuple, big.join(small, "k").select("k", "id", "v").collect()))
    ranked = rank_within_groups(big, ["k"], ["id"], "rn", hot_rows=1)
    ref = big.withColumn("rn", F.row_number().over(Window.partitionBy("k").orderBy("id")))
    assert sorted(map(tuple, ranked.select("k", "id", "rn").collect())) == sorted(
        map(tuple, ref.select("k", "id", "rn").collect()))


def test_over_100_000_hot_keys(spark):
    from ledgerlens.operators.skew import hot_keys, salted_join
    big = spark.range(220_000).select((F.col("id") % 110_000).alias("k"), F.col("id"))
    hot = hot_keys(big.groupBy("k").agg(F.count(F.lit(1)).alias("n")), ["k"], "n", 1)
    joined = salted_join(big, spark.range(110_000).withColumnRenamed("id", "k"), ["k"], hot)
    assert hot.count() == 110_000 and joined.count() == 220_000
