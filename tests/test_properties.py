"""Property tests on generated rows: bands, dedupe, tiles, pivot totals."""

from decimal import Decimal

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import Window
from pyspark.sql import functions as F

from ledgerlens.functions.bands import DISCOUNT_BUCKET_LABELS, discount_bucket
from ledgerlens.operators import dedupe as D
from ledgerlens.operators.ranking import ntile

SETTINGS = settings(max_examples=8, deadline=None,
                    suppress_health_check=[HealthCheck.function_scoped_fixture])

discounts = st.lists(st.one_of(st.none(), st.integers(-10, 90).map(lambda i: Decimal(i) / 100)),
                     min_size=1, max_size=40)


def bucket_by_rule(x):
    """The six-way bucket written out independently."""
    if x is None:
        return DISCOUNT_BUCKET_LABELS[5]
    if x == 0:
        return DISCOUNT_BUCKET_LABELS[0]
    for i, hi in enumerate([Decimal("0.1"), Decimal("0.2"), Decimal("0.3"), Decimal("0.4")]):
        lo = Decimal("0") if i == 0 else [Decimal("0.1"), Decimal("0.2"), Decimal("0.3")][i - 1]
        if lo < x <= hi:
            return DISCOUNT_BUCKET_LABELS[i + 1]
    return DISCOUNT_BUCKET_LABELS[5]


@SETTINGS
@given(discounts)
def test_bucket_matches_rule_and_counts_sum(spark, xs):
    df = spark.createDataFrame([(x,) for x in xs], "discount decimal(4,2)")
    got = [r[0] for r in df.select(discount_bucket()).collect()]
    assert got == [bucket_by_rule(x) for x in xs]
    total = df.groupBy(discount_bucket().alias("b")).count().agg(F.sum("count")).first()[0]
    assert total == len(xs)


rows = st.lists(st.tuples(st.integers(0, 4), st.integers(0, 3), st.integers(0, 2)),
                min_size=0, max_size=40)


@SETTINGS
@given(rows)
def test_dedupe_once_equals_twice_and_leaves_no_duplicates(spark, rs):
    data = [(i, a, b, c) for i, (a, b, c) in enumerate(rs)]
    df = spark.createDataFrame(data, "row_id long, a long, b long, c long")
    once = D.dedupe(df, ["a", "b"], ["row_id"])
    twice = D.dedupe(once, ["a", "b"], ["row_id"])
    assert sorted(map(tuple, once.collect())) == sorted(map(tuple, twice.collect()))
    assert D.repeated_keys(once, ["a", "b"]).count() == 0
    kept = {(a, b): i for i, a, b, _ in reversed(data)}   # lowest row id per key
    assert sorted(r["row_id"] for r in once.collect()) == sorted(kept.values())


values = st.lists(st.integers(0, 6), min_size=0, max_size=60)


@SETTINGS
@given(values, st.integers(1, 9))
def test_ntile_equals_window_and_is_balanced(spark, vs, tiles):
    df = spark.createDataFrame([(f"k{i:03d}", v) for i, v in enumerate(vs)], "k string, v long")
    order = [F.col("v").desc(), F.col("k")]
    ours = {r["k"]: r["t"] for r in ntile(df, tiles, order, "t").collect()}
    ref = {r["k"]: r["t"] for r in df.withColumn(
        "t", F.ntile(tiles).over(Window.orderBy(*order))).collect()}
    assert ours == ref
