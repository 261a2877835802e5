"""Audit and de-duplication (C08, C09, C11-C22) on hand-written rows."""

import os
import re

import pytest
from decimal import Decimal

from pyspark.sql import functions as F

from ledgerlens.operators import dedupe as D
from ledgerlens.operators import quality as Q

SCHEMA = ("row_id bigint, order_id string, customer_id string, product_id string, "
          "sales decimal(18,2), quantity int, discount decimal(4,2), profit decimal(18,4), "
          "ship_mode string, postal_code string")


def lines(spark):
    d = Decimal
    rows = [
        (1, "A", "c1", "p1", d("10.00"), 1, d("0"), d("1.0"), "First", "10001"),
        (2, "A", "c1", "p2", d("20.00"), 1, d("0"), d("2.0"), "", "10001"),
        (3, "A", "c1", "p3", d("30.00"), 2, d("0.2"), d("-1.0"), None, "10001"),
        (4, "B", "c2", "p1", d("10.00"), 1, d("0"), d("1.0"), "First", "0"),
        (5, "B", "c2", "p1", d("10.00"), 1, d("0"), d("1.0"), "First", "20002"),   # copy of 4
        (6, "C", "c3", "p9", d("0.00"), 1, d("0"), d("0.0"), "Second", "30003"),
        (7, "D", "c4", "p4", None, 1, d("0"), d("0.0"), "Second", None),
    ]
    return spark.createDataFrame(rows, SCHEMA)


def test_missing_report(spark):
    r = Q.missing_report(lines(spark), ["ship_mode", "postal_code"], ["order_id"], ["sales"]).first()
    assert r["null_ship_mode"] == 2          # '' and NULL
    assert r["null_postal_code"] == 1
    assert r["null_order_id"] == 0
    assert r["null_sales"] == 2              # 0 and NULL


def test_suspect_rows(spark):
    got = Q.suspect_rows(lines(spark), ["row_id"]).collect()
    assert sorted(r[0] for r in got) == [4, 6, 7]


def test_lookup_and_counts(spark):
    df = lines(spark)
    assert [r[0] for r in Q.lookup(df, ["row_id"], order_id="B", product_id="p1").collect()] in (
        [4, 5], [5, 4])
    r = Q.rows_vs_keys(df).first()
    assert (r["total_rows"], r["unique_orders"], r["extra_lines"]) == (7, 4, 3)
    assert Q.row_count(df).first()[0] == 7
    assert Q.distinct_count(df, "order_id", "n").first()[0] == 4


def test_repeated_and_rows_of_repeated(spark):
    df = lines(spark)
    rep = {r["order_id"]: r["total"] for r in D.repeated_keys(df, ["order_id"]).collect()}
    assert rep == {"A": 3, "B": 2}
    rows = D.rows_of_repeated_keys(df, ["order_id"]).select("row_id").collect()
    assert sorted(r[0] for r in rows) == [1, 2, 3, 4, 5]


def test_extra_lines_ranks(spark):
    got = D.extra_lines(lines(spark), ["order_id"], ["row_id"]).select(
        "row_id", "duplicate_rank").collect()
    assert sorted(map(tuple, got)) == [(2, 2), (3, 3), (5, 2)]


KEY7 = ["order_id", "customer_id", "product_id", "sales", "quantity", "discount", "profit"]


def test_dedupe_keeps_lowest_row_id_and_is_idempotent(spark):
    df = lines(spark)
    assert D.repeated_keys(df, KEY7).count() == 1
    with pytest.raises(AssertionError):
        D.assert_no_duplicates(df, KEY7)
    once = D.dedupe(df, KEY7, ["row_id"])
    ids = sorted(r["row_id"] for r in once.collect())
    assert ids == [1, 2, 3, 4, 6, 7]
    D.assert_no_duplicates(once, KEY7)
    twice = D.dedupe(once, KEY7, ["row_id"])
    assert sorted(map(tuple, twice.collect())) == sorted(map(tuple, once.collect()))
    assert once.columns == df.columns


def weak(keys):
    """Two different digests for all rows there are."""
    return [F.pmod(F.xxhash64(*keys), F.lit(2)), F.lit(0).cast("long")]


@pytest.mark.parametrize("digest", [D.line_digest, weak])
def test_digests_only_choose_suspects(spark, digest):
    """Rows that share a digest are told apart by their keys, null keys and values included."""
    d = Decimal
    extra = [(8, None, "c1", None, None, 1, d("0"), d("1.0"), "x", "1"),
             (9, None, "c1", None, None, 1, d("0"), d("1.0"), "y", "2")]
    df = lines(spark).unionByName(spark.createDataFrame(extra, SCHEMA))
    kept = D.dedupe(df, KEY7, ["row_id"], digest=digest)
    assert sorted(r["row_id"] for r in kept.collect()) == [1, 2, 3, 4, 6, 7, 8]
    got = D.repeated_keys_by_digest(df, KEY7, digest=digest)
    assert sorted(map(str, got.collect())) == sorted(map(str, D.repeated_keys(df, KEY7).collect()))
    assert D.suspects(kept, ["row_id"]) is None
    narrow = D.dedupe(df, KEY7, ["row_id"], df.select("order_id"), ["order_id"], digest)
    assert sorted(map(str, narrow.collect())) == sorted(map(str, kept.collect()))


def test_a_third_of_the_rows_one_duplicate(spark):
    rows = [(i, "hot" if i % 3 == 0 else f"o{i}") for i in range(3000)]
    df = spark.createDataFrame(rows, "row_id long, order_id string").repartition(8)
    kept = sorted(r.row_id for r in D.dedupe(df, ["order_id"], ["row_id"]).collect())
    assert kept == sorted([0, *[i for i in range(3000) if i % 3]])


@pytest.mark.parametrize("order", [["row_id"], ["tag", "row_id"], ["column"]])
def test_many_copies_are_folded_without_a_digest_search(spark, monkeypatch, order):
    """Where most rows are copies, their digests are not counted, stored and joined first."""
    def never(*a, **k):
        raise AssertionError("digests searched")
    monkeypatch.setattr(D, "suspects", never)
    rows = [(i, i % 500 if i % 7 else None, None if i % 3 else "t", float(i)) for i in range(2000)]
    df = spark.createDataFrame(rows, "row_id long, k int, tag string, x double")
    kept = D.dedupe(df, ["k"], [F.col("row_id")] if order == ["column"] else order)
    best = {}
    for r in sorted(rows, key=lambda r: (r[2] is not None, r[0]) if len(order) == 2 else r[0]):
        best.setdefault(r[1], r)
    assert kept.columns == df.columns
    assert sorted(map(str, map(tuple, kept.collect()))) == sorted(map(str, best.values()))


def test_doubled_lines_fold_in_the_part_joins_partitions(spark):
    """The copies of a line meet where the part join has put them: no shuffle of their own."""
    from __spark_entry__ import queries
    from conftest import SF_SMALL
    key = "spark.sql.autoBroadcastJoinThreshold"
    old = spark.conf.get(key)
    spark.conf.set(key, "-1")
    try:
        doubled = queries()["c21b_dedupe_doubled_lines"](spark, SF_SMALL)
        plan = doubled._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set(key, old)
    assert "hashpartitioning(product_id" in plan
    assert "hashpartitioning(order_id" in plan and not re.search(r"hashpartitioning\(order_id#\w+, \w+#", plan)
    once = queries()["c21_dedupe_lines"](spark, SF_SMALL)
    assert sorted(map(str, doubled.collect())) == sorted(map(str, once.collect()))


def test_snapshot_refuses_to_overwrite(spark, tmpdir_path):
    df = lines(spark)
    path = os.path.join(tmpdir_path, "backup")
    back = D.snapshot(df, path)
    assert back.count() == 7
    with pytest.raises(Exception):
        D.snapshot(df, path)
