"""Changes to stored partitions, the lookup index of the flat table, and the audited snapshot."""

import datetime as dt
import os
import tempfile

import pytest
from pyspark.sql import functions as F

from conftest import SF_SMALL
from ledgerlens.operators import dedupe as D
from ledgerlens.operators import quality as Q
from ledgerlens.operators.rewrite import apply_changes
from ledgerlens.sources.star import materialize_sales, read_sales, sales_lines

SCHEMA = "id long, name string, amount double, year int"
ROWS = [(i, f"n{i}", i / 2, 2000 + i % 4) for i in range(40)]


@pytest.fixture()
def table(spark):
    path = os.path.join(tempfile.mkdtemp(prefix="ll-table-"), "t")
    spark.createDataFrame(ROWS, SCHEMA).coalesce(1).write.partitionBy("year").parquet(path)
    return path


def files(path):
    out = {}
    for root, _, names in os.walk(path):
        for n in names:
            if n.endswith(".parquet"):
                full = os.path.join(root, n)
                out[os.path.relpath(full, path)] = os.stat(full).st_mtime_ns
    return out


def rows(spark, path):
    return sorted(map(tuple, spark.read.schema(SCHEMA).parquet(path).select("id", "name", "amount", "year").collect()))


def test_only_changed_partitions_are_written(spark, table):
    before = files(table)
    changes = spark.createDataFrame(
        [(0, "delete", None), (4, "update", 99.0), (8, "update", None), (8, "update", None), (777, "delete", None)],
        "id long, _op string, amount double")
    assert apply_changes(spark, table, changes, ["id"], "year") == 1
    after = files(table)
    kept = {f: t for f, t in before.items() if "year=2000" not in f}
    assert kept == {f: t for f, t in after.items() if "year=2000" not in f} and len(kept) == 3
    want = [(i, n, 99.0 if i == 4 else None if i == 8 else a, y) for i, n, a, y in ROWS if i]
    assert rows(spark, table) == want


def test_rows_move_and_partitions_empty(spark, table):
    changes = spark.createDataFrame(
        [(i, "delete" if i % 8 == 1 else "update", 2003 if i == 5 else 2010) for i in range(1, 40, 4)],
        "id long, _op string, year int")
    before = files(table)
    assert apply_changes(spark, table, changes, ["id"], "year") == 3  # 2001, where all were; 2003; 2010
    assert not any("year=2001" in f for f in files(table))
    same = [f for f in before if "year=2000" in f or "year=2002" in f]
    assert all(files(table)[f] == before[f] for f in same)
    want = [(i, n, a, y if i % 4 != 1 else 2003 if i == 5 else 2010) for i, n, a, y in ROWS if i % 8 != 1]
    assert rows(spark, table) == sorted(want)


def test_nothing_to_change(spark, table):
    before = files(table)
    assert apply_changes(spark, table, spark.createDataFrame([(500, "delete")], "id long, _op string"), ["id"], "year") == 0
    assert files(table) == before


def test_a_job_that_fails_half_way_changes_nothing(spark, table):
    before = files(table)
    torn = F.when(F.col("id") == 38, F.raise_error(F.lit("lost"))).otherwise(F.col("amount") + 1)
    changes = spark.read.parquet(table).select("id", F.lit("update").alias("_op"), torn.cast("double").alias("amount"))
    with pytest.raises(Exception, match="lost"):
        apply_changes(spark, table, changes, ["id"], "year")
    assert files(table) == before and rows(spark, table) == sorted(ROWS)


def test_a_long_change_list_meets_the_table_once(spark, table, monkeypatch):
    """Lists too long to broadcast: one join by shuffle in all, and the same table after it."""
    from ledgerlens.operators import rewrite
    plans = []

    def noted(df):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return store(df)
    store = rewrite.stored
    monkeypatch.setattr(rewrite, "stored", noted)
    monkeypatch.setattr(rewrite, "BROADCAST_KEYS", 0)
    key = "spark.sql.autoBroadcastJoinThreshold"
    old = spark.conf.get(key)
    spark.conf.set(key, "-1")
    before = files(table)
    changes = spark.createDataFrame(
        [(i, "delete" if i % 8 == 1 else "update", 2003 if i == 5 else 2010) for i in range(1, 40, 4)] * 2 + [(777, "delete", None)],
        "id long, _op string, year int")
    try:
        assert apply_changes(spark, table, changes, ["id"], "year") == 3
    finally:
        spark.conf.set(key, old)
    joins = [p.count("SortMergeJoin") for p in plans]
    assert sum(joins) == 1 and sum(p.count("hashpartitioning(id") for p in plans) == 2
    assert not any("year=2001" in f for f in files(table))
    assert all(files(table)[f] == before[f] for f in before if "year=2000" in f or "year=2002" in f)
    want = [(i, n, a, y if i % 4 != 1 else 2003 if i == 5 else 2010) for i, n, a, y in ROWS if i % 8 != 1]
    assert rows(spark, table) == sorted(want)


def scanned(df):
    """Rows that the file scans of a collected query gave out."""
    df.collect()
    plan, total = df._jdf.queryExecution().executedPlan(), 0
    todo = [plan.executedPlan() if "AdaptiveSparkPlan" in plan.nodeName() else plan]
    while todo:
        node = todo.pop()
        if node.nodeName().startswith("Scan parquet"):
            total += node.metrics().apply("numOutputRows").value()
        todo += [node.children().apply(i) for i in range(node.children().size())]
    return total


def test_lookups_read_the_row_groups_that_may_hold_the_key(spark):
    path = os.path.join(tempfile.mkdtemp(prefix="ll-lookup-"), "sales")
    materialize_sales(spark, SF_SMALL, path, row_group_bytes=64 << 10)
    flat = read_sales(spark, path).select("order_id", "product_id", "sales", "line_number")
    ids = [r[0] for r in flat.select("order_id").distinct().orderBy("order_id").collect()]
    total = flat.count()
    absent = next(i for i in range(ids[0], ids[-1]) if i not in set(ids))
    assert scanned(Q.lookup(flat, order_id=absent)) == 0  # between the least and the greatest
    assert scanned(Q.lookup(flat, product_id=10 ** 9)) == 0
    some = ids[len(ids) // 2]
    want = flat.where(F.col("order_id") == some).count()
    found = Q.lookup(flat, order_id=some)
    assert 0 < scanned(found) <= total / 4 and found.count() == want
    spare = [r[0] for r in flat.groupBy("product_id").count().where("count = 1").limit(1).collect()]
    for p in spare:
        assert Q.lookup(flat, product_id=p).count() == 1


def test_audit_counts_what_was_written(spark):
    lines = sales_lines(spark, SF_SMALL, ["order_id", "ship_mode", "sales", "order_date"]).withColumn(
        "ship_mode", F.when(F.col("order_id") % 7 == 0, "").otherwise(F.col("ship_mode")))
    counters = {"n": F.count(F.lit(1))} | Q.missing_counters(["ship_mode"], ["order_date"], ["sales"])
    path = os.path.join(tempfile.mkdtemp(prefix="ll-audit-"), "copy")
    copy, row = D.audited_snapshot(lines, path, counters)
    want = Q.missing_report(lines, ["ship_mode"], ["order_date"], ["sales"]).first()
    assert tuple(row.first()) == (copy.count(), *want) and want["null_ship_mode"] > 0


def test_date_shapes_survive_the_rewrite(spark):
    path = os.path.join(tempfile.mkdtemp(prefix="ll-dates-"), "t")
    spark.createDataFrame([(1, dt.date(2020, 1, 1), "a b"), (2, None, "c/d"), (3, None, None)],
                          "id long, day date, part string").write.partitionBy("part").parquet(path)
    changes = spark.createDataFrame([(2, "delete"), (3, "delete")], "id long, _op string")
    assert apply_changes(spark, path, changes, ["id"], "part") == 2
    assert [tuple(r) for r in spark.read.parquet(path).select("id", "day", "part").collect()] == [
        (1, dt.date(2020, 1, 1), "a b")]
