"""Quoted line breaks in split files: the same rows as ``multiLine``, in several tasks."""

import os
import random

import pytest
from pyspark.sql import functions as F

from ledgerlens.sources.raw_csv import RAW_COLUMNS, RAW_HEADER, read_orders
from ledgerlens.sources import split_csv
from ledgerlens.sources.split_csv import read_split_csv, write_crlf_export


@pytest.fixture()
def small_splits(spark):
    old = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    spark.conf.set("spark.sql.files.maxPartitionBytes", "700")
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    yield
    for k, v in old.items():
        spark.conf.set(k, v)


def quoted(v):
    return '"' + v.replace('"', '""') + '"' if any(c in v for c in ',"\r\n') else v


def write(path, rows, end="\r\n"):
    with open(path, "w", encoding="latin-1", newline="") as f:
        f.write(end.join([",".join(RAW_HEADER), *rows]) + end)


def field(rng):
    parts = ["Chair", "é", "a,b", 'say "hi"', "two\r\nlines", "x\ny\n", '"', ',"', '",\r\n"', "", "5' tall", "\n\n"]
    return "".join(rng.choices(parts, k=rng.randrange(3)))


def found(df):
    return sorted(str(tuple(r)).replace("\\r\\n", "\\n") for r in df.collect())


@pytest.mark.parametrize("end", ["\r\n", "\n"])
def test_same_rows_as_multi_line(spark, tmpdir_path, small_splits, end):
    rng = random.Random(len(end))
    for part in range(3):
        rows = [",".join(quoted(field(rng)) if k else f"{part}-{i}" for k in range(21)) for i in range(60)]
        write(os.path.join(tmpdir_path, f"p{part}.csv"), rows, end)
    got = read_split_csv(spark, tmpdir_path, bad_rows="bad")
    want = read_orders(spark, tmpdir_path, multi_line=True, bad_rows="bad").cache()
    assert found(got.drop("bad")) == found(want.drop("bad"))
    assert got.where("bad is not null").count() == want.where("bad is not null").count() == 0
    assert spark.read.text(tmpdir_path).rdd.getNumPartitions() > 20
    assert got.columns == [*RAW_COLUMNS, "bad"]


def test_quotes_inside_plain_fields_do_not_open(spark, tmpdir_path, small_splits):
    rows = [f'{i},a 5" board,"q ""{i}""\r\nnext",' + ",".join("x" * 18) for i in range(80)]
    write(os.path.join(tmpdir_path, "a.csv"), rows)
    got = read_split_csv(spark, tmpdir_path).select("row_id", "order_id", "order_date").collect()
    assert sorted(map(tuple, got)) == sorted((str(i), 'a 5" board', f'q "{i}"\nnext') for i in range(80))


def test_a_record_over_several_splits(spark, tmpdir_path, small_splits):
    long = "\r\n".join(f"line {i}, of many" for i in range(300))
    rows = [f'{i},"{long}",' + ",".join("x" * 19) for i in range(3)] + ["9," + ",".join("y" * 20)]
    write(os.path.join(tmpdir_path, "a.csv"), rows)
    got = {r.row_id: r.order_id for r in read_split_csv(spark, tmpdir_path).collect()}
    assert got == {"0": long.replace("\r", ""), "1": long.replace("\r", ""), "2": long.replace("\r", ""), "9": "y"}


def test_bad_rows_and_blank_lines(spark, tmpdir_path, small_splits):
    good = [f"{i}," + ",".join("x" * 20) for i in range(40)]
    rows = [r for g in good for r in (g, "", "only,three,fields")]
    write(os.path.join(tmpdir_path, "a.csv"), rows)
    got = read_split_csv(spark, tmpdir_path, bad_rows="bad")
    assert got.where("bad is null").count() == 40 and got.where("bad is not null").count() == 40
    write(os.path.join(tmpdir_path, "b.csv"), [])
    assert read_split_csv(spark, os.path.join(tmpdir_path, "b.csv")).count() == 0


def test_lines_are_not_shuffled(spark, tmpdir_path, small_splits):
    """Lines are cut into records where they are read; only pieces at split ends were grouped before."""
    rows = [f'{i},"two\r\nlines",' + ",".join("x" * 19) for i in range(200)]
    write(os.path.join(tmpdir_path, "a.csv"), rows)
    got = read_split_csv(spark, tmpdir_path, bad_rows="bad")
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning" not in plan and "Window" not in plan and "SortAggregate" not in plan
    assert got.where("bad is null").count() == 200


@pytest.mark.parametrize("batch", [1, 3, 1000])
def test_records_over_batches_and_splits(spark, tmpdir_path, small_splits, batch):
    """The state is carried over batches, splits and files of one task."""
    rng = random.Random(batch)
    for part in range(4):
        rows = [",".join(quoted(field(rng)) if k else f"{part}-{i}" for k in range(21)) for i in range(40)]
        write(os.path.join(tmpdir_path, f"p{part}.csv"), rows, "\n")
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    old = spark.conf.get(key)
    spark.conf.set(key, batch)
    try:
        want = found(read_orders(spark, tmpdir_path, multi_line=True))
        assert found(read_split_csv(spark, tmpdir_path)) == want
        spark.conf.set("spark.sql.files.maxPartitionBytes", "1000000")
        assert found(read_split_csv(spark, tmpdir_path)) == want
    finally:
        spark.conf.set(key, old)


@pytest.mark.parametrize("kept", [0, 40, 400])
def test_pieces_too_long_to_be_noted(spark, tmpdir_path, small_splits, monkeypatch, kept):
    """Splits whose pieces of records are long are read again; the rows are the same."""
    monkeypatch.setattr(split_csv, "KEPT_CHARS", kept)
    rng = random.Random(kept)
    for part in range(3):
        rows = [",".join(quoted(field(rng)) if k else f"{part}-{i}" for k in range(21)) for i in range(60)]
        rows.insert(30, f'{part},"' + "\r\n".join(f"line {i}, of many" for i in range(100)) + '",' + ",".join("x" * 19))
        write(os.path.join(tmpdir_path, f"p{part}.csv"), rows)
    with open(os.path.join(tmpdir_path, "never_closed.csv"), "w") as f:
        f.write("\n".join([",".join(RAW_HEADER), f'7,"{"z" * 50}', *[f"{i}," + "y" * 50 for i in range(60)]]))
    assert found(read_split_csv(spark, tmpdir_path)) == found(read_orders(spark, tmpdir_path, multi_line=True))


def test_export_is_compressed_and_still_split(spark, tmpdir_path):
    """The export was as large as its text before; its files are read in several splits, with
    records over their ends."""
    n = 30_000
    name = F.when(F.col("id") % 2 == 0, F.concat(F.lit('two\r\n"lines" '), F.sha2(F.col("id").cast("string"), 256)))
    df = spark.range(0, n, 1, 2).select(
        "id", F.col("id").cast("string").alias("order_id"), name.alias("product_name"), (F.col("id") % 7).alias("quantity"),
        F.lit("a ship mode that all lines share, " * 4).alias("ship_mode"))
    path = os.path.join(tmpdir_path, "export")
    write_crlf_export(df, path, RAW_COLUMNS, F.col("id") % 1000 == 7)
    files = [f for f in os.listdir(path) if f.startswith("part-")]
    assert len(files) == 2 and all(f.endswith(".bz2") for f in files)
    chars = spark.read.text(path).agg(F.sum(F.length("value") + 1)).head()[0]
    assert sum(os.path.getsize(os.path.join(path, f)) for f in files) * 3 < chars
    old = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    spark.conf.set("spark.sql.files.maxPartitionBytes", "100000")
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    try:
        splits = spark.read.text(path).select("_metadata.file_path", "_metadata.file_block_start").distinct().count()
        assert splits > 2 * len(files)
        got = read_split_csv(spark, path, bad_rows="bad", header=False)
        assert got.where("bad is not null").count() == n // 1000
        cols = ["order_id", "product_name", "quantity", "ship_mode"]
        want = df.select("order_id", F.replace("product_name", F.lit("\r\n"), F.lit("\n")).alias("product_name"),
                         F.col("quantity").cast("string").alias("quantity"), "ship_mode")
        rows = got.where("bad is null").select(cols)
        assert rows.count() == n and rows.exceptAll(want).isEmpty()
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
