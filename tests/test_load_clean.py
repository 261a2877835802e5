"""Raw CSV load, header repair, date parsing and typing."""

import datetime as dt
import os
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from ledgerlens.operators.clean import clean_orders, parse_us_date
from ledgerlens.operators.quality import describe
from ledgerlens.sources.raw_csv import RAW_COLUMNS, RAW_HEADER, read_orders, repair_header

HEADER = ",".join(RAW_HEADER)


def _row(row_id, order_id, odate, sdate, name="Ann Lee", product_name="Chair", sales="10.5",
         discount="0", profit="1.5", postal="10001", sub="Chairs"):
    return ",".join([
        str(row_id), order_id, odate, sdate, "Second Class", "CG-1", name, "Consumer",
        "United States", "Henderson", "Kentucky", postal, "South", "FUR-CH-1", "Furniture",
        sub, product_name, sales, "2", discount, profit])


def write_raw(path):
    lines = [
        _row(1, "US-1", "11/8/2016", "11/11/2016", sales="261.9600"),
        _row(2, "US-1", "11-08-2016", "11-11-2016", product_name='"Café table, round"'),
        _row(3, "US-2", "2016-11-08", "2016-11-12"),
        _row(4, "US-3", "13/8/2016", "", sales="0", postal="0"),
        _row(5, "US-3", "1/2/2017", "1/5/2017", sales="22.3680", discount="0.2"),
    ]
    body = "﻿" + HEADER + "\r\n" + "\r\n".join(lines) + "\r\n"
    with open(path, "wb") as f:
        f.write(body.encode("utf-8")[:3] + body[1:].encode("latin-1"))


def test_read_orders_schema_and_text(spark, tmpdir_path):
    p = os.path.join(tmpdir_path, "raw.csv")
    write_raw(p)
    df = read_orders(spark, p)
    assert df.columns == RAW_COLUMNS
    assert all(t == "string" for _, t in df.dtypes)
    rows = df.orderBy(F.col("row_id").cast("int")).collect()
    assert len(rows) == 5
    assert rows[0]["row_id"] == "1"
    assert rows[1]["product_name"] == "Café table, round"   # latin1 + quoted comma
    assert rows[0]["sales"] == "261.9600"


def test_repair_header_drops_bom_residue(spark, tmpdir_path):
    p = os.path.join(tmpdir_path, "raw.csv")
    write_raw(p)
    inferred = spark.read.option("header", True).option("encoding", "ISO-8859-1").csv(p)
    # read as latin1 the UTF-8 BOM shows up in the first header (or is dropped by Spark)
    fixed = repair_header(inferred)
    assert fixed.columns == RAW_COLUMNS


def test_parse_us_date_shapes(spark):
    df = spark.createDataFrame(
        [("11/8/2016",), ("11-08-2016",), ("2016-11-08",), ("13/8/2016",), (None,), ("1/2/2017",)],
        "d string")
    got = [r[0] for r in df.select(parse_us_date("d")).collect()]
    assert got == [dt.date(2016, 11, 8), dt.date(2016, 11, 8), dt.date(2016, 11, 8), None, None,
                   dt.date(2017, 1, 2)]


def test_clean_orders_types_and_rounding(spark, tmpdir_path):
    p = os.path.join(tmpdir_path, "raw.csv")
    write_raw(p)
    clean = clean_orders(read_orders(spark, p))
    types = dict(clean.dtypes)
    assert types["order_date"] == "date" and types["ship_date"] == "date"
    assert types["sales"] == "decimal(18,2)" and types["row_id"] == "bigint"
    assert types["discount"] == "decimal(18,10)" and types["quantity"] == "int"
    rows = {r["row_id"]: r for r in clean.collect()}
    assert rows[1]["sales"] == Decimal("261.96")
    assert rows[5]["sales"] == Decimal("22.37")           # 22.368 rounds half up
    assert rows[4]["order_date"] is None and rows[4]["ship_date"] is None
    assert rows[3]["order_date"] == dt.date(2016, 11, 8)  # ISO text is not misread
    # running the clean job twice changes nothing
    again = clean_orders(clean)
    assert sorted(map(tuple, again.collect())) == sorted(map(tuple, clean.collect()))


def test_sales_round_once_and_other_amounts_keep_their_digits(spark):
    df = spark.createDataFrame([("1.00499996", "0.125", "0.12349"), ("1.005", "0.2", "-3.14159265")],
                               "sales string, discount string, profit string")
    got = [tuple(r) for r in clean_orders(df).collect()]
    assert [r[0] for r in got] == [Decimal("1.00"), Decimal("1.01")]
    assert [r[1] for r in got] == [Decimal("0.125"), Decimal("0.2")]
    assert [r[2] for r in got] == [Decimal("0.12349"), Decimal("-3.14159265")]


def test_line_breaks_and_bad_rows(spark, tmpdir_path):
    from ledgerlens.sources.raw_csv import write_orders_export
    df = spark.createDataFrame([(1, 'desk\nlamp, "new"'), (2, "pen")], "row_id long, product_name string")
    p = os.path.join(tmpdir_path, "broken")
    write_orders_export(df, p, line_breaks=True)
    got = read_orders(spark, p, multi_line=True, bad_rows="bad").cache()
    assert sorted((r.row_id, r.product_name, r.bad) for r in got.collect()) == [
        ("1", 'desk\nlamp, "new"', None), ("2", "pen", None)]
    by_line = read_orders(spark, p, bad_rows="bad").cache()
    assert by_line.where("bad is not null").count() == 2  # the two halves of the first row
    with pytest.raises(Exception, match="line break in product_name"):
        write_orders_export(df, os.path.join(tmpdir_path, "refused"))


def test_export_with_mark_and_mixed_dates(spark, tmpdir_path):
    from ledgerlens.sources.raw_csv import write_orders_export
    days = [dt.date(2016, 1, 1) + dt.timedelta(days=i) for i in range(60)]
    df = spark.createDataFrame([(i, d, d) for i, d in enumerate(days)], "row_id long, order_date date, ship_date date")
    p = os.path.join(tmpdir_path, "mixed")
    write_orders_export(df.coalesce(1), p, mixed_dates=True, mark=True)
    files = [f for f in os.listdir(p) if f.startswith("part-")]
    with open(os.path.join(p, files[0]), "rb") as f:
        assert f.readline().startswith(b"\xef\xbb\xbfRow ID,")
    raw = read_orders(spark, p).collect()
    assert {("/" in r.order_date, r.order_date[4:5] == "-") for r in raw} == {
        (True, False), (False, True), (False, False)}
    back = clean_orders(read_orders(spark, p)).select("row_id", "order_date", "ship_date").collect()
    assert sorted(map(tuple, back)) == [(i, d, d) for i, d in enumerate(days)]


def test_describe_lists_columns(spark):
    df = spark.createDataFrame([(1, "a")], "row_id bigint, order_id string")
    assert [tuple(r) for r in describe(df).collect()] == [("row_id", "bigint"),
                                                          ("order_id", "string")]
