"""Load, audit and de-duplicate (C01-C22 on the sales tables).

The load path (C01-C04, C06, C10) runs on a raw export of the whole sales
view; its edge cases (BOM, latin1, date shapes) are unit-tested on
hand-written fixtures. C07 (schema listing) is unit-tested only.
"""

from __future__ import annotations

import os
import uuid

from pyspark.sql import functions as F

from ledgerlens.functions import metrics as M
from ledgerlens.operators import dedupe as D
from ledgerlens.operators import quality as Q
from ledgerlens.operators import rewrite as W
from ledgerlens.operators.clean import clean_orders
from ledgerlens.plans.common import SCAN_SQL, money_out, money_out_sql, scan
from ledgerlens.plans.oracle import with_sales
from ledgerlens.plans.registry import register
from ledgerlens.session import scratch_dir, stored
from ledgerlens.sources.lattice import distinct_keys
from ledgerlens.sources.raw_csv import RAW_COLUMNS, read_orders, write_orders_export
from ledgerlens.sources.split_csv import read_split_csv, write_crlf_export
from ledgerlens.operators.skew import hot_key_rows, hot_keys, salted_join
from ledgerlens.sources.star import (LINE_COLUMNS, ORDER_COLUMNS, ROW_ORDER, SALES_COLUMNS,
                                     order_dimension, sales_lines, with_order_columns)

# every table an order-level column may come from
ORDER_NEEDS = {"orders", "customer", "nation", "region"}

# Keys of an existing line of the sf0.01 tables.
LOOKUP_ORDER, LOOKUP_LINE, LOOKUP_PRODUCT = 5979, 6, 1616
# The reference's duplicate keys - five columns to find exact duplicate
# lines, seven to delete them.
DUPLICATE_KEYS = ["order_id", "product_id", "sales", "quantity", "discount"]
DEDUPE_KEYS = ["order_id", "customer_id", "product_id", "sales", "quantity", "discount", "profit"]
DEDUPE_ORDER = [c for c in ROW_ORDER if c not in DEDUPE_KEYS]

TEXT_COLS = ["order_id", "ship_mode", "customer_id", "customer_name", "segment", "country", "city",
             "state", "postal_code", "region", "product_id", "category", "sub_category", "product_name"]
NULL_ONLY_COLS = ["order_date", "ship_date"]


def _null_counts() -> list[str]:
    parts = [f"COUNT(CASE WHEN coalesce(CAST({c} AS VARCHAR), '') = '' THEN 1 END) AS null_{c}"
             for c in TEXT_COLS]
    parts += [f"COUNT(CASE WHEN {c} IS NULL THEN 1 END) AS null_{c}" for c in NULL_ONLY_COLS]
    return [*parts, "COUNT(CASE WHEN coalesce(sales, 0) = 0 THEN 1 END) AS null_sales"]


_NULL_COUNTS = _null_counts()


register("c05_scan_sales", SCAN_SQL, "C05")(scan)


_EXPORT_SQL = with_sales("""
    SELECT CAST(NULL AS BIGINT) AS row_id, CAST(order_id AS VARCHAR) AS order_id,
           order_date, ship_date, ship_mode, CAST(customer_id AS VARCHAR) AS customer_id,
           customer_name, segment, CAST(NULL AS VARCHAR) AS country, CAST(NULL AS VARCHAR) AS city,
           state, CAST(NULL AS VARCHAR) AS postal_code, region,
           CAST(product_id AS VARCHAR) AS product_id, category, sub_category, product_name,
           CAST(sales AS DOUBLE) AS sales, quantity, CAST(discount AS DOUBLE) AS discount,
           CAST(profit AS DOUBLE) AS profit
    FROM sales""")


@register("c01_load_clean_export", _EXPORT_SQL, ("C01", "C02", "C03", "C04", "C06", "C10"))
def c01(spark, d):
    """The load + clean job on a raw export of the whole sales view.

    The view is written in the raw layout (text columns, a byte-order mark in the first
    header, the date text of each row by turns with slashes, hyphens and in ISO order)
    to a new folder in the application's scratch folder, then read back with the all-text
    schema and typed by ``clean_orders``. ``session.drop_scratch`` removes the copy.
    """
    path = os.path.join(scratch_dir(spark), f"export-{uuid.uuid4().hex}")
    write_orders_export(sales_lines(spark, d), path, mixed_dates=True, mark=True)
    clean = clean_orders(read_orders(spark, path))
    return clean.select(*[F.col(c).cast("double").alias(c) if c in ("sales", "discount", "profit")
                          else F.col(c) for c in RAW_COLUMNS])


# A harder export of the same view: CRLF line ends, every fifth product name with a line
# break and quotes in it, sales at their full four places, and a torn row after every
# order line numbered 7.
_BROKEN_NAME = "product_name || chr(10) || 'called \"' || sub_category || '\", so'"


@register("c01b_load_split_export", with_sales(f"""
    SELECT CAST(order_id AS VARCHAR) AS order_id, order_date, ship_date, ship_mode, customer_name, region,
           CAST(product_id AS VARCHAR) AS product_id,
           CASE WHEN product_id % 5 = 0 THEN {_BROKEN_NAME} ELSE product_name END AS product_name,
           CAST(sales AS DOUBLE) AS sales, quantity, CAST(discount AS DOUBLE) AS discount,
           CAST(profit AS DOUBLE) AS profit, CAST(0 AS BIGINT) AS torn_rows
    FROM sales
    UNION ALL
    SELECT NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, COUNT(*)
    FROM sales WHERE line_number = 7"""), ("C01", "C02", "C03", "C10"))
def c01b(spark, d):
    """The load + clean job on that export, read in splits; a last row counts the torn rows.
    The rows read are stored, as the clean job and the count each go through them."""
    path = os.path.join(scratch_dir(spark), f"export-{uuid.uuid4().hex}")
    lines = sales_lines(spark, d, [*SALES_COLUMNS, "list_price"])
    broken = F.concat("product_name", F.lit("\r\ncalled \""), "sub_category", F.lit("\", so"))
    full = F.col("list_price") * (1 - F.col("discount"))
    shown = lines.withColumns({
        "product_name": F.when(F.col("product_id") % 5 == 0, broken).otherwise(F.col("product_name")),
        "sales": full, **{c: F.date_format(c, "M/d/yyyy") for c in ("order_date", "ship_date")}})
    write_crlf_export(shown, path, RAW_COLUMNS, F.col("line_number") == 7)
    read = stored(read_split_csv(spark, path, bad_rows="torn", header=False))
    good = clean_orders(read.where("torn is null"))
    out = good.select("order_id", "order_date", "ship_date", "ship_mode", "customer_name", "region", "product_id",
                      "product_name", *[F.col(c).cast("double" if c != "quantity" else "int").alias(c)
                                        for c in ("sales", "quantity", "discount", "profit")],
                      F.lit(0).cast("long").alias("torn_rows"))
    torn = read.where("torn is not null").agg(F.count(F.lit(1)).alias("torn_rows"))
    return out.unionByName(torn, allowMissingColumns=True)


@register("c20_snapshot_sales", SCAN_SQL, "C20")
def c20(spark, d):
    """Back up the table before de-duplicating: a new, never overwritten folder in the
    application's scratch folder, read back. ``session.drop_scratch`` removes it."""
    path = os.path.join(scratch_dir(spark), f"snapshot-{uuid.uuid4().hex}")
    return D.snapshot(sales_lines(spark, d), path).select(*money_out(SALES_COLUMNS))


@register("c20b_audited_snapshot", with_sales(
    "SELECT COUNT(*) AS row_count,\n       " + ",\n       ".join(_NULL_COUNTS) + " FROM sales"), ("C08", "C15", "C20"))
def c20b(spark, d):
    """The back-up and the missing-value audit from one scan: counters observed while the
    copy is written."""
    path = os.path.join(scratch_dir(spark), f"snapshot-{uuid.uuid4().hex}")
    counters = {"row_count": M.rows()} | Q.missing_counters(TEXT_COLS, NULL_ONLY_COLS, ["sales"])
    return D.audited_snapshot(sales_lines(spark, d, TEXT_COLS + NULL_ONLY_COLS + ["sales"]), path, counters)[1]


# Row keys of the in-place change: all that tells two lines apart.
_CHANGE_KEYS = ["order_id", "line_number", "product_id", "supplier_id", "quantity", "discount", "list_price"]


@register("c10b_change_stored_lines", with_sales("""
    SELECT order_id, line_number, product_id, supplier_id, CAST(sales AS DOUBLE) AS sales,
           CAST(year(order_date) AS INTEGER) AS order_year
    FROM sales WHERE NOT (year(order_date) = (SELECT MIN(year(order_date)) FROM sales) AND line_number = 7)"""),
    ("C10", "C21"))
def c10b(spark, d):
    """Sales rounded and lines deleted in a stored table: the view is written with sales at
    their full places, by year; lines whose sales have more than two places are updated,
    lines numbered 7 of the first year deleted, and only partitions that hold some are
    written again."""
    path = os.path.join(scratch_dir(spark), f"lines-{uuid.uuid4().hex}")
    full = (F.col("list_price") * (1 - F.col("discount"))).alias("sales")
    lines = sales_lines(spark, d, [*_CHANGE_KEYS, "order_date"]).select(
        *_CHANGE_KEYS, full, F.year("order_date").alias("order_year"))
    lines.write.partitionBy("order_year").parquet(path)
    table = spark.read.parquet(path)
    first = table.agg(F.min("order_year")).head()[0]
    gone = (F.col("order_year") == first) & (F.col("line_number") == 7)
    rounded = F.round("sales", 2)
    changes = table.where(gone | (F.col("sales") != rounded)).select(
        *_CHANGE_KEYS, F.when(gone, F.lit(W.DELETE)).otherwise(F.lit(W.UPDATE)).alias(W.OP), rounded.alias("sales"))
    W.apply_changes(spark, path, changes, _CHANGE_KEYS, "order_year")
    return spark.read.parquet(path).select("order_id", "line_number", "product_id", "supplier_id",
                                           F.col("sales").cast("double").alias("sales"), "order_year")


@register("c04_clean_sales", SCAN_SQL, "C04")
def c04(spark, d):
    """The clean job over the typed view: already-typed columns pass through."""
    return clean_orders(sales_lines(spark, d)).select(*money_out(SALES_COLUMNS))


@register("c08_missing_value_audit", with_sales("SELECT " + ",\n       ".join(_NULL_COUNTS) + " FROM sales"), "C08")
def c08(spark, d):
    s = sales_lines(spark, d, TEXT_COLS + NULL_ONLY_COLS + ["sales"])
    return Q.missing_report(s, TEXT_COLS, NULL_ONLY_COLS, ["sales"])


@register("c09_line_lookup", with_sales(f"""
    SELECT CAST(sales AS DOUBLE) AS sales, CAST(ROUND(sales, 2) AS DOUBLE) AS sales_rounded
    FROM sales WHERE order_id = {LOOKUP_ORDER} AND line_number = {LOOKUP_LINE}
                 AND product_id = {LOOKUP_PRODUCT}"""), "C09")
def c09(spark, d):
    s = Q.lookup(sales_lines(spark, d, ["order_id", "line_number", "product_id", "sales"]),
                 order_id=LOOKUP_ORDER, line_number=LOOKUP_LINE, product_id=LOOKUP_PRODUCT)
    return s.select(F.col("sales").cast("double").alias("sales"),
                    F.round("sales", 2).cast("double").alias("sales_rounded"))


_SUSPECT_COLS = ["order_id", "line_number", "product_id", "supplier_id", "state", "region",
                 "postal_code", "sales"]


@register("c11_suspect_rows", with_sales(f"""
    SELECT {money_out_sql(_SUSPECT_COLS)} FROM sales
    WHERE coalesce(sales, 0) = 0 OR TRY_CAST(postal_code AS INTEGER) = 0"""), "C11")
def c11(spark, d):
    s = Q.suspect_rows(sales_lines(spark, d, _SUSPECT_COLS), _SUSPECT_COLS)
    return s.select(*money_out(_SUSPECT_COLS))


@register("c12_repeated_order_ids", with_sales("""
    SELECT order_id, COUNT(*) AS total FROM sales GROUP BY order_id HAVING COUNT(*) > 1"""), "C12")
def c12(spark, d):
    return D.repeated_keys(sales_lines(spark, d, ["order_id"]), ["order_id"])


@register("c13_rows_of_repeated_orders", with_sales(f"""
    SELECT {money_out_sql(SALES_COLUMNS)} FROM sales
    WHERE order_id IN (SELECT order_id FROM sales GROUP BY order_id HAVING COUNT(*) > 1)
    ORDER BY order_id"""), "C13")
def c13(spark, d):
    # repeated orders are counted on the order ids alone; one join then keeps their
    # lines and adds the order columns, salted so a hot order spreads over tasks
    lines = sales_lines(spark, d, LINE_COLUMNS)
    counts = D.repeated_keys(sales_lines(spark, d, ["order_id"]), ["order_id"])
    orders = order_dimension(spark, d, ORDER_NEEDS).select("order_id", *ORDER_COLUMNS)
    repeated_orders = orders.join(counts.select("order_id"), "order_id", "left_semi")
    hot = hot_keys(counts, ["order_id"], "total", hot_key_rows(spark))
    full = salted_join(lines, repeated_orders, ["order_id"], hot)
    return full.select(*money_out(SALES_COLUMNS)).orderBy("order_id", *ROW_ORDER)


_C14_COLS = ["order_id", "line_number", "product_id", "supplier_id", "order_date", "customer_name",
             "sales"]


@register("c14_extra_lines_per_order", with_sales(f"""
    SELECT {money_out_sql(_C14_COLS)}, CAST(rn AS BIGINT) AS duplicate_rank FROM (
        SELECT *, ROW_NUMBER() OVER (PARTITION BY order_id ORDER BY {", ".join(ROW_ORDER)}) AS rn
        FROM sales) t
    WHERE rn > 1"""), "C14")
def c14(spark, d):
    # ranks on the line-level view (hot orders take the distributed path), then
    # the order columns through a salted join, so a hot order never meets its
    # order row in a single task
    line_cols = [c for c in dict.fromkeys(_C14_COLS + ROW_ORDER) if c in LINE_COLUMNS]
    lines = sales_lines(spark, d, line_cols)
    counts = D.repeated_keys(sales_lines(spark, d, ["order_id"]), ["order_id"])
    hot = hot_keys(counts, ["order_id"], "total", hot_key_rows(spark))
    ranked = D.extra_lines(lines, ["order_id"], ROW_ORDER, hot=hot, counted=True)
    order_cols = [c for c in _C14_COLS if c in ORDER_COLUMNS]
    need = {"orders", "customer"}
    orders = order_dimension(spark, d, need).select("order_id", *order_cols)
    full = salted_join(ranked, orders, ["order_id"], hot)
    return full.select(*money_out(_C14_COLS), "duplicate_rank")


@register("c15_row_count", with_sales("SELECT COUNT(*) AS row_count FROM sales"), "C15")
def c15(spark, d):
    return Q.row_count(sales_lines(spark, d, ["order_id"]))


@register("c16_distinct_order_count", with_sales(
    "SELECT COUNT(DISTINCT order_id) AS unique_orders FROM sales"), "C16")
def c16(spark, d):
    kept = distinct_keys(spark, d, ["order_id"])
    if kept is not None:
        return kept.withColumnRenamed("order_id", "unique_orders")
    return Q.distinct_count(sales_lines(spark, d, ["order_id"]), "order_id", "unique_orders")


@register("c17_rows_vs_orders", with_sales("""
    SELECT COUNT(*) AS total_rows, COUNT(DISTINCT order_id) AS unique_orders,
           COUNT(*) - COUNT(DISTINCT order_id) AS extra_lines FROM sales"""), "C17")
def c17(spark, d):
    return Q.rows_vs_keys(sales_lines(spark, d, ["order_id"]))


@register("c18_duplicate_line_keys", with_sales(f"""
    SELECT {money_out_sql(DUPLICATE_KEYS)}, COUNT(*) AS total FROM sales
    GROUP BY {", ".join(DUPLICATE_KEYS)} HAVING COUNT(*) > 1"""), "C18")
def c18(spark, d):
    found = D.repeated_keys_by_digest(sales_lines(spark, d, DUPLICATE_KEYS), DUPLICATE_KEYS)
    return found.select(*money_out(DUPLICATE_KEYS), "total")


# The tables hold no such lines; on the view united with itself every key repeats.
@register("c18b_duplicate_keys_of_doubled_lines", with_sales(f"""
    SELECT {money_out_sql(DUPLICATE_KEYS)}, COUNT(*) AS total
    FROM (SELECT * FROM sales UNION ALL SELECT * FROM sales) twice
    GROUP BY {", ".join(DUPLICATE_KEYS)} HAVING COUNT(*) > 1"""), "C18")
def c18b(spark, d):
    lines = sales_lines(spark, d, DUPLICATE_KEYS)
    found = D.repeated_keys_by_digest(lines.unionByName(lines), DUPLICATE_KEYS)
    return found.select(*money_out(DUPLICATE_KEYS), "total")


@register("c19_order_product_lookup", with_sales(f"""
    SELECT {money_out_sql(SALES_COLUMNS)} FROM sales
    WHERE order_id = {LOOKUP_ORDER} AND product_id = {LOOKUP_PRODUCT}"""), "C19")
def c19(spark, d):
    s = Q.lookup(sales_lines(spark, d), order_id=LOOKUP_ORDER, product_id=LOOKUP_PRODUCT)
    return s.select(*money_out(SALES_COLUMNS))


# The customer is a property of the order, so the key without it is the same key: lines are
# de-duplicated before the order join, where the partial aggregate folds a hot order's
# duplicates and a join-first plan would put all of its lines in one task.
_LINE_DEDUPE_KEYS = [c for c in DEDUPE_KEYS if c != "customer_id"]


# Profit needs the part join; the digests are counted without it, on a coarser key.
_NARROW_KEYS = [c for c in _LINE_DEDUPE_KEYS if c != "profit"]


def _deduped(spark, d, times=1):
    """Lines (``times`` over) de-duplicated on the seven columns, with their order columns."""
    narrow = sales_lines(spark, d, _NARROW_KEYS, times=times)
    lines = sales_lines(spark, d, LINE_COLUMNS, salt_parts=True, times=times)
    kept = D.dedupe(lines, _LINE_DEDUPE_KEYS, DEDUPE_ORDER, narrow, _NARROW_KEYS)
    return with_order_columns(spark, d, kept)


_DEDUPED_SQL = f"""deduped AS (
        SELECT * EXCLUDE (rn) FROM (
            SELECT *, ROW_NUMBER() OVER (PARTITION BY {", ".join(DEDUPE_KEYS)}
                                         ORDER BY {", ".join(DEDUPE_ORDER)}) AS rn
            FROM sales) t
        WHERE rn = 1)"""


@register("c21_dedupe_lines", with_sales(f"""
    WITH {_DEDUPED_SQL}
    SELECT {money_out_sql(SALES_COLUMNS)} FROM deduped"""), "C21")
def c21(spark, d):
    return _deduped(spark, d).select(*money_out(SALES_COLUMNS))


# Every line doubled has one true duplicate: de-duplicating gives the de-duplicated view
# back, and no key is left twice.
@register("c21b_dedupe_doubled_lines", with_sales(f"""
    WITH {_DEDUPED_SQL}
    SELECT {money_out_sql(SALES_COLUMNS)} FROM deduped"""), "C21")
def c21b(spark, d):
    return _deduped(spark, d, times=2).select(*money_out(SALES_COLUMNS))


@register("c22_no_duplicates_after_dedupe", with_sales(f"""
    WITH {_DEDUPED_SQL}
    SELECT {money_out_sql(DEDUPE_KEYS)}, COUNT(*) AS total FROM deduped
    GROUP BY {", ".join(DEDUPE_KEYS)} HAVING COUNT(*) > 1"""), "C22")
def c22(spark, d):
    need = [c for c in dict.fromkeys([*DEDUPE_KEYS, *DEDUPE_ORDER]) if c in LINE_COLUMNS]
    narrow = sales_lines(spark, d, _NARROW_KEYS, times=2)
    lines = sales_lines(spark, d, need, salt_parts=True, times=2)
    kept = D.dedupe(lines, _LINE_DEDUPE_KEYS, DEDUPE_ORDER, narrow, _NARROW_KEYS)
    left = with_order_columns(spark, d, D.repeated_keys_by_digest(kept, _LINE_DEDUPE_KEYS), ["customer_id"])
    return left.select(*money_out(DEDUPE_KEYS), "total")
