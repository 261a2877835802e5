"""The flat sales-line view over the star-schema test tables.

The analyses work on one flat table of order lines. The test data is a star
schema, so this module joins ``lineitem`` with only those dimensions that the
requested columns need: Catalyst prunes columns but never removes an inner
join, so a query about discounts should not pay for the customer join.

Join plan, chosen for a fact table far larger than any dimension:

* ``region`` and ``nation`` are joined into ``customer``, giving a customer dimension.
* ``orders`` is joined to that customer dimension *before* it meets
  ``lineitem``: the shuffle on ``custkey`` then moves orders rows, not the
  four-times-larger line rows.
* ``lineitem`` joins the order dimension on ``orderkey`` and ``part`` on
  ``partkey``. No side is hinted: the planner broadcasts a dimension whose size in
  bytes is under ``spark.sql.autoBroadcastJoinThreshold``; otherwise it shuffles and
  AQE may still switch to a broadcast or split a skewed key at run time.

Also here: ``sales_by_order`` (lines folded per order before the order join),
``with_order_columns`` (order columns added to rows picked per order), and
``materialize_sales`` / ``read_sales`` (the flat table written once; reports
read it when the session names it in ``spark.ledgerlens.salesTable``).
"""

from __future__ import annotations

import os
from decimal import Decimal

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlens.operators.skew import hot_key_rows, hot_keys, salted_join

# Fixed values of the sales view: the test tables hold discounts
# 0.00..0.10, scaled by 8 so the reference's thresholds (0.2, 0.3, 0.4 ...) bite;
# unit cost is 1.2 x retail price per unit, a made-up figure that gives the data
# losses to analyse.
DISCOUNT_SCALE = 8
UNIT_COST_FACTOR = Decimal("1.2")

# output column -> tables it needs
_NEEDS = {
    "order_id": {"lineitem"},
    "line_number": {"lineitem"},
    "product_id": {"lineitem"},
    "supplier_id": {"lineitem"},
    "ship_date": {"lineitem"},
    "quantity": {"lineitem"},
    "discount": {"lineitem"},
    "list_price": {"lineitem"},
    "sales": {"lineitem"},
    "profit": {"lineitem", "part"},
    "category": {"lineitem", "part"},
    "sub_category": {"lineitem", "part"},
    "product_name": {"lineitem", "part"},
    "order_date": {"lineitem", "orders"},
    "ship_mode": {"lineitem", "orders"},
    "customer_id": {"lineitem", "orders"},
    "customer_name": {"lineitem", "orders", "customer"},
    "segment": {"lineitem", "orders", "customer"},
    "state": {"lineitem", "orders", "customer", "nation"},
    "region": {"lineitem", "orders", "customer", "nation", "region"},
    "country": {"lineitem", "orders", "customer", "nation", "region"},
    "city": {"lineitem", "orders", "customer", "nation"},
    "postal_code": {"lineitem", "orders", "customer"},
}

SALES_COLUMNS = [
    "order_id", "line_number", "product_id", "supplier_id",
    "order_date", "ship_date", "ship_mode",
    "customer_id", "customer_name", "segment", "state", "region",
    "category", "sub_category", "product_name",
    "quantity", "discount", "sales", "profit",
]

# The rest of the address, for the audits: the star has no finer place than the nation,
# so it stands for the city and its region for the country; the postal code is made from
# the customer key (0 for one customer in 500, as the raw export has it).
ADDRESS_COLUMNS = ["country", "city", "postal_code"]
POSTAL_CODES = 500

# The line key: (orderkey, linenumber) repeats in the test tables, and even with
# part and supplier a few lines repeat at the smallest scale.
LINE_KEY = ["order_id", "line_number", "product_id", "supplier_id"]
# Stand-in for the flat table's row id when rows of an order must be ordered:
# every line attribute, so that rows which tie are identical.
ROW_ORDER = ["line_number", "product_id", "supplier_id", "quantity", "discount", "sales",
             "ship_date"]

# Session setting naming a flat table written by ``materialize_sales``; when it
# was built from the same state of the same source folder, reports read it instead
# of the star.
SALES_TABLE_CONF = "spark.ledgerlens.salesTable"
_SOURCE_MARKER = "_ledgerlens_source"
STAR_TABLES = ["region", "nation", "customer", "part", "orders", "lineitem"]


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The table as it is now: nothing is kept between calls, so appended files are read."""
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))


# Session setting: "true" groups, counts and joins text without regard to case, as the
# reference's database does. Off by default: names are then told apart as written.
IGNORE_CASE_CONF = "spark.ledgerlens.ignoreCase"
_NO_CASE = "UTF8_LCASE"


def _one_spelling(spark: SparkSession, df: DataFrame, *cols: str) -> DataFrame:
    """``df`` with one spelling of each name in ``cols`` where the session ignores case: the
    least of those that differ in case only, so the choice does not depend on row order.

    The names are folded on the dimension tables, by a collated key (a few rows to a
    dimension); the lines that join them then group and count by one spelling.
    """
    if spark.conf.get(IGNORE_CASE_CONF, "false").lower() != "true":
        return df
    for c in cols:
        names = df.select(c).distinct().groupBy(F.collate(F.col(c), _NO_CASE).alias("_any")).agg(
            F.min(F.collate(F.col(c), "UTF8_BINARY")).alias("_name"))
        met = df.join(names, F.collate(df[c], _NO_CASE) == names["_any"], "left")
        df = met.select(*[F.col("_name").alias(c) if x == c else df[x] for x in df.columns])
    return df


def _part(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _one_spelling(spark, _table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("product_id"),
        F.col("p_type").alias("category"),
        F.col("p_brand").alias("sub_category"),
        F.col("p_name").alias("product_name"),
        F.col("p_retailprice").cast("decimal(18,2)").alias("_retail"),
    ), "category", "sub_category", "product_name")


def part_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(product_id, product_name), for reports that fold lines per product first."""
    return _part(spark, sf_dir).select("product_id", "product_name")


def part_categories(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(product_id, category)."""
    return _part(spark, sf_dir).select("product_id", "category")


def _net() -> Column:
    return F.col("list_price") * (F.lit(Decimal("1")) - F.col("discount"))


def _profit() -> Column:
    cost = F.lit(UNIT_COST_FACTOR) * F.col("quantity").cast("decimal(10,0)") * F.col("_retail")
    return F.round(_net() - cost, 2).cast("decimal(18,2)")


def sales_lines(spark: SparkSession, sf_dir: str, columns: list[str] | None = None,
                salt_parts: bool = False, times: int = 1) -> DataFrame:
    """Flat sales lines with the requested columns (all when ``None``), ``times`` over: the
    copies are united before the joins, so what follows can use the joins' partitioning.

    ``salt_parts`` is for reports that group by the product afterwards: the grouping
    reuses the part join's partitioning, so AQE cannot split a hot product there. Lines
    per product are then counted first and the lines of hot ones spread over tasks.
    """
    cols = list(columns) if columns else list(SALES_COLUMNS)
    unknown = [c for c in cols if c not in _NEEDS]
    if unknown:
        raise ValueError(f"unknown sales columns: {unknown}")
    flat = _flat_table(spark, sf_dir)
    if flat is not None:
        return _times(flat.select(*cols), times)
    need = set().union(*(_NEEDS[c] for c in cols))

    li = _table(spark, sf_dir, "lineitem")
    disc = (F.col("l_discount").cast("decimal(4,2)") * F.lit(DISCOUNT_SCALE)).cast("decimal(4,2)")
    fact = li.select(
        F.col("l_orderkey").alias("order_id"),
        F.col("l_linenumber").alias("line_number"),
        F.col("l_partkey").alias("product_id"),
        F.col("l_suppkey").alias("supplier_id"),
        F.col("l_shipdate").cast("date").alias("ship_date"),
        F.col("l_quantity").cast("int").alias("quantity"),
        disc.alias("discount"),
        F.col("l_extendedprice").cast("decimal(18,2)").alias("list_price"),
    ).withColumn("sales", F.round(_net(), 2).cast("decimal(18,2)"))
    fact = _times(fact, times)

    if "part" in need:
        hot = None
        if salt_parts:
            counts = li.groupBy(F.col("l_partkey").alias("product_id")).agg(
                (F.count(F.lit(1)) * times).alias("total"))
            hot = hot_keys(counts, ["product_id"], "total", hot_key_rows(spark))
        fact = salted_join(fact, _part(spark, sf_dir), ["product_id"], hot)
        fact = fact.withColumn("profit", _profit())

    if "orders" in need:
        fact = fact.join(order_dimension(spark, sf_dir, need), "order_id")

    return fact.select(*cols)


def _times(df: DataFrame, times: int) -> DataFrame:
    out = df
    for _ in range(times - 1):
        out = out.unionByName(df)
    return out


ORDER_COLUMNS = ["order_date", "ship_mode", "customer_id", "customer_name", "segment", "state",
                 "region"]


def order_dimension(spark: SparkSession, sf_dir: str, need: set[str]) -> DataFrame:
    """One row per order with its order-level columns; customer, nation and
    region are joined only when ``need`` names them."""
    orders = _table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("order_id"),
        F.col("o_orderdate").cast("date").alias("order_date"),
        F.col("o_orderpriority").alias("ship_mode"),
        F.col("o_custkey").alias("customer_id"),
    )
    orders = _one_spelling(spark, orders, "ship_mode")
    if "customer" in need:
        cust = _table(spark, sf_dir, "customer").select(
            F.col("c_custkey").alias("customer_id"),
            F.col("c_name").alias("customer_name"),
            F.col("c_mktsegment").alias("segment"),
            F.col("c_nationkey").alias("_nationkey"),
            (F.col("c_custkey") % POSTAL_CODES).cast("string").alias("postal_code"),
        )
        cust = _one_spelling(spark, cust, "customer_name", "segment")
        if "nation" in need:
            nation = _table(spark, sf_dir, "nation").select(
                F.col("n_nationkey").alias("_nationkey"),
                F.col("n_name").alias("state"),
                F.col("n_name").alias("city"),
                F.col("n_regionkey").alias("_regionkey"),
            )
            nation = _one_spelling(spark, nation, "state", "city")
            if "region" in need:
                region = _table(spark, sf_dir, "region").select(
                    F.col("r_regionkey").alias("_regionkey"),
                    F.col("r_name").alias("region"),
                    F.col("r_name").alias("country"),
                )
                region = _one_spelling(spark, region, "region", "country")
                nation = nation.join(region, "_regionkey")
            cust = cust.join(nation, "_nationkey")
        orders = orders.join(cust, "customer_id")
    return orders


def sales_by_order(spark: SparkSession, sf_dir: str, order_cols: list[str],
                   sums: list[str] = (), mins: list[str] = (), day_sums: list[str] = (),
                   exprs: dict | None = None, expr_cols: list[str] = (),
                   where=None, where_cols: list[str] = ()) -> DataFrame:
    """One row per order: ``order_cols`` plus totals over the order's lines.

    For reports that group by order-level columns only. Lines are folded per
    order *before* they meet the order dimension (eager aggregation): the
    partial aggregate runs on every executor, the shuffle on ``order_id``
    carries narrow pre-summed rows instead of every line, and the join reuses
    that partitioning. Output per order: each ``sums`` column summed under
    its own name, ``<col>_n`` (its non-null line count), each ``mins`` column
    as ``<col>_min``, each ``day_sums`` date column as ``<col>_days`` (sum of
    its day numbers) with ``<col>_n``, each named line expression of ``exprs``
    summed (with ``<name>_n``; ``expr_cols`` names the columns they read), and
    ``n_lines``. DECIMAL sums keep every total exact, so results equal the
    line-level computation. ``where`` filters lines first; ``where_cols``
    names the line columns it reads.
    """
    bad = [c for c in order_cols if c not in ORDER_COLUMNS]
    if bad:
        raise ValueError(f"not order-level columns: {bad}")
    line_cols = list(dict.fromkeys(["order_id", *sums, *mins, *day_sums]))
    lines = sales_lines(spark, sf_dir,
                        list(dict.fromkeys(line_cols + list(where_cols) + list(expr_cols))))
    if where is not None:
        lines = lines.where(where)
    aggs = []
    for c in sums:
        aggs += [F.sum(c).alias(c), F.count(c).alias(f"{c}_n")]
    aggs += [F.min(c).alias(f"{c}_min") for c in mins]
    for c in day_sums:
        aggs += [F.sum(F.unix_date(c)).alias(f"{c}_days"), F.count(c).alias(f"{c}_n")]
    for name, e in (exprs or {}).items():
        aggs += [F.sum(e).alias(name), F.count(e).alias(f"{name}_n")]
    aggs.append(F.count(F.lit(1)).alias("n_lines"))
    if order_cols and _flat_table(spark, sf_dir) is not None:
        # the flat table already carries the order columns: one aggregation, no join
        return (sales_lines(spark, sf_dir, list(dict.fromkeys(
            line_cols + list(where_cols) + list(expr_cols) + list(order_cols))))
            .where(where if where is not None else F.lit(True))
            .groupBy("order_id", *order_cols).agg(*aggs))
    per_order = lines.groupBy("order_id").agg(*aggs)
    need = set().union(*(_NEEDS[c] for c in order_cols)) if order_cols else set()
    if not order_cols:
        return per_order
    dims = order_dimension(spark, sf_dir, need).select("order_id", *order_cols)
    return per_order.join(dims, "order_id")


def order_cells(spark: SparkSession, sf_dir: str, order_cols: list[str], sums: list[str] = (),
                day_sums: list[str] = (), where=None, where_cols: list[str] = ()) -> DataFrame:
    """``sales_by_order`` for reports that go on adding up by ``order_cols``, with
    ``order_date`` needed to the month only: the cells of a stored lattice where the session
    names a current one (``sources.lattice``), else the folded orders."""
    from ledgerlens.sources.lattice import cells
    # a condition on lines reads the columns that are summed
    used = [*where_cols, *[c for c in sums if where is not None and c != "sales"]]
    found = cells(spark, sf_dir, list(order_cols), list(sums), where, used, days=bool(day_sums))
    if found is not None:
        return found
    return sales_by_order(spark, sf_dir, order_cols, sums, day_sums=day_sums, where=where,
                          where_cols=where_cols)


def sales_cells(spark: SparkSession, sf_dir: str, dims: list[str], sums: list[str] = ()) -> DataFrame:
    """Lines for reports that only add up: ``dims``, ``sums`` with their ``_n`` (1 where not
    null) and ``n_lines`` (1), or the same columns of a stored lattice's cells. Read them
    with the folded metrics; a condition ``profit < 0`` holds for losing lines in both."""
    from ledgerlens.sources.lattice import cells
    found = cells(spark, sf_dir, list(dims), list(sums))
    if found is not None:
        return found
    lines = sales_lines(spark, sf_dir, list(dict.fromkeys([*dims, *sums])))
    counts = [F.col(c).isNotNull().cast("long").alias(f"{c}_n") for c in sums]
    return lines.select(*lines.columns, *counts, F.lit(1).cast("long").alias("n_lines"))


LINE_COLUMNS = [c for c in SALES_COLUMNS if c not in ORDER_COLUMNS]


def with_order_columns(spark: SparkSession, sf_dir: str, lines: DataFrame,
                       cols: list[str] | None = None) -> DataFrame:
    """Add order-level columns to line-level rows (those keep ``order_id``).

    For "pick, then enrich" plans: rows chosen per order on the line-level
    view get their order, customer and region columns afterwards, so the
    order join sees only the surviving rows. Exact, because that inner join
    keeps or drops whole orders, never single lines.
    """
    cols = list(cols) if cols is not None else list(ORDER_COLUMNS)
    need = set().union(*(_NEEDS[c] for c in cols)) if cols else set()
    dims = order_dimension(spark, sf_dir, need).select("order_id", *cols)
    return lines.join(dims, "order_id")


def source_state(spark: SparkSession, sf_dir: str) -> str:
    """The files of the star tables as one line of text: folder, number of files, bytes and
    a hash over their names, sizes and times. A changed or appended file changes it."""
    files = None
    for t in STAR_TABLES:
        listed = (spark.read.format("binaryFile").option("recursiveFileLookup", "true")
                  .load(os.path.join(sf_dir, f"{t}.parquet"))
                  .select("path", "length", F.unix_millis("modificationTime").alias("ms")))
        files = listed if files is None else files.unionByName(listed)
    n, size, mark = files.agg(F.count(F.lit(1)), F.sum("length"),
                              F.bit_xor(F.xxhash64("path", "length", "ms"))).first()
    return f"{os.path.normpath(sf_dir)} {n} {size} {mark}"


PART_COLUMNS = ["category", "sub_category", "product_name", "profit"]
# what a line has without any join (``list_price`` lets its profit be computed later)
LINEITEM_COLUMNS = [c for c in LINE_COLUMNS if c not in PART_COLUMNS]


def with_part_columns(spark: SparkSession, sf_dir: str, lines: DataFrame) -> DataFrame:
    """Add category, sub-category, product name and profit to lines that have
    ``LINEITEM_COLUMNS`` and ``list_price``; for rows picked without them."""
    return lines.join(_part(spark, sf_dir), "product_id").withColumn("profit", _profit()).drop(
        "_retail", "list_price")


# Columns that single lines are looked up by, and the size of the row groups they are found in.
LOOKUP_COLUMNS = ["order_id", "product_id"]
LOOKUP_GROUP_BYTES = 16 << 20


def materialize_sales(spark: SparkSession, sf_dir: str, path: str, mode: str = "errorifexists",
                      row_group_bytes: int = LOOKUP_GROUP_BYTES) -> None:
    """Write the whole flat sales view once, partitioned by order year.

    For repeated reporting on very large tables: one pass pays for the star
    joins, and every later report scans the flat table with column pruning,
    while filters on ``order_date`` prune whole year folders. Rows are
    clustered by order inside each year, so order-grain folds combine early.

    The table is its own lookup index: row groups are small and hold neighbouring orders,
    so an order id is found by their least and greatest values, and Bloom filters on
    ``LOOKUP_COLUMNS`` skip the groups that do not hold an id between them or a product.
    """
    state = source_state(spark, sf_dir)  # before the read: later files make it stale
    flat = sales_lines(spark, sf_dir, [*SALES_COLUMNS, *ADDRESS_COLUMNS, "list_price"]).withColumn("order_year", F.year("order_date"))
    # range partitions hold contiguous (year, order) ranges, so each task writes
    # into one or two year folders instead of all of them (few, large files)
    writer = flat.repartitionByRange("order_year", "order_id").sortWithinPartitions("order_id").write.mode(mode)
    for c in LOOKUP_COLUMNS:
        writer = writer.option(f"parquet.bloom.filter.enabled#{c}", True)
    writer.option("parquet.block.size", row_group_bytes).partitionBy("order_year").parquet(path)
    # which state of the star it was built from (files starting with '_' are not data)
    spark.createDataFrame([(state,)], "source string").coalesce(1).write.mode(
        "overwrite").text(os.path.join(path, _SOURCE_MARKER))


def _flat_table(spark: SparkSession, sf_dir: str) -> DataFrame | None:
    """The configured flat table, if it was materialized from ``sf_dir`` as it is now."""
    path = spark.conf.get(SALES_TABLE_CONF, None)
    if not path:
        return None
    marker = spark.read.text(os.path.join(path, _SOURCE_MARKER)).first()
    if marker is None or not marker[0].startswith(f"{os.path.normpath(sf_dir)} ") or \
            marker[0] != source_state(spark, sf_dir):
        return None
    return read_sales(spark, path)


def read_sales(spark: SparkSession, path: str) -> DataFrame:
    """The materialized flat table, in the column order of ``sales_lines``."""
    return spark.read.parquet(path).select(*SALES_COLUMNS, *ADDRESS_COLUMNS, "list_price", "order_year")
