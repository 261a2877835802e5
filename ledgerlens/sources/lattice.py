"""A stored lattice of sums: many reports from a few small tables.

Some thirty breakdowns group the same lines by a few columns and add up the same
measures. ``build_lattice`` folds the lines once to the finest cells (all of
``DIMENSIONS``) and stores them; coarser nodes are folded from the smallest stored node
that contains them, never from the lines, and are kept only if they have at most half
of its rows. ``cells`` then answers a report from the smallest node that holds its
dimensions.

A cell holds, for each measure, the sum under the measure's own name and the number of
non-null lines under ``<measure>_n``, and ``n_lines``: the layout of
``star.sales_by_order``, so reports read cells and folded orders with the same
expressions. Two devices keep line-level conditions and dates exact:

* every node also splits lines by the sign of their profit (``loss``), so a condition
  ``profit < 0`` on cells selects exactly the losing lines;
* ``order_date`` is the first day of the month, and ``ship_date_days`` is shifted with it,
  so years, quarters, months and shipping days come out as from the lines.

The lattice names the state of the files it was built from; when a file is added or
changed it is not used (the reports scan the lines again) until it is rebuilt. Distinct
keys are kept beside the sums as bitmaps, which merge over any dimension
(``functions.distinct``).
"""

from __future__ import annotations

import json
import os

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlens.functions.distinct import key_bitmaps, merged_count

# Session setting naming a folder written by ``build_lattice``.
LATTICE_CONF = "spark.ledgerlens.salesLattice"
_MANIFEST = "_lattice"

DIMENSIONS = ["region", "segment", "ship_mode", "category", "sub_category", "discount", "order_date"]
MEASURES = ["sales", "profit", "quantity"]
# Distinct keys, and the dimensions they can be counted by.
KEYS = ["order_id", "product_id", "customer_id"]
KEY_DIMENSIONS = ["region", "segment"]
# What the reports group and filter by: candidates for stored nodes.
REPORTS = [
    ["region", "category", "sub_category", "discount"], ["category", "sub_category", "discount"],
    ["region", "category"], ["region", "sub_category"], ["category"], ["sub_category"],
    ["region", "segment", "ship_mode", "discount"], ["region", "discount"], ["segment", "discount"],
    ["ship_mode", "order_date"], ["order_date"], ["discount"],
]


def _cell_columns(dims: list[str]) -> list[str]:
    return [*dims, "loss", *[x for m in MEASURES for x in (m, f"{m}_n")], "ship_date_days", "ship_date_n", "n_lines"]


def _finest(lines: DataFrame) -> DataFrame:
    month = F.trunc("order_date", "month")
    days = F.datediff("ship_date", "order_date") + F.when(F.col("ship_date").isNotNull(), F.unix_date(month))
    aggs = [x for m in MEASURES for x in (F.sum(m).alias(m), F.count(m).alias(f"{m}_n"))]
    keys = [month.alias("order_date") if c == "order_date" else F.col(c) for c in DIMENSIONS]
    return lines.withColumn("_days", days).groupBy(
        *keys, F.coalesce(F.col("profit") < 0, F.lit(False)).alias("loss")).agg(
        *aggs, F.sum("_days").cast("long").alias("ship_date_days"), F.count("_days").alias("ship_date_n"),
        F.count(F.lit(1)).alias("n_lines")).select(*_cell_columns(DIMENSIONS))


def _fold(node: DataFrame, dims: list[str]) -> DataFrame:
    sums = [c for c in _cell_columns([]) if c != "loss"]
    types = dict(node.dtypes)
    return node.groupBy(*dims, "loss").agg(*[F.sum(c).cast(types[c]).alias(c) for c in sums])


def build_lattice(spark: SparkSession, sf_dir: str, path: str) -> list[tuple[list[str], int]]:
    """Write the lattice of the star tables in ``sf_dir`` to ``path``; (dimensions, rows) of
    its nodes, the finest first. ``path`` must not exist."""
    from ledgerlens.sources.star import sales_lines, source_state
    state = source_state(spark, sf_dir)  # before the read: later files make it stale
    lines = sales_lines(spark, sf_dir, [*DIMENSIONS, *MEASURES, "ship_date"])
    nodes: list[dict] = []

    def store(df: DataFrame, dims: list[str]) -> dict:
        at = os.path.join(path, f"node={len(nodes)}")
        df.write.parquet(at)
        return {"dims": dims, "path": at, "rows": spark.read.parquet(at).count()}

    nodes.append(store(_finest(lines), DIMENSIONS))
    for dims in sorted(REPORTS, key=len, reverse=True):
        parent = _smallest(nodes, set(dims))
        folded = _fold(spark.read.parquet(parent["path"]), dims)
        if folded.count() * 2 <= parent["rows"]:
            nodes.append(store(folded, dims))
    keys_at = os.path.join(path, "keys")
    key_bitmaps(sales_lines(spark, sf_dir, [*KEYS, *KEY_DIMENSIONS, "profit"]).withColumn(
        "loss", F.coalesce(F.col("profit") < 0, F.lit(False))), KEYS, [*KEY_DIMENSIONS, "loss"]).write.parquet(keys_at)
    manifest = json.dumps({"state": state, "nodes": nodes, "keys": keys_at})
    spark.createDataFrame([(manifest,)], "m string").coalesce(1).write.text(os.path.join(path, _MANIFEST))
    return [(n["dims"], n["rows"]) for n in nodes]


def _smallest(nodes: list[dict], need: set[str]) -> dict:
    return min((n for n in nodes if need <= set(n["dims"])), key=lambda n: n["rows"])


def _current(spark: SparkSession, sf_dir: str) -> dict | None:
    """The configured lattice, if it was built from ``sf_dir`` as it is now."""
    from ledgerlens.sources.star import source_state
    path = spark.conf.get(LATTICE_CONF, None)
    if not path:
        return None
    manifest = json.loads(spark.read.text(os.path.join(path, _MANIFEST)).first()[0])
    return manifest if manifest["state"] == source_state(spark, sf_dir) else None


def cells(spark: SparkSession, sf_dir: str, dims: list[str], sums: list[str] = (),
          where: Column | None = None, where_cols: list[str] = (), days: bool = False) -> DataFrame | None:
    """``dims`` with ``sums``, their ``_n`` and ``n_lines`` from the smallest node that has the
    dimensions, or ``None`` if no current lattice holds them.

    ``where`` may use the dimensions, those in ``where_cols``, and the sign of ``profit``.
    ``discount`` can be summed as well as grouped by. ``days`` adds the ``ship_date`` columns.
    """
    need = {*dims, *where_cols} - {"profit"} | ({"discount"} & set(sums))
    if not need <= set(DIMENSIONS) or not set(sums) <= {*MEASURES, "discount"}:
        return None
    lattice = _current(spark, sf_dir)
    if lattice is None:
        return None
    node = spark.read.parquet(_smallest(lattice["nodes"], need)["path"])
    if where is not None:
        node = node.where(where)
    out = [F.col(c) for c in dims]
    for c in sums:
        if c != "discount":
            out += [F.col(c), F.col(f"{c}_n")]
            continue
        if "discount" not in dims:
            out.append((F.col(c) * F.col("n_lines")).alias(c))
        out.append(F.when(F.col(c).isNotNull(), F.col("n_lines")).otherwise(F.lit(0)).alias("discount_n"))
    if days:
        out += [F.col("ship_date_days"), F.col("ship_date_n")]
    return node.select(*out, "n_lines")


def distinct_keys(spark: SparkSession, sf_dir: str, keys: list[str], dims: list[str] = (),
                  losing: bool = False) -> DataFrame | None:
    """``dims`` and the number of distinct values of each key, from the stored bitmaps;
    ``None`` without a current lattice. ``losing`` counts those of losing lines only."""
    lattice = _current(spark, sf_dir)
    if lattice is None or not set(keys) <= set(KEYS) or not set(dims) <= set(KEY_DIMENSIONS):
        return None
    maps = spark.read.parquet(lattice["keys"])
    return merged_count(maps.where("loss") if losing else maps, keys, list(dims))
