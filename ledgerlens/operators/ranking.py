"""Ranking without funnelling rows into one task.

Spark runs a window with no PARTITION BY in a single task, and a window
partitioned by a hot key in one task per key. Both are fine on a handful of
aggregated rows and wrong on sale lines or on millions of customers. This
module gives the ranks the reports need in forms that spread the work:

* ``first_per_group`` - the best row of each group (ROW_NUMBER() = 1) as a
  ``min_by`` aggregate: partial aggregation on every executor before the
  shuffle, so a group holding a third of all rows costs no more than others.
* ``global_positions`` - the 0-based position of every row in a total order
  (global ROW_NUMBER() - 1): a range-partitioned sort, a per-partition row
  index, and an offset per partition from a table with one row per partition.
* ``ntile`` / ``dense_rank_desc`` / ``rank_within_groups`` - built on it.
* ``top_per_group`` - rank window over an *aggregated* input (a few rows per
  group), with an optional tie-keeping dense rank.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerlens.functions.sizing import broadcast_if_bounded
from ledgerlens.session import stored

_LOW_BITS = 33  # monotonically_increasing_id: partition index << 33 | row index


def _cols(xs) -> list[Column]:
    return [F.col(x) if isinstance(x, str) else x for x in xs]


def desc_key(df: DataFrame, name: str) -> Column:
    """A key that sorts ascending in the descending order of ``name``: numbers are
    negated, dates turned into negative day numbers. Text has no such key; pick it with
    ``highest_per_group``."""
    dtype = dict(df.dtypes)[name]
    if dtype == "date":
        return -F.unix_date(F.col(name))
    if dtype == "string":
        raise TypeError(f"no descending key for text column {name}")
    return -F.col(name)


def first_per_group(df: DataFrame, keys: list[str], order: list[Column | str],
                    rank_col: str | None = None) -> DataFrame:
    """The first row of each ``keys`` group under ``order`` (all columns kept).

    ``order`` must end in a unique tie-break so the pick is repeatable.
    """
    rest = [c for c in df.columns if c not in keys]
    order_cols = _cols(order)
    picked = df.groupBy(*keys).agg(
        F.min_by(F.struct(*[F.col(c) for c in rest]), F.struct(*order_cols)).alias("_best"))
    out = picked.select(*keys, *[F.col("_best").getField(c).alias(c) for c in rest])
    out = out.select(*df.columns)
    if rank_col:
        out = out.withColumn(rank_col, F.lit(1).cast("long"))
    return out


def highest_per_group(df: DataFrame, keys: list[str], by: str, order: list[Column | str]
                      ) -> DataFrame:
    """The row with the highest ``by`` of each group, of any type; ties by ``order``.

    The highest value is a plain MAX (partial on every executor). It is joined back to
    the rows, and only the rows that hold it are ordered.
    """
    top = df.groupBy(*keys).agg(F.max(by).alias("_top"))
    same = [df[k].eqNullSafe(top[k]) for k in keys]
    held = df.join(top, [*same, df[by].eqNullSafe(top["_top"])], "left_semi")
    return first_per_group(held, keys, order)


def _positioned(df: DataFrame, order: list[Column | str], partitions: int | None):
    """Rows with ``_pid`` (partition after the range sort), ``_pos`` and ``_total``."""
    order_cols = _cols(order)
    # with AQE the range partitioner samples its bounds from the materialized
    # output of the stage before, so the input is not computed twice; without
    # an explicit count AQE may merge neighbouring ranges into fewer, larger
    # partitions (still contiguous, and sorted again below)
    ranged = (df.repartitionByRange(partitions, *order_cols) if partitions
              else df.repartitionByRange(*order_cols))
    tagged = stored(ranged.sortWithinPartitions(*order_cols)
                    .withColumn("_mid", F.monotonically_increasing_id()))
    tagged = tagged.withColumn("_pid", F.shiftrightunsigned(F.col("_mid"), _LOW_BITS))
    tagged = tagged.withColumn(
        "_local", F.col("_mid") - F.shiftleft(F.col("_pid"), _LOW_BITS))
    counts = tagged.groupBy("_pid").agg(F.count(F.lit(1)).alias("_n"))
    # one row per partition: a single-task window here is bounded by n
    w = Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(
        "_pid",
        F.coalesce(F.sum("_n").over(w), F.lit(0)).alias("_offset"),
        F.sum("_n").over(Window.partitionBy()).alias("_total"),
    )
    # at most one row per partition: bounded by construction, so broadcast it
    out = tagged.join(F.broadcast(offsets), "_pid")
    return out.withColumn("_pos", F.col("_offset") + F.col("_local")).drop(
        "_mid", "_local", "_offset")


def global_positions(df: DataFrame, order: list[Column | str], pos_col: str = "_pos",
                     total_col: str | None = None, partitions: int | None = None) -> DataFrame:
    """Add the 0-based position of each row in ``order`` (a total order).

    1. range-partition on the full sort key (Spark samples the bounds, so ties
       on a leading column are split by the later ones) and sort inside each
       partition;
    2. tag rows with ``monotonically_increasing_id`` (partition index in the
       high bits, row index in the low bits) and store them in the shared scratch
       folder, so the numbering is fixed even if a task is re-run;
    3. count rows per partition (one row per partition), turn the counts into
       offsets and broadcast them: the table is bounded by the partition count.
    """
    out = _positioned(df, order, partitions)
    keep = list(df.columns)
    out = out.withColumnRenamed("_pos", pos_col) if pos_col != "_pos" else out
    keep.append(pos_col)
    if total_col:
        out = out.withColumnRenamed("_total", total_col)
        keep.append(total_col)
    return out.select(*keep)


def tile_of(pos: Column, total: Column, tiles: int) -> Column:
    """NTILE bucket (1-based) of 0-based position ``pos`` among ``total`` rows.

    As SQL NTILE: the first ``total mod tiles`` buckets get one extra row.
    """
    b = F.floor(total / tiles)
    e = total - b * tiles
    big = e * (b + 1)
    return F.when(pos < big, F.floor(pos / (b + 1)) + 1).otherwise(
        e + F.floor((pos - big) / F.greatest(b, F.lit(1))) + 1).cast("long")


def ntile(df: DataFrame, tiles: int, order: list[Column | str], name: str) -> DataFrame:
    """NTILE(tiles) OVER (ORDER BY order) without a single-task window."""
    pos = global_positions(df, order, "_p", "_N")
    return pos.withColumn(name, tile_of(F.col("_p"), F.col("_N"), tiles)).drop("_p", "_N")


def ntile_many(df: DataFrame, tiles: int, key: list[str],
               orders: dict[str, tuple[str, bool]]) -> DataFrame:
    """Several NTILE columns from one distributed sort.

    ``orders`` maps an output name to (numeric column, ascending); ``key`` is
    unique per row and breaks ties (ascending). The sort keys are stacked into
    one long table tagged by their place in ``orders`` - one row per input row
    and ordering - so a single range sort numbers them all; the position
    within an ordering is the global position minus (place x row count).
    Folding the tagged positions back per ``key`` restores one row per input
    (a shuffle of k rows per input row; no key is hot, it is unique).
    Same results as one ``ntile`` per column, with one sort instead of several.
    """
    names = list(orders)
    stacked = F.array(*[
        F.struct(F.lit(i).alias("m"),
                 (F.col(col) if asc else -F.col(col)).cast("decimal(38,6)").alias("v"))
        for i, (col, asc) in enumerate(orders[n] for n in names)])
    # the other columns ride along (identical on the rows of one input row), so
    # the input is not computed a second time for a join back
    others = [c for c in df.columns if c not in key]
    long = df.select(*df.columns, F.inline(stacked))
    pos = global_positions(long, ["m", "v", *key], "_p", "_N")
    per_row = pos.groupBy(*key).agg(
        *[F.first(c).alias(c) for c in others],
        *[F.max(F.when(F.col("m") == i,
                       F.col("_p") - i * (F.col("_N") / len(names)).cast("long")))
          .alias(f"_p{i}") for i in range(len(names))],
        F.max((F.col("_N") / len(names)).cast("long")).alias("_n"))
    out = per_row
    for i, n in enumerate(names):
        out = out.withColumn(n, tile_of(F.col(f"_p{i}"), F.col("_n"), tiles))
    return out.select(*df.columns, *names)


def dense_rank_desc(df: DataFrame, value: str, name: str) -> DataFrame:
    """DENSE_RANK() OVER (ORDER BY value DESC): rank the distinct values, join back.

    ``df`` is stored, since the ranks and the join both read it; AQE broadcasts
    the ranks when their measured size is small.
    """
    df = stored(df)
    distinct = df.select(value).distinct()
    ranked = global_positions(distinct, [F.col(value).desc()], "_p").select(
        value, (F.col("_p") + 1).cast("long").alias(name))
    return df.join(ranked, value)


def rank_within_groups(df: DataFrame, keys: list[str], order: list[Column | str],
                       name: str, hot_rows: int | None = None,
                       partitions: int | None = None, hot: DataFrame | None = None,
                       counted: bool = False) -> DataFrame:
    """ROW_NUMBER() OVER (PARTITION BY keys ORDER BY order), safe for hot keys.

    Keys are counted first (a partial aggregate). Keys with at most
    ``hot_rows`` rows (default: the session's hot-key setting, 1M) are
    numbered by an ordinary window - one task per key
    holds a bounded number of rows. Rows of hotter keys (their list stays a
    DataFrame, of any length) are numbered from
    one global sort: a key's first position is found per (sorted partition,
    key) and joined back on that pair, so a hot key spread over many
    partitions is handled piecewise and never gathered into one task.

    A caller that has counted the keys passes ``counted=True`` and the list of
    hot keys (or ``None``) from ``skew.hot_keys``.
    """
    from ledgerlens.operators.skew import BROADCAST_KEYS, hot_key_rows, hot_keys
    if not counted:
        if hot_rows is None:
            hot_rows = hot_key_rows(df.sparkSession)
        hot = hot_keys(df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")), keys, "_n", hot_rows)
    order_cols = _cols(order)
    w = Window.partitionBy(*keys).orderBy(*order_cols)
    if hot is None:
        return df.withColumn(name, F.row_number().over(w).cast("long"))
    hot_list = broadcast_if_bounded(hot.select(*keys), BROADCAST_KEYS)
    cold = df.join(hot_list, keys, "left_anti").withColumn(
        name, F.row_number().over(w).cast("long"))
    pos = _positioned(df.join(hot_list, keys, "left_semi"), [*_cols(keys), *order_cols],
                      partitions)
    per_part = pos.groupBy("_pid", *keys).agg(F.min("_pos").alias("_first_p"))
    first = per_part.groupBy(*keys).agg(F.min("_first_p").alias("_first"))
    bounds = per_part.join(first, keys).select("_pid", *keys, "_first")
    warm = pos.join(bounds, ["_pid", *keys]).select(
        *df.columns, (F.col("_pos") - F.col("_first") + 1).cast("long").alias(name))
    return cold.select(*df.columns, name).unionByName(warm)


def top_per_group(agg: DataFrame, group: list[str], order: list[Column | str], n: int = 1,
                  ties: bool = False, rank_col: str | None = None) -> DataFrame:
    """Rows ranked <= n inside each group of an aggregated input.

    ``ties=True`` keeps ties (DENSE_RANK); otherwise ROW_NUMBER, which needs a
    unique tie-break at the end of ``order``. The filter on the rank becomes a
    WindowGroupLimit, which trims each partition before the shuffle.
    """
    w = Window.partitionBy(*group).orderBy(*_cols(order))
    fn = F.dense_rank() if ties else F.row_number()
    rc = rank_col or "_rank"
    out = agg.withColumn(rc, fn.over(w).cast("long")).where(F.col(rc) <= n)
    return out if rank_col else out.drop(rc)
