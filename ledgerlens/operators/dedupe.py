"""Repeated keys, exact duplicates and de-duplication."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from ledgerlens.functions import metrics as M
from ledgerlens.functions.sizing import broadcast_if_bounded
from ledgerlens.operators.ranking import first_per_group, rank_within_groups
from ledgerlens.operators.skew import BROADCAST_KEYS
from ledgerlens.session import stored


def repeated_keys(df: DataFrame, keys: list[str], name: str = "total") -> DataFrame:
    """Key values with more than one row, and their row count.

    Counted with a partial aggregate on every executor first, so a hot key
    costs one row per partition in the shuffle.
    """
    return df.groupBy(*keys).agg(M.rows().alias(name)).where(F.col(name) > 1)


def rows_of_repeated_keys(df: DataFrame, keys: list[str]) -> DataFrame:
    """Every row whose key occurs more than once (C13): a left-semi join.

    The key list is derived data: counting it up front would run the whole
    aggregation twice. Both sides shuffle on the key instead; AQE turns the
    join into a broadcast when the measured key list is small and splits a
    skewed key's partition when it is not. The key side's aggregate is
    already partitioned on the key, so it is not shuffled again.
    """
    dup = repeated_keys(df, keys).select(*keys)
    return df.join(dup, keys, "left_semi")


def extra_lines(df: DataFrame, keys: list[str], order: list[str | Column],
                name: str = "duplicate_rank", **hot) -> DataFrame:
    """Rows numbered inside each key by ``order``; the second and later kept (C14).

    The numbering is a distributed sort (see ``rank_within_groups``), so an
    order with a third of all lines is not numbered in a single task. ``hot`` passes
    on the hot keys of a caller that has counted them.
    """
    ranked = rank_within_groups(df, keys, order, name, **hot)
    return ranked.where(F.col(name) > 1)


Digest = Callable[[list[str]], list[Column]]
_MARKS = ["_d1", "_d2"]


def line_digest(keys: list[str]) -> list[Column]:
    """128 bits of a row's key columns, as two numbers."""
    return [F.xxhash64(*keys), F.xxhash64(F.lit(1), *keys)]


def suspects(df: DataFrame, keys: list[str], digest: Digest = line_digest) -> DataFrame | None:
    """The digests of ``keys`` that more than one row has, stored; ``None`` if there are none.

    The first step of a duplicate search: two numbers per row are counted, partial on
    every executor. Equal keys have equal digests, so a row whose digest is not listed is
    no duplicate; of the others the key columns decide.
    """
    marks = [c.alias(m) for c, m in zip(digest(keys), _MARKS)]
    again = stored(df.select(*marks).groupBy(*_MARKS).agg(M.rows().alias("_n")).where("_n > 1").select(*_MARKS))
    return None if again.isEmpty() else again


def _split(df: DataFrame, again: DataFrame, keys: list[str], digest: Digest) -> tuple[DataFrame, DataFrame]:
    """(rows whose digest is not in ``again``, rows whose digest is)."""
    marked = df.withColumns(dict(zip(_MARKS, digest(keys))))
    side = broadcast_if_bounded(again, BROADCAST_KEYS)
    return (marked.join(side, _MARKS, "left_anti").drop(*_MARKS),
            marked.join(side, _MARKS, "left_semi").drop(*_MARKS))


def repeated_keys_by_digest(df: DataFrame, keys: list[str], name: str = "total",
                            digest: Digest = line_digest) -> DataFrame:
    """``repeated_keys``, digests first: only rows of a repeated digest carry their keys
    into the count (C18, C22)."""
    again = suspects(df, keys, digest)
    if again is None:
        return repeated_keys(df.limit(0), keys, name)
    return repeated_keys(_split(df, again, keys, digest)[1].select(*keys), keys, name)


# Above this share of copies (estimated), digests would list most rows and save nothing.
MANY_COPIES = 0.2


def _many_copies(df: DataFrame, keys: list[str]) -> bool:
    """Whether a large share of ``df`` repeats its ``keys``: one scan, a sketch to a task. Only
    chooses the plan; both give the same rows."""
    n, different = df.agg(M.rows(), F.approx_count_distinct(F.xxhash64(*keys), 0.02)).first()
    return different < (1 - MANY_COPIES) * n


def _first_rows(df: DataFrame, keys: list[str], order: list[str | Column]) -> DataFrame:
    """``first_per_group`` with the order columns held once where they are plain names, as the
    least of (order, other columns): half the bytes in the shuffle."""
    rest = [c for c in df.columns if c not in keys]
    sortable = not any(t in df.schema[c].dataType.simpleString() for c in rest for t in ("map<", "variant", "interval"))
    if not sortable or not all(isinstance(c, str) and c in rest for c in order):
        return first_per_group(df, keys, order)
    held = list(dict.fromkeys([*order, *rest]))
    least = df.groupBy(*keys).agg(F.min(F.struct(*held)).alias("_best"))
    return least.select(*[F.col(c) if c in keys else F.col("_best").getField(c).alias(c) for c in df.columns])


def dedupe(df: DataFrame, keys: list[str], order: list[str | Column], narrow: DataFrame | None = None,
           narrow_keys: list[str] | None = None, digest: Digest = line_digest) -> DataFrame:
    """Keep one row per ``keys`` value: the first under ``order``.

    ``order`` must end in a unique column, so the surviving row is defined
    (``dropDuplicates`` keeps an arbitrary one). Digests are counted first; rows of a
    single digest pass without a shuffle, the others meet in an aggregate, partial on
    every executor, so a heavily duplicated key is folded early. Where many rows are
    copies, all rows go to that aggregate at once: most would be listed, and moved twice.

    ``narrow`` may give the same rows with fewer columns for the count, and
    ``narrow_keys`` those of ``keys`` that it has: a coarser key only adds suspects.
    """
    cols = narrow_keys or keys
    counted = df if narrow is None else narrow
    if _many_copies(counted, cols):
        return _first_rows(df, keys, order)
    again = suspects(counted, cols, digest)
    if again is None:
        return df
    single, rest = _split(df, again, cols, digest)
    return single.unionByName(_first_rows(rest, keys, order))


def assert_no_duplicates(df: DataFrame, keys: list[str]) -> None:
    """Raise if any key value still has more than one row (C22 as a check)."""
    left = repeated_keys(df, keys).limit(1).count()
    if left:
        raise AssertionError(f"duplicate rows remain on {keys}")


def audited_snapshot(df: DataFrame, path: str, counters: dict[str, Column], mode: str = "errorifexists"
                     ) -> tuple[DataFrame, DataFrame]:
    """``snapshot`` and one row of ``counters`` (plain aggregates) over the rows it wrote.

    The counters are observed in the job that writes the copy: no other scan. Spark
    takes a task's counts only when the task succeeds, so retries do not count twice.
    """
    seen = Observation()
    df.observe(seen, *[c.alias(name) for name, c in counters.items()]).write.mode(mode).parquet(path)
    row = df.sparkSession.createDataFrame([tuple(seen.get[n] for n in counters)], [*counters])
    return df.sparkSession.read.parquet(path), row


def snapshot(df: DataFrame, path: str, mode: str = "errorifexists") -> DataFrame:
    """Write a copy before a destructive step and return it read back (C20).

    Never overwrites by default: a second snapshot to the same place fails.
    """
    df.write.mode(mode).parquet(path)
    return df.sparkSession.read.parquet(path)
