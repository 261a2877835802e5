"""Group-by reports: measures by any dimension, with HAVING, order and top-k."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def breakdown(df: DataFrame, dims: Sequence[str | Column], metrics: Sequence[Column],
              where: Column | None = None, having: Column | None = None,
              order: Sequence[str | Column] = (), limit: int | None = None) -> DataFrame:
    """WHERE -> GROUP BY dims -> metrics -> HAVING -> ORDER BY -> LIMIT.

    ``having`` sees the metric aliases, so a rounded alias is tested after
    rounding, as the reference's HAVING on an alias does. ``order`` should end
    in the dimensions so that a LIMIT picks the same rows on every run; with
    a limit Spark plans TakeOrderedAndProject (top-k per partition, then merge).
    """
    src = df.where(where) if where is not None else df
    out = src.groupBy(*[_c(d) for d in dims]).agg(*metrics)
    if having is not None:
        out = out.where(having)
    if order:
        out = out.orderBy(*[_c(o) for o in order])
    if limit is not None:
        out = out.limit(limit)
    return out


def top1(df: DataFrame, dim: str | Column, metric: Column, name: str,
         descending: bool = True, where: Column | None = None) -> DataFrame:
    """The dimension value with the highest (or lowest) metric; ties go to the lower key."""
    key = _c(dim)
    m = F.col(name).desc_nulls_last() if descending else F.col(name).asc_nulls_first()
    key_name = dim if isinstance(dim, str) else None
    order = [m, F.col(key_name).asc() if key_name else key.asc()]
    return breakdown(df, [dim], [metric.alias(name)], where=where, order=order, limit=1)
