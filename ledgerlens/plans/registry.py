"""Query registry: one entry per analysis, with its independent SQL check.

Each entry holds a Spark callable ``(spark, sf_dir) -> DataFrame`` and, where
the analysis is expressible in plain SQL, an equivalent query that DuckDB runs
on the same parquet tables. The two are written independently: the Spark side
goes through the operators of this package, the SQL side restates the
semantics from scratch.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession


@dataclass
class Entry:
    name: str
    fn: Callable[[SparkSession, str], DataFrame]
    sql: str | None
    ids: tuple[str, ...] = field(default_factory=tuple)


REGISTRY: dict[str, Entry] = {}


def register(name: str, sql: str | None, ids: tuple[str, ...] | str = ()):
    if isinstance(ids, str):
        ids = (ids,)

    def deco(fn):
        if name in REGISTRY:
            raise ValueError(f"duplicate query {name}")
        REGISTRY[name] = Entry(name, fn, sql, tuple(ids))
        return fn
    return deco


def load_all() -> dict[str, Entry]:
    """Import every plan module so that their queries register."""
    from ledgerlens.plans import cleaning, eda, intermediate, leakage, rfm, workbook  # noqa: F401
    return REGISTRY
