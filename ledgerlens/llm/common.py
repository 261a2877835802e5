"""Shared helpers of the text operators: tables, words, bounded broadcasts, checkpoints."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlens.session import scratch_dir

#: The white space that ends a word everywhere in this package: x20 and x09-x0D.
SPACE_CHARS = " \t\n\x0b\f\r"
SPACE_CLASS = "[\\x20\\x09-\\x0D]"
SPACE_SPLIT = SPACE_CLASS + "+"

#: A table is broadcast only if it was counted to hold at most this many rows
#: (of a few numbers each).
BROADCAST_ROWS = 200_000
#: .. and, if its rows are of no fixed size, if they add up to at most so many bytes.
BROADCAST_BYTES = 64 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def lower_ascii(text: Column) -> Column:
    """A-Z to a-z, every other character unchanged."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` evaluated once per row, and only where needed."""
    return F.element_at(F.transform(F.array(value), body), 1)


def words(text: Column) -> Column:
    """The words of a text as an array; null, empty and blank texts have none."""
    def inner(a: Column) -> Column:
        edged = (F.get(a, F.lit(0)) == "") | (F.get(a, F.size(a) - 1) == "")
        return F.when(edged, F.filter(a, lambda x: x != "")).otherwise(a)

    return let(F.split(F.coalesce(text, F.lit("")), SPACE_SPLIT), inner)


def persisted(df: DataFrame) -> DataFrame:
    """``df`` written as a table in the shared checkpoint folder and read back: computed
    once, compressed, and safe when an executor is lost. ``session.drop_scratch`` removes
    the application's tables once results are stored."""
    spark = df.sparkSession
    path = f"{scratch_dir(spark)}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def is_small(df: DataFrame, rows: int = BROADCAST_ROWS) -> bool:
    """Whether a stored side was counted to hold at most ``rows`` rows."""
    return df.limit(rows + 1).count() <= rows


def small(df: DataFrame, rows: int = BROADCAST_ROWS, size: Column | None = None) -> DataFrame:
    """A broadcast hint for a stored side of few rows; larger sides come back unhinted
    and join by shuffle. ``size`` is a row's bytes where that is not fixed."""
    if not is_small(df, rows):
        return df
    if size is not None and (df.agg(F.sum(size.cast("long"))).head()[0] or 0) > BROADCAST_BYTES:
        return df
    return F.broadcast(df)


def row_key(docs: DataFrame, id_col: str, text: str) -> DataFrame:
    """``docs`` with a row key (``_k1``, ``_k2``) of id and text, never null; rows that
    agree in both share it."""
    who = F.coalesce(F.col(id_col).cast("string"), F.lit("-"))
    body = F.coalesce(F.col(text), F.lit(""))
    return docs.withColumns({"_k1": F.xxhash64(who, body), "_k2": F.xxhash64(F.lit(2), body)})


def packed(docs: DataFrame, id_col: str, text: str) -> DataFrame:
    """(_row, doc_id, text): all columns of ``docs`` as one struct, so that none of them can
    clash with a name used inside an operator; ``unpacked`` gives them back."""
    return docs.select(F.struct(*docs.columns).alias("_row"), F.col(id_col).alias("doc_id"),
                       F.col(text).alias("text"))


def unpacked(rows: DataFrame) -> DataFrame:
    return rows.select("_row.*")
