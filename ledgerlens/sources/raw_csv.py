"""Bulk load of the raw order-line export (CSV)."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StringType, StructField, StructType

# ---------------------------------------------------------------------------
# The export's 21 header names, in file order.
RAW_HEADER = [
    "Row ID", "Order ID", "Order Date", "Ship Date", "Ship Mode", "Customer ID",
    "Customer Name", "Segment", "Country", "City", "State", "Postal Code", "Region",
    "Product ID", "Category", "Sub-Category", "Product Name", "Sales", "Quantity",
    "Discount", "Profit",
]
# ---------------------------------------------------------------------------

_BOM_RESIDUE = ("\ufeff", "\u00ef\u00bb\u00bf")


def column_name(header: str) -> str:
    """Header text to a column name: byte-order-mark residue dropped, snake case.

    ``'ï»¿Row ID'`` (a UTF-8 BOM read as latin1) -> ``'row_id'``;
    ``'Sub-Category'`` -> ``'sub_category'``.
    """
    h = header
    for residue in _BOM_RESIDUE:
        h = h.replace(residue, "")
    return re.sub(r"[^0-9a-z]+", "_", h.strip().lower()).strip("_")


RAW_COLUMNS = [column_name(h) for h in RAW_HEADER]
RAW_SCHEMA = StructType([StructField(c, StringType(), True) for c in RAW_COLUMNS])


def read_orders(spark: SparkSession, path: str, encoding: str = "ISO-8859-1",
                multi_line: bool = False, bad_rows: str | None = None) -> DataFrame:
    """Read the raw export: comma fields, optional ``"`` quotes, CRLF lines, one
    header line, latin1 text (C01).

    Every column is read as text under an explicit schema, so there is no
    inference pass and the damaged first header does not matter (C06); typing
    is the job of ``clean_orders``. Files split across tasks by size.

    ``multi_line`` reads line breaks inside quoted fields (a file is then one task).
    ``bad_rows`` names an extra column with the text of rows that do not have 21 fields,
    so that they can be counted; without it such rows come back with NULLs.
    """
    extra = [StructField(bad_rows, StringType(), True)] if bad_rows else []
    schema = StructType([*RAW_SCHEMA.fields, *extra])
    reader = (spark.read.schema(schema)
              .option("header", True)
              .option("encoding", encoding)
              .option("quote", '"')
              .option("escape", '"')
              .option("multiLine", multi_line)
              .option("mode", "PERMISSIVE"))
    if bad_rows:
        reader = reader.option("columnNameOfCorruptRecord", bad_rows)
    return reader.csv(path)


def repair_header(df: DataFrame) -> DataFrame:
    """Rename columns of a header-inferred read to clean names."""
    return df.toDF(*[column_name(c) for c in df.columns])


def write_orders_export(df: DataFrame, path: str, encoding: str = "ISO-8859-1",
                        mode: str = "errorifexists", mixed_dates: bool = False,
                        mark: bool = False, line_breaks: bool = False) -> None:
    """Write order lines in the raw export layout read by ``read_orders``.

    The 21 header names in file order, dates as month-first text
    (``11/8/2016``), everything else as text; columns the frame lacks are
    left empty. Quoted where needed, latin1. One part file per partition.

    ``mixed_dates`` writes the dates of a row with slashes, hyphens or in ISO order, by
    a hash of the row; ``mark`` puts the residue of a byte-order mark before the first
    header. A line break inside a value is an error unless ``line_breaks`` allows it
    (the file must then be read with ``multi_line``).
    """
    from pyspark.sql import functions as F

    turn = F.pmod(F.xxhash64(*df.columns), F.lit(3)) if mixed_dates else F.lit(0)
    cols = []
    for header, name in zip(RAW_HEADER, RAW_COLUMNS):
        if mark and not cols:
            header = _BOM_RESIDUE[1] + header
        if name not in df.columns:
            value = F.lit(None).cast("string")
        elif name in ("order_date", "ship_date"):
            shapes = [F.date_format(F.col(name), f) for f in ("M/d/yyyy", "M-d-yyyy", "yyyy-MM-dd")]
            value = F.when(turn == 0, shapes[0]).when(turn == 1, shapes[1]).otherwise(shapes[2])
        else:
            value = F.col(name).cast("string")
            if not line_breaks:
                value = F.when(value.rlike("[\\r\\n]"), F.raise_error(F.lit(
                    f"line break in {name}"))).otherwise(value)
        cols.append(value.alias(header))
    (df.select(*cols).write.mode(mode)
     .option("header", True).option("encoding", encoding)
     .option("quote", '"').option("escape", '"')
     .csv(path))
