"""Reading and writing workbook-style CSV exports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from ledgerlens.functions.money import parse_money


def read_money_table(spark: SparkSession, path: str, columns: list[str],
                     money_columns: list[str], skip_header: bool = True,
                     encoding: str = "UTF-8") -> DataFrame:
    """Read an exported block as text and parse its money columns.

    All columns are read as strings with an explicit schema (no inference
    pass over the data); money columns are parsed on the executors.
    """
    schema = StructType([StructField(c, StringType(), True) for c in columns])
    raw = (spark.read.schema(schema).option("header", skip_header).option("encoding", encoding)
           .option("mode", "PERMISSIVE").csv(path))
    return raw.select(*[parse_money(c).alias(c) if c in money_columns else F.col(c)
                        for c in columns])


def write_report_csv(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Write a report as CSV with a header, one folder of part files."""
    df.write.mode(mode).option("header", True).csv(path)
