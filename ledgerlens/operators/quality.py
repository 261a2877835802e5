"""Data-quality audit: schema, missing values, suspect rows, reconciliation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlens.functions import metrics as M


def describe(df: DataFrame) -> DataFrame:
    """(column, type) of every column (C07). Built from the schema, no job."""
    return df.sparkSession.createDataFrame(df.dtypes, "col_name string, data_type string")


def missing_report(df: DataFrame, text_cols=(), null_only_cols=(), zero_is_missing_cols=()
                   ) -> DataFrame:
    """One row of ``null_<col>`` counters in one pass."""
    counters = missing_counters(text_cols, null_only_cols, zero_is_missing_cols)
    return df.agg(*[c.alias(name) for name, c in counters.items()])


def missing_counters(text_cols=(), null_only_cols=(), zero_is_missing_cols=()) -> dict[str, Column]:
    """The counters of ``missing_report`` by name.

    Text columns count NULL or empty string; dates and ids count NULL; a
    numeric column compared with '' in the reference counts NULL or 0.
    """
    out = {}
    for c in text_cols:
        out[f"null_{c}"] = M.count_if(F.coalesce(F.col(c).cast("string"), F.lit("")) == "")
    for c in null_only_cols:
        out[f"null_{c}"] = M.count_if(F.col(c).isNull())
    for c in zero_is_missing_cols:
        out[f"null_{c}"] = M.count_if(F.coalesce(F.col(c), F.lit(0)) == 0)
    return out


def suspect_rows(df: DataFrame, columns: list[str], sales: str = "sales",
                 postal_code: str | None = "postal_code") -> DataFrame:
    """Rows with no sales (0 or NULL) or postal code 0 (C11)."""
    cond = F.coalesce(F.col(sales), F.lit(0)) == 0
    if postal_code and postal_code in df.columns:
        cond = cond | (F.trim(F.col(postal_code)).try_cast("int") == 0)
    return df.where(cond).select(*columns)


def lookup(df: DataFrame, columns: list[str] | None = None, ignore_case: bool = False,
           **equals) -> DataFrame:
    """Rows matching every ``column == value`` (C09, C19); pushed to the scan.

    ``ignore_case`` compares text as the reference's database does.
    """
    cond: Column | None = None
    for k, v in equals.items():
        term = M.same_text(k, v, ignore_case)
        cond = term if cond is None else cond & term
    out = df.where(cond) if cond is not None else df
    return out.select(*columns) if columns else out


def row_count(df: DataFrame, name: str = "row_count") -> DataFrame:
    """COUNT(*) (C15)."""
    return df.agg(M.rows().alias(name))


def distinct_count(df: DataFrame, key: str, name: str) -> DataFrame:
    """COUNT(DISTINCT key)."""
    return df.agg(F.countDistinct(key).alias(name))


def rows_vs_keys(df: DataFrame, key: str = "order_id") -> DataFrame:
    """Rows, distinct keys and their difference in one pass (C17).

    The difference counts lines beyond the first of each order; it is not a
    count of duplicates (an order has many lines).
    """
    return df.agg(M.rows().alias("total_rows"), F.countDistinct(key).alias("unique_orders")
                  ).withColumn("extra_lines", F.col("total_rows") - F.col("unique_orders"))
