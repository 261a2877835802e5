"""Money text from spreadsheet exports back to numbers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def parse_money(x, precision: int = 18, scale: int = 2) -> Column:
    """Text such as ``"? 1,07,194.61"`` or ``"-? 468.25"`` to DECIMAL; blank to NULL.

    Currency signs (also when lost to a '?'), spaces and digit-group commas
    in any grouping (Indian lakh style included) are dropped; an amount in
    parentheses is negative; what is not a
    number afterwards becomes NULL instead of failing the job.
    """
    c = F.trim(F.col(x) if isinstance(x, str) else x)
    digits = F.regexp_replace(c, r"[^0-9.\-]", "")
    signed = F.when(c.rlike(r"^[^0-9(]*\(.*\)[^0-9]*$"), F.concat(F.lit("-"), digits)).otherwise(digits)
    return F.nullif(signed, F.lit("")).try_cast(f"decimal({precision},{scale})")
