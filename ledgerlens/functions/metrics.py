"""Aggregate expressions shared by the reports.

Money is summed as DECIMAL, so totals are exact and do not depend on how the
rows are split over partitions. Ratios and means divide an exact sum as DOUBLE
and go through ``try_divide``: ANSI mode would raise on a zero denominator
where the reference's engine returned NULL. Returned values are DOUBLE so that
every report has plain numeric columns.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def as_money(x) -> Column:
    """An exact decimal value as DOUBLE for output."""
    return c(x).cast("double")


def total(x, digits: int | None = 2) -> Column:
    """SUM of a decimal column, rounded, as DOUBLE."""
    s = F.sum(c(x))
    return (F.round(s, digits) if digits is not None else s).cast("double")


def ratio(num, den) -> Column:
    """num / den as DOUBLE; NULL when den is 0 or NULL."""
    return F.try_divide(c(num).cast("double"), c(den).cast("double"))


def mean(x) -> Column:
    """AVG over non-null values: exact sum divided by the count."""
    return F.try_divide(F.sum(c(x)).cast("double"), F.count(c(x)))


def rounded(x, digits: int = 2) -> Column:
    return F.round(c(x), digits)


def margin_pct(profit="profit", sales="sales", digits: int = 2) -> Column:
    """Margin % as a ratio of sums (never a mean of ratios)."""
    return F.round(ratio(F.sum(c(profit)), F.sum(c(sales))) * 100, digits)


def margin_ratio(profit="profit", sales="sales", digits: int = 2) -> Column:
    return F.round(ratio(F.sum(c(profit)), F.sum(c(sales))), digits)


def mean_pct(x, digits: int = 2) -> Column:
    """Mean of a rate shown as percent, e.g. AVG(discount) * 100."""
    return F.round(mean(x) * 100, digits)


def rows() -> Column:
    """COUNT(*) as BIGINT."""
    return F.count(F.lit(1))


def count_if(cond: Column) -> Column:
    return F.count_if(cond).cast("long")


def sum_if(cond: Column, x) -> Column:
    """SUM(CASE WHEN cond THEN x ELSE 0 END)."""
    return F.sum(F.when(cond, c(x)).otherwise(F.lit(0)))


def ship_days(ship="ship_date", order="order_date") -> Column:
    return F.datediff(c(ship), c(order))


def money_text(x, sign: str = "$", negative: bool = False) -> Column:
    """Display text such as ``-$21,909.40`` built from an absolute amount."""
    prefix = ("-" if negative else "") + sign
    return F.concat(F.lit(prefix), F.format_number(F.abs(c(x)), 2))


# Over rows already folded per order (``sales_by_order``): a column keeps its
# per-order sum under its own name, ``<col>_n`` counts its lines and
# ``n_lines`` counts all lines, so line-level means and counts come out equal.

def folded_rows() -> Column:
    """COUNT(*) of the underlying lines."""
    return F.sum("n_lines").cast("long")


def folded_mean(x: str) -> Column:
    """AVG of a line column, from per-order sums and counts."""
    return F.try_divide(F.sum(x).cast("double"), F.sum(f"{x}_n"))


def folded_mean_pct(x: str, digits: int = 2) -> Column:
    return F.round(folded_mean(x) * 100, digits)


def folded_ship_days(ship="ship_date", order="order_date") -> Column:
    """Per folded order: the sum over its lines of DATEDIFF(ship, order).

    From ``<ship>_days`` (sum of ship day numbers) and ``<ship>_n``: exact
    integer arithmetic, NULL ship dates excluded as in the line-level AVG.
    """
    return F.col(f"{ship}_days") - F.col(f"{ship}_n") * F.unix_date(F.col(order))


def folded_mean_ship_days(ship="ship_date", order="order_date") -> Column:
    """AVG(DATEDIFF(ship, order)) over the lines, from folded orders."""
    return F.try_divide(F.sum(folded_ship_days(ship, order)).cast("double"),
                        F.sum(f"{ship}_n"))


def same_text(x, value, ignore_case: bool = False) -> Column:
    """``x == value``; text without regard to case if asked for."""
    if ignore_case and isinstance(value, str):
        return F.lower(c(x)) == F.lower(F.lit(value))
    return c(x) == F.lit(value)
