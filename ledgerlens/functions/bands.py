"""Banding expressions: a value to a labelled band as one CASE expression."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column
from pyspark.sql import functions as F

# ---------------------------------------------------------------------------
# Fixed values that must equal the reference's labels and edges.
# Discount tiers (four): = 0 | <= 0.2 | <= 0.4 | rest
DISCOUNT_TIER_EDGES = ["0.2", "0.4"]
DISCOUNT_TIER_LABELS = [
    "0% (No Discount)",
    "1-20% (Low discount)",
    "21-40% (Medium discount)",
    "41% (Heavy discount)",
]
# Discount buckets (six): = 0 | (0, 0.1] | (0.1, 0.2] | (0.2, 0.3] | (0.3, 0.4] | rest
DISCOUNT_BUCKET_EDGES = ["0.1", "0.2", "0.3", "0.4"]
DISCOUNT_BUCKET_LABELS = [
    "0% discount",
    "1 to 10% discount",
    "10 to 20% discount",
    "20 to 30% discount",
    "30 to 40% discount",
    "40%+ discount",
]
# Coarse level of a six-way bucket, as printed in the top-loss report.
BUCKET_LEVEL = {
    "High": ["30 to 40% discount", "40%+ discount"],
    "Medium": ["10 to 20% discount", "20 to 30% discount"],
}
BUCKET_LEVEL_OTHER = "Low"
# Shipping experience by mean shipping days: >= 5 | >= 3 | rest
SHIPPING_EDGES = [5, 3]
SHIPPING_LABELS = [
    "Delayed Shipping (5+ Days)",
    "Average Shipping (3-5 Days)",
    "Fast Shipping (Under 3 Days)",
]
# ---------------------------------------------------------------------------


def _col(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def zero_then_upper_bands(x, edges, labels, lower_bounded: bool = False) -> Column:
    """``= 0`` first, then ``<= edge`` for each edge in order, else the last label.

    With ``lower_bounded`` each band also requires ``> previous edge`` (and the
    first one ``> 0``), so negative values fall to the last label as in a CASE
    written with both bounds. NULL always lands in the last band.
    """
    if len(labels) != len(edges) + 2:
        raise ValueError("need one label per edge plus the zero and the rest bands")
    v = _col(x)
    expr = F.when(v == 0, F.lit(labels[0]))
    prev = Decimal("0")
    for edge, label in zip(edges, labels[1:-1]):
        e = Decimal(str(edge))
        cond = v <= F.lit(e)
        if lower_bounded:
            cond = (v > F.lit(prev)) & cond
        expr = expr.when(cond, F.lit(label))
        prev = e
    return expr.otherwise(F.lit(labels[-1]))


def discount_tier(x="discount") -> Column:
    return zero_then_upper_bands(x, DISCOUNT_TIER_EDGES, DISCOUNT_TIER_LABELS)


def discount_bucket(x="discount") -> Column:
    return zero_then_upper_bands(x, DISCOUNT_BUCKET_EDGES, DISCOUNT_BUCKET_LABELS,
                                 lower_bounded=True)


def bucket_level(bucket) -> Column:
    b = _col(bucket)
    expr = None
    for level, members in BUCKET_LEVEL.items():
        cond = b.isin(*members)
        expr = F.when(cond, F.lit(level)) if expr is None else expr.when(cond, F.lit(level))
    return expr.otherwise(F.lit(BUCKET_LEVEL_OTHER))


def at_least_bands(x, edges, labels) -> Column:
    """``>= edge`` for each edge in order, else the last label (NULL included)."""
    if len(labels) != len(edges) + 1:
        raise ValueError("need one label per edge plus the rest band")
    v = _col(x)
    expr = None
    for edge, label in zip(edges, labels):
        cond = v >= F.lit(edge)
        expr = F.when(cond, F.lit(label)) if expr is None else expr.when(cond, F.lit(label))
    return expr.otherwise(F.lit(labels[-1]))


def shipping_experience(x) -> Column:
    return at_least_bands(x, SHIPPING_EDGES, SHIPPING_LABELS)
