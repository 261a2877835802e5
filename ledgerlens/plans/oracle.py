"""Building blocks for the independent SQL checks (DuckDB dialect).

The flat sales view is restated in SQL from its definition (SURVEY §7.2), with
the same exact DECIMAL arithmetic. Rounding of DOUBLE values goes through a
DECIMAL cast so that halves round away from zero, as Spark's ``round`` does.
"""

from __future__ import annotations

from ledgerlens.functions.bands import (BUCKET_LEVEL, BUCKET_LEVEL_OTHER, DISCOUNT_BUCKET_EDGES,
                                        DISCOUNT_BUCKET_LABELS, DISCOUNT_TIER_EDGES, DISCOUNT_TIER_LABELS)

SALES_SQL = """
    SELECT
        b.order_id, b.line_number, b.product_id, b.supplier_id,
        CAST(o.o_orderdate AS DATE) AS order_date,
        b.ship_date,
        o.o_orderpriority AS ship_mode,
        o.o_custkey AS customer_id,
        c.c_name AS customer_name,
        c.c_mktsegment AS segment,
        n.n_name AS state,
        r.r_name AS region,
        r.r_name AS country,
        n.n_name AS city,
        CAST(c.c_custkey % 500 AS VARCHAR) AS postal_code,
        p.p_type AS category,
        p.p_brand AS sub_category,
        p.p_name AS product_name,
        b.quantity,
        b.discount,
        CAST(ROUND(b.price * (1 - b.discount), 2) AS DECIMAL(18,2)) AS sales,
        CAST(ROUND(b.price * (1 - b.discount)
                   - 1.2 * CAST(b.quantity AS DECIMAL(10,0)) * CAST(p.p_retailprice AS DECIMAL(18,2)), 2)
             AS DECIMAL(18,2)) AS profit
    FROM (
        SELECT l_orderkey AS order_id, l_linenumber AS line_number,
               l_partkey AS product_id, l_suppkey AS supplier_id,
               CAST(l_shipdate AS DATE) AS ship_date,
               CAST(l_quantity AS INTEGER) AS quantity,
               CAST(CAST(l_discount AS DECIMAL(4,2)) * 8 AS DECIMAL(4,2)) AS discount,
               CAST(l_extendedprice AS DECIMAL(18,2)) AS price
        FROM lineitem
    ) b
    JOIN part p ON p.p_partkey = b.product_id
    JOIN orders o ON o.o_orderkey = b.order_id
    JOIN customer c ON c.c_custkey = o.o_custkey
    JOIN nation n ON n.n_nationkey = c.c_nationkey
    JOIN region r ON r.r_regionkey = n.n_regionkey
"""


def with_sales(body: str) -> str:
    """A full oracle query: the sales view as a CTE, then ``body``."""
    body = body.strip()
    if body[:4].upper() == "WITH":
        return f"WITH sales AS ({SALES_SQL}),\n{body[4:].lstrip()}"
    return f"WITH sales AS ({SALES_SQL})\n{body}"


def r(expr: str, digits: int = 2) -> str:
    """ROUND of a DOUBLE expression, halves away from zero, as DOUBLE."""
    return f"CAST(ROUND(CAST(({expr}) AS DECIMAL(38,10)), {digits}) AS DOUBLE)"


def ratio(num: str, den: str) -> str:
    return f"(CAST(({num}) AS DOUBLE) / NULLIF(CAST(({den}) AS DOUBLE), 0))"


def mean(x: str) -> str:
    return f"(CAST(SUM({x}) AS DOUBLE) / NULLIF(COUNT({x}), 0))"


def margin_pct(p: str = "profit", s: str = "sales", digits: int = 2) -> str:
    return r(f"{ratio(f'SUM({p})', f'SUM({s})')} * 100", digits)


def money(x: str) -> str:
    return f"CAST(({x}) AS DOUBLE)"


def money_text(x: str, prefix: str = "$") -> str:
    return f"'{prefix}' || format('{{:,.2f}}', CAST(ABS({x}) AS DOUBLE))"


def bands_sql(x: str, edges: list[str], labels: list[str]) -> str:
    """Zero, then up to each edge in turn, then the rest, from the fixed band values."""
    cases = [f"WHEN {x} = 0 THEN '{labels[0]}'"]
    cases += [f"WHEN {x} BETWEEN 0 AND {e} THEN '{name}'" for e, name in zip(edges, labels[1:])]
    return f"CASE {' '.join(cases)} ELSE '{labels[-1]}' END"


def at_least_sql(x: str, edges: list, labels: list[str]) -> str:
    """From each edge on, highest first, then the rest."""
    cases = [f"WHEN {x} >= {e} THEN '{name}'" for e, name in zip(edges, labels)]
    return f"CASE {' '.join(cases)} ELSE '{labels[-1]}' END"


def discount_bucket_sql(x: str = "discount") -> str:
    return bands_sql(x, DISCOUNT_BUCKET_EDGES, DISCOUNT_BUCKET_LABELS)


def discount_tier_sql(x: str = "discount") -> str:
    return bands_sql(x, DISCOUNT_TIER_EDGES, DISCOUNT_TIER_LABELS)


def bucket_level_sql(x: str) -> str:
    cases = [f"WHEN {x} IN ({', '.join(repr(m) for m in members)}) THEN '{level}'"
             for level, members in BUCKET_LEVEL.items()]
    return f"CASE {' '.join(cases)} ELSE '{BUCKET_LEVEL_OTHER}' END"
