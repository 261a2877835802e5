"""Run a registered query against its SQL check in DuckDB and compare.

Used by the tests and by ``tools/oracle_check.py``. Comparison is by column
name and order-insensitive over rows; DOUBLE values must be equal exactly
(both sides round the same way), dates are compared as ISO text.
"""

from __future__ import annotations

import math
import os

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
          "documents", "embeddings", "pages", "benchmark", "labels", "conversations"]

_SPARK_TO_DUCK = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR",
                  "date": "DATE", "boolean": "BOOLEAN"}


def duck_connection(sf_dir: str):
    import duckdb
    con = duckdb.connect()
    for t in TABLES:
        if os.path.exists(f"{sf_dir}/{t}.parquet"):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def _norm(v):
    if isinstance(v, float) and math.isnan(v):
        return None
    if hasattr(v, "isoformat"):
        return v.isoformat()[:10]
    return v


def _canon(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    out = [tuple(_norm(r[i]) for i in order) for r in rows]
    key = lambda t: tuple((x is None, str(x)) for x in t)
    return [cols[i] for i in order], sorted(out, key=key)


def compare(df, con, sql: str) -> list[str]:
    """Problems found (empty when the results agree)."""
    problems = []
    srows = [tuple(r) for r in df.collect()]
    cur = con.execute(sql)
    drows = cur.fetchall()
    dcols = [d[0] for d in cur.description]
    dtypes = {d[0]: str(d[1]) for d in cur.description}
    for c, t in df.dtypes:
        if _SPARK_TO_DUCK.get(t, t) != dtypes.get(c):
            problems.append(f"type of {c}: spark {t} vs sql {dtypes.get(c)}")
    sc, sr = _canon(df.columns, srows)
    dc, dr = _canon(dcols, drows)
    if sc != dc:
        problems.append(f"columns {sc} vs {dc}")
    elif sr != dr:
        diff = [(a, b) for a, b in zip(sr, dr) if a != b][:2]
        problems.append(f"rows {len(sr)} vs {len(dr)}; first differences {diff}")
    return problems
