"""Exact order statistics by narrowing counts, without sorting the rows.

``ntile`` needs the position of every row, but the buckets only depend on the rows at
their edges: bucket of a row = 1 + the number of edges below it. Each edge is the row
at a known position p of a total order (value, then key), and is found by narrowing:

1. An edge keeps a range of the order that holds position p, and the number of rows
   before the range.
2. A bounded sample of the range's rows (by a hash of the key) gives two splitters that
   lie left and right of p with high probability; one aggregation counts the rows up to
   each, exactly. The range shrinks to the part that holds p: about a thirtieth.
3. When a range is small enough to be the sample itself, the edge is read from it.

All edges of all orderings narrow together: each round is one filtered scan and one
aggregation to a single row over a stored table, and the number of rounds grows with the
logarithm of the table (4 for a billion rows). Nothing is shuffled by value, so ties of
any size cost nothing extra; they are split by the key.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Rows that the driver fetches for one edge in a round.
SAMPLE_ROWS = 2_000
_NUMBER = "decimal(38,6)"


@dataclass
class _Edge:
    """Position ``p`` (from 1) of an ordering; it lies after ``low`` and up to ``high``."""

    order: int
    p: int
    before: int
    rows: int
    low: tuple | None = None
    high: tuple | None = None
    found: tuple | None = None


def edge_positions(total: int, tiles: int) -> list[int]:
    """The last position of each NTILE bucket but the last (the first ``total mod tiles``
    buckets have one row more)."""
    size, extra = divmod(total, tiles)
    return [j * size + min(j, extra) for j in range(1, tiles)]


def _sort_fields(value: str, ascending: bool, key: list[str]) -> list[Column]:
    """Fields that compare in the order of ``value``, then ``key``; none is null.

    Nulls as in SQL windows of Spark: first in ascending, last in descending order.
    """
    number = F.col(value).cast(_NUMBER)
    null_rank = F.when(number.isNull(), F.lit(0 if ascending else 1)).otherwise(F.lit(1 if ascending else 0))
    fields = [null_rank, F.coalesce(number if ascending else -number, F.lit(0).cast(_NUMBER))]
    for k in key:
        text = F.col(k).cast("string")
        fields += [F.col(k).isNotNull(), F.coalesce(text, F.lit(""))]
    return fields


def _after(fields: list[Column], edge: tuple) -> Column:
    """Whether a row's fields come after the edge's, compared from left to right."""
    out = F.lit(False)
    for f, v in reversed(list(zip(fields, edge))):
        lit = F.lit(v).cast(_NUMBER) if not isinstance(v, (str, bool)) else F.lit(v)
        out = (f > lit) | ((f == lit) & out)
    return out


def _inside(fields: list[Column], edge: _Edge) -> Column:
    out = F.lit(True)
    if edge.low is not None:
        out = out & _after(fields, edge.low)
    if edge.high is not None:
        out = out & ~_after(fields, edge.high)
    return out


def _sample(df: DataFrame, orders: list[list[Column]], key: list[str], edges: list[_Edge],
            rows: int, turn: int) -> list[list[tuple]]:
    """For each edge about ``rows`` of its range in order; a range of fewer comes whole."""
    tagged = []
    for i, e in enumerate(edges):
        hit = _inside(orders[e.order], e)
        step = -(-e.rows // rows)
        if step > 1:
            hit = hit & (F.pmod(F.xxhash64(F.lit(turn), *key), F.lit(step)) == 0)
        fields = orders[e.order]
        tagged.append(F.when(hit, F.struct(F.lit(i).alias("i"), *[f.alias(f"f{j}") for j, f in enumerate(fields)])))
    picked = df.select(F.explode(F.filter(F.array(*tagged), lambda s: s.isNotNull())).alias("s")).select("s.*")
    out: list[list[tuple]] = [[] for _ in edges]
    for r in picked.collect():
        out[r[0]].append(tuple(r[1:]))
    return [sorted(x, key=_utf8) for x in out]


def _utf8(fields: tuple) -> tuple:
    """Text compares by its UTF-8 bytes, as in Spark."""
    return tuple(f.encode() if isinstance(f, str) else f for f in fields)


def select_positions(df: DataFrame, key: list[str], orders: list[tuple[str, bool]],
                     positions: list[int], total: int, sample_rows: int = SAMPLE_ROWS) -> list[list[tuple]]:
    """The sort fields of the rows at ``positions`` (from 1) in each of ``orders``.

    ``orders`` are (numeric column, ascending), ties by ``key`` as text, which is unique.
    ``df`` is read a few times: pass a stored table.
    """
    fields = [_sort_fields(value, asc, key) for value, asc in orders]
    edges = [_Edge(o, p, 0, total) for o in range(len(orders)) for p in positions if 0 < p <= total]
    turn = 0
    while todo := [e for e in edges if e.found is None]:
        turn += 1
        samples = _sample(df, fields, key, todo, sample_rows, turn)
        counts, probes = [], []
        for e, s in zip(todo, samples):
            if e.rows <= sample_rows:  # the whole range
                e.found = s[e.p - e.before - 1]
                continue
            if not s:  # an unlucky hash: sample anew
                continue
            at = (e.p - e.before) / e.rows * len(s)
            spread = 3 * math.sqrt(len(s) * max(at, 1) / len(s) * (1 - min(at / len(s), 1)) + 1)
            for i in {max(0, math.floor(at - spread)), min(len(s) - 1, math.ceil(at + spread))}:
                probes.append((e, s[i]))
                counts.append(F.count_if(_inside(fields[e.order], e) & ~_after(fields[e.order], s[i])))
        if not probes:
            continue
        seen = df.agg(*[c.alias(f"c{i}") for i, c in enumerate(counts)]).head()
        upto = {}
        for (e, split), n in zip(probes, seen):
            upto.setdefault(id(e), (e, []))[1].append((e.before + n, split))
        for e, splits in upto.values():
            end = e.before + e.rows
            for n, split in sorted(splits, key=lambda x: (x[0], _utf8(x[1]))):
                if n < e.p:
                    e.before, e.low = n, split
                else:
                    end, e.high = n, split
                    break
            e.rows = end - e.before
    return [[e.found for e in edges if e.order == o] for o in range(len(orders))]


def ntile_by_cuts(df: DataFrame, tiles: int, key: list[str], orders: dict[str, tuple[str, bool]],
                  sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """Several NTILE(``tiles``) columns from selected bucket edges.

    ``orders`` maps an output name to (numeric column, ascending); ``key`` is unique per
    row and breaks ties (ascending). Equal to one window per column, nulls first in
    ascending and last in descending order. ``df`` should be a stored table.
    """
    total = df.count()
    cuts = select_positions(df, key, list(orders.values()), edge_positions(total, tiles), total, sample_rows)
    out = df
    for (name, (value, asc)), edges in zip(orders.items(), cuts):
        fields = _sort_fields(value, asc, key)
        tile = F.lit(1).cast("long")
        for edge in edges:
            tile = tile + _after(fields, edge).cast("long")
        out = out.withColumn(name, tile)
    return out
