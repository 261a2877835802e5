"""Hard negatives against all pairs, on the given tables, hot vectors and odd rows."""

import math

import numpy as np
import pytest
from ledgerlens.llm import hard_negatives as N
from ledgerlens.llm.queries import QUERIES
from pyspark.sql import functions as F

SCHEMA = "vec_id long, embedding array<float>, label int"
NAN, INF = float("nan"), float("inf")


def plain(rows, step=100, moved=True):
    kept = {}
    for i, v, c in rows:
        if i is None or v is None or c is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        c = (c + 1) % 10 if moved and i % 7 == 0 else c
        row = (c, [math.floor(256 * float(np.float32(x))) for x in v])
        kept[i] = min(kept.get(i, row), row)
    out = []
    for a, (c, v) in kept.items():
        if a % step:
            continue
        score = {i: sum(x * y for x, y in zip(v, w)) for i, (_, w) in kept.items() if i != a}
        first = sorted(score, key=lambda i: (-score[i], i))
        for p in [i for i in first if kept[i][0] == c][:5]:
            fits = [i for i in first if kept[i][0] != c and 30 * score[p] <= 100 * score[i] <= 90 * score[p]]
            out += [(a, p, r, i, score[p], score[i]) for r, i in enumerate(fits[:10], 1)]
    return sorted(out)


def mined(rows, step=100, moved=True, **small):
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return sorted(map(tuple, N.hard_negatives(
        rows, F.col("id") % step == 0, label=label if moved else None, **small).collect()))


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.1"])
def test_query_against_all_pairs(spark, sf):
    folder = f"/root/testdata/{sf}"
    rows = [tuple(r) for r in spark.read.parquet(f"{folder}/embeddings.parquet").select(
        "vec_id", "embedding", "label").collect()]
    want = plain(rows)
    assert want and sorted(map(tuple, QUERIES["op13_hard_negatives"](spark, folder).collect())) == want


def test_many_tiles_blocks_and_a_hot_vector(spark):
    """Small pages, tiles, samples and blocks; a third of the rows hold one vector."""
    rng = np.random.default_rng(4)
    rows = [(i, [0.1] * 6 if i % 3 == 0 else rng.normal(size=6).tolist(), int(rng.integers(3))) for i in range(900)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(7)
    small = dict(block=16, sample_rows=200, tile_rows=64, page_rows=8)
    assert mined(df, 25, **small) == plain(rows, 25)


def test_odd_rows(spark):
    rows = [(0, [1.0, 0.0], 1), (1, [1.0, 0.5], 1), (2, [0.5, 0.1], 2), (2, [0.5, 0.1], 2), (3, [0.6], 2),
            (4, [], 2), (5, None, 1), (6, [1.0, 1.0], None), (8, [NAN, 1.0], 2), (9, [INF, 1.0], 2),
            (10, [None, 1.0], 2), (None, [0.7, 0.1], 2), (11, [0.7, 0.2, 9.0], 2), (11, [0.65, 0.2], 2),
            (100, [0.0, 0.0], 1), (200, [-1.0, 0.0], 5), (300, [-0.003, 0.4], 2), (12, [0.5, 0.1], 3)]
    df = spark.createDataFrame(rows, SCHEMA)
    assert mined(df, moved=False) == plain(rows, moved=False)
    extra = df.withColumns({c: F.lit("x") for c in ("id", "q", "tile", "sub", "anchor", "w", "score", "rank")})
    assert mined(extra) == plain(rows)
    assert mined(df.limit(0)) == [] and mined(df.where("vec_id = 0")) == []


@pytest.mark.parametrize("size", [1.0, 300.0, 1e6])
def test_scores_of_any_size_are_exact(spark, size):
    """Numbers that fit a float, a double and only whole numbers."""
    rng = np.random.default_rng(5)
    rows = [(i, (rng.normal(size=5) * size).tolist(), int(rng.integers(3))) for i in range(200)]
    assert mined(spark.createDataFrame(rows, SCHEMA), 20) == plain(rows, 20)


def test_huge_components_are_brought_to_a_limit(spark):
    rows = [(0, [3e38, 1.0], 1), (1, [3e38, -3e38], 1), (2, [3e38, 0.0], 2), (3, [1e9, 0.0], 2)]
    assert all(r[4] < 1 << 62 for r in mined(spark.createDataFrame(rows, SCHEMA), moved=False))


def test_boxes_prune_without_losing_rows():
    """Far pages are not opened, and the hits are those of all rows."""
    rng = np.random.default_rng(6)
    centres = rng.normal(size=(20, 4)) * 1000
    points = np.concatenate([rng.normal(size=(64, 4)) * 10 + c for c in centres]).astype(np.int64)
    pages = N.packed_order(points, np.arange(len(points)), 16, [0, 1, 2, 3])
    assert sorted(np.concatenate(pages).tolist()) == list(range(len(points)))
    assert max(map(len, pages)) <= 16
    table = N.pa.RecordBatch.from_arrays(
        [N.pa.array([x.tobytes() for x in c], N.pa.binary()) for c in zip(*[
            (p, np.ones(len(p), np.int64), points[p], points[p].min(0), points[p].max(0)) for p in pages])], N.PAGE)
    tree = N.Tree(table, 4, np.float64)
    opened = []
    tree.vectors = [type("V", (), {"T": property(lambda s, v=v: (opened.append(1), v.T)[1])})() for v in tree.vectors]
    best = N.Best(1, 1, 10)
    one = {"id": np.array([-1]), "label": np.array([1]), "vector": points[:1].astype(float),
           "low": np.full((1, 1), N._LOWEST), "high": np.full((1, 1), N._HIGHEST)}
    N.search(tree, one, True, best)
    best.settle()
    score = points @ points[0]
    want = np.lexsort((np.arange(len(points)), -score))[:10]
    assert best.hits[2].tolist() == want.tolist()
    assert len(opened) < len(pages) / 4
