"""Hard negatives by an STR-packed R-tree over quantised vectors.

1. Vectors become whole numbers. Sort-tile-recursive packing: cuts along the coordinates
   of most variance, taken from a bounded sample, deal all rows to tiles; a tile that holds
   too many rows (equal vectors) is split by id. A task packs a tile in the same manner
   into pages, each stored with its minimum bounding box.
2. A box and an anchor give an interval of inner products, coordinate by coordinate: the
   anchor's positive parts times the box's upper (lower) corner and its negative parts
   times the other. Anchors are searched in blocks of a fixed number against all pages:
   in every task a best-first queue opens the box with the highest upper bound and skips
   those that no anchor of the batch needs, because the interval misses its score windows
   or lies strictly below its k-th score so far.
3. The first search finds the best rows of the anchor's own label (positives); the second
   the best rows of other labels inside the score window that each positive sets. The few
   rows that each task keeps for an anchor are merged by rank.

The sample steers where the cuts lie, never which rows are searched: results are exact.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerlens.llm.common import persisted, small

SCALE = 256
POSITIVES = 5
NEGATIVES = 10
#: Negative scores in percent of the positive's.
BAND = (30, 90)
#: Rows that the cuts between tiles are taken from.
SAMPLE = 50_000
TILE_ROWS = 32_768
PAGE_ROWS = 128
FANOUT = 16
#: Anchors searched at a time by all tasks (sent to them, about 4 MB), and in one queue.
BLOCK = 16_384
BATCH = 128
_LOWEST, _HIGHEST = -(1 << 62), 1 << 62


# --- rows ---------------------------------------------------------------------------------

def quantised(rows: DataFrame, id_col: str, vector: str, label: Column, scale: int) -> DataFrame:
    """(id, label, q) of the rows that take part; of rows with one id the least."""
    v = F.col(vector)
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    # scores must fit a long: no component goes beyond the square root of 2^62 / its number
    limit = F.floor(F.sqrt(F.lit(float(1 << 62)) / F.greatest(F.size(v), F.lit(1))))
    q = F.transform(v, lambda x: F.greatest(-limit, F.least(limit, F.floor(
        F.least(F.lit(1e15), F.greatest(F.lit(-1e15), x.cast("double") * scale))))))
    kept = rows.where(F.col(id_col).isNotNull() & label.isNotNull() & v.isNotNull()).where(finite)
    kept = persisted(kept.select(F.col(id_col).cast("long").alias("id"), label.cast("long").alias("label"),
                                 q.cast("array<long>").alias("q")))
    twice = persisted(kept.groupBy("id").agg(F.count(F.lit(1)).alias("c")).where("c > 1").select("id"))
    if twice.isEmpty():
        return kept
    twice = small(twice)
    least = kept.join(twice, "id", "left_semi").groupBy("id").agg(F.min(F.struct("label", "q")).alias("r"))
    return persisted(kept.join(twice, "id", "left_anti").unionByName(least.select("id", "r.label", "r.q")))


def _dense(vectors: pa.Array, dims: int) -> np.ndarray:
    """Rows of ``dims`` numbers; shorter vectors end in zeros."""
    flat, ends = vectors.flatten().to_numpy(), np.diff(vectors.offsets.to_numpy())
    if len(ends) and (ends == dims).all():
        return flat.reshape(-1, dims)
    out = np.zeros((len(ends), dims), np.int64)
    out[np.repeat(np.arange(len(ends)), ends), np.concatenate([np.arange(e) for e in ends] or [flat])] = flat
    return out


# --- sort-tile-recursive packing ------------------------------------------------------------

def _slabs(pages: int, dims: int) -> int:
    return max(2, math.ceil(round(pages ** (1 / dims), 9)))


def tile_cuts(points: np.ndarray, tiles: int, dims: list[int]) -> tuple | int:
    """Nested cuts (coordinate, values, children) that deal points to ``tiles`` tiles; a
    leaf is its number of tiles."""
    if tiles <= 1 or not dims or len(points) < 2:
        return max(tiles, 1)
    s = min(_slabs(tiles, len(dims)), tiles)
    x = np.sort(points[:, dims[0]])
    values = np.unique(x[[len(x) * i // s for i in range(1, s)]])
    side = np.searchsorted(values, points[:, dims[0]], "right")
    return dims[0], values, [tile_cuts(points[side == i], -(-tiles // s), dims[1:]) for i in range(len(values) + 1)]


def tile_of(points: np.ndarray, cuts: tuple | int, first: int = 0) -> tuple[np.ndarray, int]:
    """The tile of each point, and the first number not in use."""
    if isinstance(cuts, int):
        return np.full(len(points), first), first + 1
    dim, values, children = cuts
    side, out = np.searchsorted(values, points[:, dim], "right"), np.zeros(len(points), np.int64)
    for i, child in enumerate(children):
        here = side == i
        out[here], first = tile_of(points[here], child, first)
    return out, first


def packed_order(points: np.ndarray, rows: np.ndarray, page_rows: int, dims: list[int]) -> list[np.ndarray]:
    """``rows`` (indices of points) in pages of at most ``page_rows``, sorted and tiled."""
    pages = -(-len(rows) // page_rows)
    if pages <= 1:
        return [rows]
    if not dims:
        return np.array_split(rows, pages)
    s = min(_slabs(pages, len(dims)), pages)
    ordered = rows[np.argsort(points[rows, dims[0]], kind="stable")]
    each = -(-pages // s) * page_rows
    return [p for i in range(0, len(ordered), each)
            for p in packed_order(points, ordered[i:i + each], page_rows, dims[1:])]


def r_tree(rows: DataFrame, dims: int, sample_rows: int = SAMPLE, tile_rows: int = TILE_ROWS,
           page_rows: int = PAGE_ROWS) -> DataFrame:
    """The stored leaf pages: (ids, labels, vectors, low, high), numbers as bytes."""
    n = rows.count()
    part = rows.where(F.pmod(F.xxhash64("id"), F.lit(-(-n // sample_rows))) == 0) if n > sample_rows else rows
    points = _dense(part.select("q").toArrow().column(0).combine_chunks(), dims)
    by_variance = np.argsort(-points.astype(np.float64).var(0), kind="stable").tolist() if len(points) else []
    cuts = tile_cuts(points, -(-n // tile_rows), by_variance)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            tile = tile_of(_dense(b.column(2), dims), cuts)[0]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(tile, pa.int64())], ["id", "label", "q", "tile"])

    def pack(group: pa.Table) -> pa.Table:
        group = group.combine_chunks()
        ids, labels = group.column("id").to_numpy(), group.column("label").to_numpy()
        points = _dense(group.column("q").chunk(0), dims)
        dims_here = np.argsort(-points.astype(np.float64).var(0), kind="stable").tolist()
        out = []
        for rows in packed_order(points, np.argsort(ids, kind="stable"), page_rows, dims_here):
            v = points[rows]
            out.append([x.tobytes() for x in (ids[rows], labels[rows], v, v.min(0), v.max(0))])
        return pa.table([pa.array(c, pa.binary()) for c in zip(*out)], PAGE)

    dealt = persisted(rows.mapInArrow(deal, "id long, label long, q array<long>, tile long"))
    sizes = persisted(dealt.groupBy("tile").agg(F.count(F.lit(1)).alias("n")))
    subs = F.ceil(F.col("n") / tile_rows).cast("long")
    # one row per tile, at most as many as the sample has rows
    placed = dealt.join(F.broadcast(sizes), "tile").withColumn(
        "sub", F.pmod(F.xxhash64("id"), subs)).select("tile", "sub", "id", "label", "q")
    return persisted(placed.groupBy("tile", "sub").applyInArrow(pack, ", ".join(f"{c} binary" for c in PAGE)))


PAGE = ["ids", "labels", "vectors", "low", "high"]


# --- search ---------------------------------------------------------------------------------

class Best:
    """The best ``k`` hits of each (anchor, window), and the k-th score as a bound."""

    def __init__(self, anchors: int, windows: int, k: int) -> None:
        self.k, self.windows = k, windows
        self.kth = np.full((anchors, windows), _LOWEST, np.int64)
        self.hits = np.zeros((3, 0), np.int64)  # slot, score, id
        self.new: list[np.ndarray] = []
        self.waiting = 0

    def add(self, slot: np.ndarray, score: np.ndarray, ids: np.ndarray) -> None:
        self.new.append(np.stack([slot, score, ids]))
        self.waiting += len(slot)
        if self.waiting > self.kth.size * self.k // 4:
            self.settle()

    def settle(self) -> None:
        hits = np.concatenate([self.hits, *self.new], axis=1)
        self.new, self.waiting = [], 0
        hits = hits[:, np.lexsort((hits[2], -hits[1], hits[0]))]
        starts = np.flatnonzero(np.diff(hits[0], prepend=-1))
        sizes = np.diff(np.append(starts, hits.shape[1]))
        rank = np.arange(hits.shape[1]) - np.repeat(starts, sizes)
        last = rank == self.k - 1
        self.kth.reshape(-1)[hits[0, last]] = hits[1, last]
        self.hits = hits[:, rank < self.k]


class Tree:
    """Pages of an R-tree with the boxes above them."""

    def __init__(self, pages: pa.RecordBatch, dims: int, kind: type) -> None:
        self.ids, self.labels = ([np.frombuffer(x, np.int64) for x in pages.column(i).to_pylist()] for i in (0, 1))
        self.vectors = [np.frombuffer(x, np.int64).reshape(-1, dims).astype(kind) for x in pages.column(2).to_pylist()]
        low, high = (np.frombuffer(b"".join(pages.column(i).to_pylist()), np.int64).reshape(-1, dims)
                     for i in (3, 4))
        self.boxes = [(low.astype(kind), high.astype(kind))]  # leaves first, the top level last
        while len(low) > FANOUT:
            cut = np.arange(0, len(low), FANOUT)
            low, high = np.minimum.reduceat(low, cut), np.maximum.reduceat(high, cut)
            self.boxes.append((low.astype(kind), high.astype(kind)))


def search(tree: Tree, anchors: dict, own_label: bool, best: Best) -> None:
    """Best-first search of one batch of ``anchors`` (id, label, vector, low and high ends of
    their score windows); hits go to ``best``."""
    v, floor, ceiling = anchors["vector"], anchors["low"], anchors["high"]
    up, down = np.maximum(v, 0), np.minimum(v, 0)

    def needed(top: np.ndarray, bottom: np.ndarray) -> np.ndarray:
        """Which (anchor, box) some window of the anchor still needs."""
        least = np.maximum(floor, best.kth)
        return ((top[:, :, None] >= least[:, None, :]) & (bottom[:, :, None] <= ceiling[:, None, :])).any(2)

    queue: list[tuple] = []

    def push(level: int, first: int, end: int) -> None:
        low, high = (c[first:end] for c in tree.boxes[level])
        top, bottom = up @ high.T + down @ low.T, up @ low.T + down @ high.T
        open_ = needed(top, bottom)
        for i in np.flatnonzero(open_.any(0)).tolist():
            key = -top[open_[:, i], i].max()
            heapq.heappush(queue, (key, level, first + i, top[:, i:i + 1], bottom[:, i:i + 1]))

    push(len(tree.boxes) - 1, 0, len(tree.boxes[-1][0]))
    while queue:
        _, level, at, top, bottom = heapq.heappop(queue)
        rows = np.flatnonzero(needed(top, bottom)[:, 0])
        if not len(rows):
            continue
        if level:
            push(level - 1, at * FANOUT, min((at + 1) * FANOUT, len(tree.boxes[level - 1][0])))
            continue
        score = (v[rows] @ tree.vectors[at].T).astype(np.int64)
        fits = (tree.labels[at] == anchors["label"][rows, None]) == own_label
        fits &= tree.ids[at] != anchors["id"][rows, None]
        for w in range(best.windows):
            least = np.maximum(floor[rows, w], best.kth[rows, w])
            a, r = np.nonzero(fits & (score >= least[:, None]) & (score <= ceiling[rows, w, None]))
            if len(a):
                best.add(rows[a] * best.windows + w, score[a, r], tree.ids[at][r])


def _searched(pages: DataFrame, block: dict, own_label: bool, k: int, dims: int, kind: type) -> DataFrame:
    """(anchor, window, score, id): what each task keeps for the anchors of a block."""
    sent = pages.sparkSession.sparkContext.broadcast(block)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        all_ = sent.value
        windows = all_["low"].shape[1]
        cuts = range(0, len(all_["id"]), BATCH)
        parts = [{c: x[i:i + BATCH] for c, x in all_.items()} for i in cuts]
        for p in parts:
            p["vector"] = p["vector"].astype(kind)
        bests = [Best(len(p["id"]), windows, k) for p in parts]
        for whole in batches:
            for at in range(0, whole.num_rows, 1024):
                tree = Tree(whole.slice(at, 1024), dims, kind)
                for p, best in zip(parts, bests):
                    search(tree, p, own_label, best)
        for p, best in zip(parts, bests):
            best.settle()
            slot, score, ids = best.hits
            yield pa.RecordBatch.from_arrays(
                [pa.array(p["id"][slot // windows]), pa.array(slot % windows), pa.array(score), pa.array(ids)],
                ["anchor", "window", "score", "id"])

    return pages.mapInArrow(run, "anchor long, window long, score long, id long")


def _first(found: DataFrame, by: list[str], k: int) -> DataFrame:
    """The first ``k`` of each group: higher scores first, then smaller ids."""
    order = Window.partitionBy(*by).orderBy(F.col("score").desc(), "id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


# --- operator -------------------------------------------------------------------------------

def hard_negatives(rows: DataFrame, anchors: Column, id_col: str = "vec_id", vector: str = "embedding",
                   label: Column | None = None, scale: int = SCALE, positives: int = POSITIVES,
                   negatives: int = NEGATIVES, band: tuple[int, int] = BAND, block: int = BLOCK,
                   sample_rows: int = SAMPLE, tile_rows: int = TILE_ROWS,
                   page_rows: int = PAGE_ROWS) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score).

    ``anchors`` is a condition on the column ``id``. Components are floor(``scale`` * x), a
    score is the inner product with the anchor. An anchor's ``positives`` are the best
    other rows of its label; a positive's negatives the best ``negatives`` rows of another
    label with band[0] * positive_score <= 100 * negative_score <= band[1] * positive_score.
    Ties go to smaller ids.

    Edge cases: rows with a null id, label or vector, or a null or non-finite component
    take no part; of rows that share an id the one with the least (label, vector) does;
    shorter vectors count as ending in zeros, empty ones as all zero; huge components
    (beyond about 2^31 / sqrt(length) after scaling) are brought to that; equal vectors
    are told apart by id; an anchor without another row of its label, or a positive with
    an empty window, has no rows; an empty table gives an empty result; other columns of
    ``rows`` play no part.
    """
    stored = quantised(rows, id_col, vector, F.col("label") if label is None else label, scale)
    dims, most = stored.agg(F.max(F.size("q")), F.max(F.array_max(F.transform("q", lambda x: F.abs(x))))).head()
    dims, most = max(dims or 0, 1), most or 0
    # scores of whole numbers are exact in floating point while they fit its mantissa
    top = most * most * dims
    kind = np.float32 if top < 1 << 24 else np.float64 if top < 1 << 53 else np.int64
    pages = r_tree(stored, dims, sample_rows, tile_rows, page_rows)
    asked = persisted(stored.where(anchors))
    blocks = max(1, -(-asked.count() // block))
    asked = asked.withColumn("block", F.pmod(F.xxhash64("id"), F.lit(blocks)))

    out = None
    for i in range(blocks):
        got = asked.where(F.col("block") == i).drop("block").toArrow().combine_chunks()
        one = {"id": got.column("id").to_numpy(), "label": got.column("label").to_numpy(),
               "vector": _dense(got.column("q").combine_chunks(), dims)}
        n = len(one["id"])
        open_ = one | {"low": np.full((n, 1), _LOWEST), "high": np.full((n, 1), _HIGHEST)}
        found = _searched(pages, open_, True, positives, dims, kind)
        best = persisted(_first(found, ["anchor"], positives).select("anchor", "id", "score", "rank"))
        held = best.toArrow()
        row_of = {a: r for r, a in enumerate(one["id"].tolist())}
        at = np.array([row_of[a] for a in held.column("anchor").to_pylist()], np.int64)
        w, score = held.column("rank").to_numpy() - 1, held.column("score").to_pylist()
        low, high = np.full((n, positives), _HIGHEST), np.full((n, positives), _LOWEST)
        low[at, w] = [-((-band[0] * x) // 100) for x in score]
        high[at, w] = [(band[1] * x) // 100 for x in score]
        found = _searched(pages, one | {"low": low, "high": high}, False, negatives, dims, kind)
        mined = _first(found.withColumnRenamed("window", "w"), ["anchor", "w"], negatives)
        side = best.select("anchor", (F.col("rank") - 1).cast("long").alias("w"), F.col("id").alias("positive_id"),
                           F.col("score").alias("positive_score"))
        part = persisted(mined.join(side, ["anchor", "w"]).select(
            F.col("anchor").alias("anchor_id"), "positive_id", "rank", F.col("id").alias("negative_id"),
            "positive_score", F.col("score").alias("negative_score")))
        out = part if out is None else out.unionByName(part)
    return out
