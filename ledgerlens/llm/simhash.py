"""SimHash near-duplicates by bit-sliced comparison.

1. One pass over the texts gives each document a 64-bit fingerprint of its word shingles.
2. Distinct fingerprints are dealt to buckets: the 64 bits are cut into blocks, and each
   choice of ``keep`` blocks is a table keyed by those blocks' bits. With blocks - keep =
   radius, any two fingerprints within the radius agree on all blocks of some choice, so
   no pair is missed. More blocks are cut for more fingerprints, which keeps the buckets
   small at any size; buckets that are large all the same (a crowd of near copies) are
   dealt again by finer tables, and at the finest split into pairs of chunks.
3. In a bucket the fingerprints' bits are stored vertically, 64 fingerprints to a word. A
   query meets 64 others at once: the planes' differences are added three at a time into
   bitwise counters (carry-save adders), and a block is abandoned once all of its lanes
   are over the radius. A bucket yields a spanning forest, never all its pairs.
4. Connected components of the links are found by star contraction in DataFrames.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlens.llm.common import packed, persisted, row_key, small, unpacked
from ledgerlens.llm.graph import components

SEED = 42
SHINGLE = 4
RADIUS = 4
#: A bucket of more fingerprints is dealt again by finer tables.
BUCKET_ROWS = 4096
ONES = np.uint64(0xFFFFFFFFFFFFFFFF)


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """Signed 64-bit SimHash of the word shingles; 0 for a text without words."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    n = len(words)
    if n == 0:
        return 0
    joined = b" ".join(words)
    digest = xxhash.xxh64_intdigest
    if n <= shingle:
        hashes = [digest(joined, SEED)]
    else:
        ends = list(itertools.accumulate(len(w) + 1 for w in words))
        starts = [0, *ends[:n - shingle]]
        hashes = [digest(joined[a:b - 1], SEED) for a, b in zip(starts, ends[shingle - 1:])]
    ones, values = np.zeros(64, np.int64), np.array(hashes, ">u8")
    for i in range(0, len(values), 65536):
        part = values[i:i + 65536]
        ones += np.unpackbits(part.view(np.uint8)).reshape(len(part), 64).sum(0, dtype=np.int64)
    bits = np.packbits(ones * 2 > len(values))
    return int(bits.view(">i8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text: str = "text",
                 shingle: int = SHINGLE, keys: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, fp) of every row, in one pass over the texts; ``keys``, columns of whole
    numbers, come along."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = [fingerprint(t.as_py(), shingle) for t in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fps, pa.int64()), *b.columns[2:]],
                                             ["doc_id", "fp", *keys])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text).alias("text"), *keys)
    return rows.mapInArrow(run, ", ".join(["doc_id long", "fp long", *[f"{c} long" for c in keys]]))


# --- buckets ---------------------------------------------------------------------------

def block_masks(blocks: int, keep: int) -> list[int]:
    """One signed 64-bit mask per choice of ``keep`` of ``blocks`` runs of bits."""
    cuts = [round(i * 64 / blocks) for i in range(blocks + 1)]
    runs = [((1 << (b - a)) - 1) << a for a, b in zip(cuts, cuts[1:])]
    masks = [sum(c) for c in itertools.combinations(runs, keep)]
    return [m - (1 << 64) if m >> 63 else m for m in masks]


def _keyed(fps: DataFrame, blocks: int, radius: int) -> DataFrame:
    masks = block_masks(blocks, blocks - radius)
    keys = F.array(*[F.struct(F.lit(i).alias("t"), F.col("fp").bitwiseAND(F.lit(m)).alias("key"))
                     for i, m in enumerate(masks)])
    return fps.select("fp", F.inline(keys))


def first_blocks(n: int, radius: int = RADIUS) -> int:
    """Blocks so that a table's key has at least log2(n) - 3 bits."""
    blocks = radius + 1
    while blocks < 12 and 64 * (blocks - radius) / blocks < math.log2(max(n, 2)) - 3:
        blocks += 1
    return max(blocks, radius + 2)


def links(fps: DataFrame, n: int, radius: int = RADIUS, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """Edges (a, b) that connect all fingerprints within ``radius`` of each other.

    ``fps`` holds each fingerprint once; ``n`` is their number.
    """
    found, blocks = [], first_blocks(n, radius)
    while True:
        keyed = _keyed(fps, blocks, radius)
        sizes = keyed.groupBy("t", "key").agg(F.count(F.lit(1)).alias("size"))
        hot = persisted(sizes.where(F.col("size") > bucket_rows))
        if hot.isEmpty():
            found.append(_compare(keyed, ["t", "key"], radius))
            break
        hot_side = small(hot)
        found.append(_compare(keyed.join(hot_side, ["t", "key"], "left_anti"), ["t", "key"], radius))
        crowd = keyed.join(hot_side, ["t", "key"])
        if blocks < 12:
            # pairs of a hot bucket meet again in the finer tables over its members
            fps = persisted(crowd.select("fp").distinct())
            blocks = max(blocks + 2, 8)
            continue
        chunks = F.ceil(F.col("size") / (bucket_rows // 2)).cast("int")
        dealt = crowd.withColumn("k", chunks).withColumn(
            "c", F.pmod(F.xxhash64("fp"), F.col("k")).cast("int"))
        paired = dealt.withColumn("j", F.explode(F.sequence(F.lit(0), F.col("k") - 1))).select(
            "fp", "t", "key", F.least("c", "j").alias("lo"), F.greatest("c", "j").alias("hi"))
        found.append(_compare(paired, ["t", "key", "lo", "hi"], radius))
        break
    out = found[0]
    for f in found[1:]:
        out = out.unionByName(f)
    return out


def _compare(keyed: DataFrame, keys: list[str], radius: int) -> DataFrame:
    """Edges within each bucket of ``keyed``; buckets lie together in sorted partitions."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        last = None
        for b in batches:
            if b.num_rows == 0:
                continue
            bucket = b.column(0).to_numpy(zero_copy_only=False)
            fp = b.column(1).to_numpy(zero_copy_only=False).view(np.uint64)
            cut = np.flatnonzero(bucket[1:] != bucket[:-1]) + 1
            parts = np.split(fp, cut)
            if held and bucket[0] == last:
                parts[0] = np.concatenate([held.pop(), parts[0]])
            full, held, last = [*held, *parts[:-1]], [parts[-1]], bucket[-1]
            yield _edges(full, radius)
        yield _edges(held, radius)

    # a bucket's key as one number to cut by; rows sort by the true key
    ordered = keyed.repartition(*keys).sortWithinPartitions(*keys, "fp")
    mark = F.xxhash64(*keys).alias("bucket")
    return ordered.select(mark, "fp").mapInArrow(run, "a long, b long").distinct()


def _edges(groups: list[np.ndarray], radius: int) -> pa.RecordBatch:
    pairs = spanning_links(groups, radius)
    a, b = (np.array([p[i] for p in pairs], np.uint64).view(np.int64) for i in (0, 1))
    return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])


# --- bit-sliced comparison ----------------------------------------------------------------

def spanning_links(groups: list[np.ndarray], radius: int) -> list[tuple[int, int]]:
    """For each group of fingerprints, links that connect its members within ``radius``."""
    groups = [g for g in groups if len(g) > 1]
    out: list[tuple[int, int]] = []
    at = 0
    while at < len(groups):  # some groups at a time: bounded rows of (query, word of 64 lanes)
        rows, to = 0, at
        while to < len(groups) and (rows == 0 or rows < 200_000):
            rows += len(groups[to]) * -(-len(groups[to]) // 64)
            to += 1
        out += _links_of(groups[at:to], radius)
        at = to
    return out


def _links_of(groups: list[np.ndarray], radius: int) -> list[tuple[int, int]]:
    planes, valid, first_word = _planes(groups)
    queries, word_of, group_of, spans = [], [], [], []
    row = 0
    for g, fps in enumerate(groups):
        n_words = -(-len(fps) // 64)
        queries.append(np.repeat(fps, n_words))
        word_of.append(np.tile(np.arange(first_word[g], first_word[g] + n_words), len(fps)))
        spans.append((row, len(fps), n_words))
        row += len(fps) * n_words
        group_of.append(g)
    near = within(planes, valid, np.concatenate(queries), np.concatenate(word_of), radius)
    out: list[tuple[int, int]] = []
    for fps, (start, n, n_words) in zip(groups, spans):
        hits = near[start:start + n * n_words].reshape(n, n_words)
        # every lane meets itself; more set bits mean a neighbour
        busy = np.bitwise_count(hits).sum(1) > 1
        if busy.any():
            out += _forest(fps, hits, busy)
    return out


def _planes(groups: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, list[int]]:
    """Bit planes (64, words), the used lanes of each word, and each group's first word."""
    first_word, total = [], 0
    for fps in groups:
        first_word.append(total)
        total += -(-len(fps) // 64)
    lanes, valid = np.zeros((total, 64), np.uint64), np.zeros((total, 64), np.uint8)
    for w, fps in zip(first_word, groups):
        lanes[w:].reshape(-1)[:len(fps)] = fps
        valid[w:].reshape(-1)[:len(fps)] = 1
    planes = np.empty((64, total), np.uint64)
    for bit in range(64):
        planes[bit] = _pack(((lanes >> np.uint64(bit)) & np.uint64(1)).astype(np.uint8))
    return planes, _pack(valid), first_word


def _pack(bits: np.ndarray) -> np.ndarray:
    return np.packbits(bits, axis=1, bitorder="little").view("<u8").reshape(-1)


def within(planes: np.ndarray, valid: np.ndarray, queries: np.ndarray, word_of: np.ndarray,
           radius: int) -> np.ndarray:
    """For each (query, word) row, the lanes whose distance is at most ``radius``.

    Bitwise counters c1, c2, c4, c8 hold every lane's distance so far and ``over`` the
    lanes beyond the radius. Planes are added three at a time: a carry-save adder turns
    three differences into a sum and a carry. Rows are abandoned once no lane is left.
    """
    out = np.zeros(len(queries), np.uint64)
    rows = np.arange(len(queries))
    c = [np.zeros(len(queries), np.uint64) for _ in range(3)]
    over = ~valid[word_of]
    for start in range(0, 64, 6):
        for bit in range(start, min(start + 6, 64), 3):
            x = [planes[k][word_of] ^ (-((queries >> np.uint64(k)) & np.uint64(1)).view(np.int64)).view(np.uint64)
                 for k in range(bit, min(bit + 3, 64))]
            if len(x) == 3:
                half = x[0] ^ x[1]
                ones, twos = half ^ x[2], (x[0] & x[1]) | (half & x[2])
            else:
                ones, twos = x[0], np.zeros_like(x[0])
            carry = c[0] & ones
            c[0] ^= ones
            # add two numbers of weight two: the carry and the adder's twos
            both = carry & twos
            single = carry ^ twos
            spill = c[1] & single
            c[1] ^= single
            four = both | spill
            over |= c[2] & four  # eight or more
            c[2] ^= four
        over |= _above(c, radius)
        alive = over != ONES
        if not alive.all():
            rows, queries, word_of, over = rows[alive], queries[alive], word_of[alive], over[alive]
            c = [y[alive] for y in c]
            if not len(rows):
                return out
    out[rows] = ~over
    return out


def _above(c: list[np.ndarray], radius: int) -> np.ndarray:
    """Lanes whose three-bit counter is above ``radius`` (at most 7)."""
    above, equal = np.zeros_like(c[0]), np.full_like(c[0], ONES)
    for k in (2, 1, 0):
        if radius >> k & 1:
            equal &= c[k]
        else:
            above |= equal & c[k]
            equal &= ~c[k]
    return above


def _forest(fps: np.ndarray, hits: np.ndarray, busy: np.ndarray) -> list[tuple[int, int]]:
    """Links from each component's first member to the others, by bitset search."""
    out: list[tuple[int, int]] = []
    seen = np.zeros(hits.shape[1], np.uint64)
    for root in np.flatnonzero(busy):
        if int(seen[root >> 6]) >> int(root & 63) & 1:
            continue
        frontier, group = np.array([root]), np.zeros_like(seen)
        group[root >> 6] |= np.uint64(1 << int(root & 63))
        while len(frontier):
            new = np.bitwise_or.reduce(hits[frontier], axis=0) & ~group
            group |= new
            frontier = np.flatnonzero(np.unpackbits(new.view(np.uint8), bitorder="little"))
        seen |= group
        members = np.flatnonzero(np.unpackbits(group.view(np.uint8), bitorder="little"))
        out += [(int(fps[root]), int(fps[m])) for m in members if m != root]
    return out


# --- operator ---------------------------------------------------------------------------

def hex16(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text: str = "text",
                    shingle: int = SHINGLE, radius: int = RADIUS) -> DataFrame:
    """(doc_id, fingerprint, component_id) of every row of ``docs``.

    ``component_id`` is the smallest doc_id reachable over fingerprints that differ in at
    most ``radius`` bits.

    Edge cases: null, empty and blank texts have fingerprint 0 and link like any other;
    texts of fewer words than a shingle have one hash; repeated rows and equal ids come
    back one by one; a null id is never the smallest (a component of null ids only has a
    null component_id); an empty table gives an empty result.
    """
    of_doc = persisted(fingerprints(docs, id_col, text, shingle))
    fps = persisted(of_doc.groupBy("fp").agg(F.min("doc_id").alias("least_id")))
    edges = links(fps.select("fp"), fps.count(), radius)
    roots = components(edges).withColumnRenamed("node", "fp")
    rooted = fps.join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    # stored, so that a large component can be split over tasks in the join
    least = persisted(rooted.groupBy("root").agg(F.min("least_id").alias("component_id")))
    group_of = rooted.select("fp", "root").join(least, "root").select("fp", "component_id")
    return of_doc.join(group_of, "fp").select(
        "doc_id", hex16(F.col("fp")).alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text: str = "text",
             shingle: int = SHINGLE, radius: int = RADIUS) -> DataFrame:
    """``docs`` with one row of each near-duplicate group: that of its smallest id, and of
    several texts with that id the one with the least row key.

    Rows are told apart by id and text, so a row that shares an id with a copy stays if its
    own text is nobody's. Of a group's rows without an id one stays too; of rows equal in id
    and text one stays. Only the keys of rows that go are joined to the texts.

    Edge cases: null, empty and blank texts are one group; texts of any length are read
    whole; nulls in other columns are kept; columns of any name come back as they are; an
    empty table gives an empty result.
    """
    rows = row_key(packed(docs, id_col, text), "doc_id", "text")
    of_row = persisted(fingerprints(rows, "doc_id", "text", shingle, ("_k1", "_k2")))
    least = F.min(F.struct("doc_id", "_k1", "_k2")).alias("least")
    no_id = F.col("doc_id").isNull().alias("no_id")
    by_fp = persisted(of_row.groupBy("fp", no_id).agg(least))
    fps = persisted(by_fp.select("fp").distinct())
    roots = components(links(fps, fps.count(), radius)).withColumnRenamed("node", "fp")
    rooted = by_fp.join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    stay = persisted(rooted.groupBy("root", "no_id").agg(F.min("least").alias("least")).select("least._k1", "least._k2"))
    keys = ["_k1", "_k2"]
    times = persisted(of_row.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")))
    gone = persisted(times.join(stay, keys, "left_anti").select(*keys))
    out = rows.join(small(gone), keys, "left_anti")
    twice = persisted(times.where("n > 1").join(stay, keys, "left_semi").select(*keys))
    if twice.isEmpty():
        return unpacked(out)
    return unpacked(out.join(small(twice), keys, "left_anti").unionByName(
        out.join(small(twice), keys, "left_semi").dropDuplicates(keys)))
