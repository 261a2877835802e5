"""MinHash near-duplicates by an LSH forest, confirmed on whole shingle sets.

1. One pass over the texts gives each document the size of its set of word shingles, a
   128-bit digest of the set and a MinHash signature of ``COLUMNS`` values. Documents of
   equal sets become one node.
2. The forest is a number of sorted orders of the signatures, each over columns of its
   own: order t begins with columns 4t to 4t+3. An order is one range-partitioned sort
   (a crowd of equal prefixes is split by the columns that follow). In it a node's
   candidates are the neighbour it shares the longest prefix with and the head of its
   region, the first row with its first ``DEPTH`` columns. The best of each over all
   orders is confirmed, and linked nodes are contracted: a crowd of near copies becomes
   one component at linear cost.
3. What is left are regions, of equal prefix in an order, that hold several components.
   All pairs across components there are candidates, so that two sets of similarity s are
   missed only if no order has them in one region: (1 - s^4)^24, 2e-8 at 0.85 and less
   above. Depth adapts to the region: one that is still crowded is dealt again over
   orders of twice the depth, and many more of them; the crowds of those meet in pairs
   of chunks. Components with a candidate pair whose sizes and signatures allow the
   similarity are bridged to clusters (a spanning forest of them, never all pairs).
4. The texts of a cluster meet once, and its components' sets are compared exactly. A
   large cluster is cut into chunks that meet in pairs; its largest component does not
   meet itself.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlens.llm.common import persisted, row_key, small
from ledgerlens.llm.graph import components

SHINGLE = 3
SIMILARITY = (85, 100)
COLUMNS = 128
DEPTH = 4
ORDERS = 24
#: Orders of twice the depth for crowded regions: two sets of similarity 0.85 are in no
#: common region of them with a probability of 5e-9.
DEEP_ORDERS = 60
#: A region of more nodes (of several components) is crowded.
REGION_ROWS = 1024
#: Columns that must agree: at a similarity of 0.85 fewer do in 1 of 10 million pairs.
AGREE = 84
#: Shingles of a chunk in which whole sets of a cluster are compared.
CHUNK_SHINGLES = 500_000
#: Cached word hashes of a task.
CACHE = 200_000


# --- sets and signatures -------------------------------------------------------------------

class _WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= CACHE:
            self.clear()
        self[word] = h = xxhash.xxh3_64_intdigest(word)
        return h


def shingle_set(text: str | None, cache: dict, shingle: int) -> np.ndarray:
    """The distinct 64-bit shingle hashes of a text in order; a text of fewer words has
    one, a text without words none."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    h = np.fromiter((cache[w] for w in words), np.uint64, len(words))
    size = min(shingle, len(words))
    n = len(words) - size + 1
    x = np.full(n, size, np.uint64)
    for i in range(size):  # mixed after each word, so that its place counts
        x = (x ^ h[i:i + n]) * np.uint64(0x9E3779B97F4A7C15)
        x ^= x >> np.uint64(32)
    return np.unique(x)


_FACTORS = (np.random.default_rng(7).integers(0, 1 << 31, COLUMNS, np.uint32) << np.uint32(1) | np.uint32(1))[:, None]


def signature(hashes: np.ndarray) -> np.ndarray:
    """16 bits of the least value of each of ``COLUMNS`` permutations of a set."""
    least = np.full(COLUMNS, 0xFFFFFFFF, np.uint32)
    short = (hashes >> np.uint64(32)).astype(np.uint32)
    for i in range(0, len(short), 2048):
        np.minimum(least, (short[None, i:i + 2048] * _FACTORS).min(1), out=least)
    # the least value's high bits are near zero: mixed, so that 16 bits tell values apart
    return ((least * np.uint32(0x9E3779B1)) >> np.uint32(16)).astype(np.uint16)


def sketches(keyed: DataFrame, id_col: str, text: str, shingle: int) -> DataFrame:
    """(doc_id, _k1, _k2, n, s1, s2, sig) of every row, in one pass over the texts."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = _WordHashes()
        for b in batches:
            sizes, sums, sigs = [], [], []
            for t in b.column(3):
                s = shingle_set(t.as_py(), cache, shingle)
                sizes.append(len(s))
                sums.append(xxhash.xxh3_128_digest(s.tobytes()))
                sigs.append(signature(s).tobytes() if len(s) else None)
            two = np.frombuffer(b"".join(sums), np.int64).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays(
                [*b.columns[:3], pa.array(sizes, pa.int64()), pa.array(two[:, 0]), pa.array(two[:, 1]),
                 pa.array(sigs, pa.binary())], ["doc_id", "_k1", "_k2", "n", "s1", "s2", "sig"])

    rows = keyed.select(F.col(id_col).cast("long").alias("doc_id"), "_k1", "_k2", F.col(text).alias("text"))
    return rows.mapInArrow(run, "doc_id long, _k1 long, _k2 long, n long, s1 long, s2 long, sig binary")


def _matrix(sigs: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(sigs.to_pylist()), np.uint16).reshape(-1, COLUMNS)


# --- orders --------------------------------------------------------------------------------

def orders(depth: int, count: int) -> np.ndarray:
    """The leading 2 * ``DEPTH`` columns of each order.

    At ``DEPTH`` each order begins with columns of its own; deeper orders draw them.
    """
    rng = np.random.default_rng(depth)
    if depth == DEPTH:
        return np.array([[(DEPTH * t + i) % COLUMNS for i in range(2 * DEPTH)] for t in range(count)])
    return np.array([rng.permutation(COLUMNS)[:2 * DEPTH] for _ in range(count)])


def deal(nodes: DataFrame, depth: int, count: int, *keep: str) -> DataFrame:
    """(t, key, more, node) and ``keep`` (whole numbers): a row per node and order. ``key``
    stands for the first ``depth`` columns in the order, ``more`` for the columns after
    the first four."""
    lead = orders(depth, count)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 2000):
                b = whole.slice(at, 2000)
                cols = _matrix(b.column(0))[:, lead]  # rows, orders, leading columns
                both = np.ascontiguousarray(cols.astype(">u2")).view(">i8").astype(np.int64)
                key, more = both[..., 0], both[..., 1]
                if depth > DEPTH:  # both halves in one number
                    key = key * np.int64(-7046029254386353131) ^ more
                    more = np.zeros_like(key)
                n = b.num_rows
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.tile(np.arange(count, dtype=np.int32), n)), pa.array(key.reshape(-1)),
                     pa.array(more.reshape(-1)),
                     *[pa.array(np.repeat(c.to_numpy(), count)) for c in b.columns[1:]]],
                    ["t", "key", "more", "node", *keep])

    return nodes.select("sig", "node", *keep).mapInArrow(
        run, ", ".join(["t int, key long, more long, node long", *[f"{c} long" for c in keep]]))


def neighbours(dealt: DataFrame) -> DataFrame:
    """(a, b, kind): each node's best neighbour (0) and least region head (1) over the orders."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: np.ndarray | None = None  # the last row seen, and its region's head
        for b in batches:
            if b.num_rows == 0:
                continue
            t, key, more, node = (c.to_numpy().astype(np.int64) for c in b.columns)
            head = np.full(len(t), -1)
            if last is not None:
                t, key, more, node, head = (np.concatenate([[v], x]) for v, x in zip(last, (t, key, more, node, head)))
            same = (t[1:] == t[:-1]) & (key[1:] == key[:-1])
            starts = np.concatenate([[True], ~same])
            at = np.maximum.accumulate(np.where(starts, np.arange(len(t)), 0))
            known = node[at]
            if last is not None:  # the first region goes on from the batch before
                known[at == 0] = head[0]
            last = np.array([t[-1], key[-1], more[-1], node[-1], known[-1]])
            i = np.flatnonzero(same) + 1
            shared = np.zeros(len(i), np.int64)
            differ = (more[i] ^ more[i - 1]).view(np.uint64)
            for k in (48, 32, 16, 0):
                shared += (differ >> np.uint64(k)) == 0
            prev = i - 1
            hubs = i[known[i] != node[i]]
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.concatenate([node[i], node[prev], node[hubs]])),
                 pa.array(np.concatenate([node[prev], node[i], known[hubs]])),
                 pa.array(np.concatenate([shared, shared, np.full(len(hubs), -1)]))], ["a", "b", "lcp"])

    # in range partitions a crowd of equal prefixes goes to several tasks; a pair on the
    # edge of two partitions is met by the regions later
    sort = ["t", "key", "more", "node"]
    found = dealt.select(*sort).repartitionByRange(*sort).sortWithinPartitions(*sort).mapInArrow(
        run, "a long, b long, lcp long").where("a != b")
    best = found.groupBy("a").agg(
        F.max(F.when(F.col("lcp") >= 0, F.struct("lcp", (-F.col("b")).alias("b")))).alias("near"),
        F.min(F.when(F.col("lcp") < 0, F.col("b"))).alias("head"))
    both = F.array(F.struct((-F.col("near.b")).alias("b")), F.struct(F.col("head").alias("b")))
    return _pairs(best.select("a", F.inline(both)))


def _pairs(df: DataFrame) -> DataFrame:
    """Each unordered pair once, the smaller node as ``b``."""
    return df.where("b is not null and a != b").select(
        F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()


# --- regions of several components ------------------------------------------------------------

class _Groups(dict):
    """Disjoint sets: the root of each member met."""

    def root(self, x: int) -> int:
        while (up := self.get(x, x)) != x:
            self[x] = x = self.get(up, up)
        return x

    def unite(self, x: int, y: int) -> bool:
        x, y = self.root(x), self.root(y)
        self[max(x, y)] = min(x, y)
        return x != y


def _possible(i: int, others: np.ndarray, size: np.ndarray, sig: np.ndarray, ratio: tuple[int, int],
              agree: int) -> np.ndarray:
    """Those of ``others`` whose size and signature allow the similarity to row ``i``."""
    num, den = ratio
    low, high = np.minimum(size[i], size[others]), np.maximum(size[i], size[others])
    others = others[low * den >= num * high]
    return others[(sig[others] == sig[i]).sum(1) >= agree] if len(others) else others


def _bridges(comp: np.ndarray, size: np.ndarray, sig: np.ndarray, ratio: tuple[int, int],
             agree: int) -> list[tuple[int, int]]:
    """Pairs of components that may be linked, as many as connect all that may."""
    met, out = _Groups(), []
    names, local = np.unique(comp, return_inverse=True)
    for i in range(len(comp) - 1):
        roots = np.array([met.root(c) for c in range(len(names))])[local]
        rest = np.flatnonzero(roots[i + 1:] != roots[i]) + i + 1
        for c in np.unique(local[_possible(i, rest, size, sig, ratio, agree)]).tolist():
            if met.unite(int(local[i]), c):
                out.append((int(comp[i]), int(names[c])))
        if not len(rest) and len(set(roots)) == 1:
            break
    return out


def across(rows: DataFrame, keys: list[str], ratio: tuple[int, int], agree: int) -> DataFrame:
    """Pairs of components (a, b) that some region of ``rows`` may link."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list = []
        mark = None
        for b in batches:
            if b.num_rows == 0:
                continue
            region = b.column(0).to_numpy()
            cols = [b.column(1).to_numpy(), b.column(2).to_numpy(), _matrix(b.column(3))]
            cut = [0, *(np.flatnonzero(region[1:] != region[:-1]) + 1).tolist(), len(region)]
            out = []
            for s, e in zip(cut, cut[1:]):
                if region[s] != mark:
                    out += _found(held)
                    held, mark = [], region[s]
                held.append([c[s:e] for c in cols])
            yield _pair_batch(out)
        yield _pair_batch(_found(held))

    def _found(held: list) -> list[tuple[int, int]]:
        return _bridges(*(np.concatenate(c) for c in zip(*held)), ratio, agree) if held else []

    ordered = rows.repartition(*keys).sortWithinPartitions(*keys, "node")
    return _pairs(ordered.select(F.xxhash64(*keys).alias("region"), "comp", "n", "sig").mapInArrow(
        run, "a long, b long"))


def _pair_batch(pairs: list[tuple[int, int]]) -> pa.RecordBatch:
    a, b = list(zip(*pairs)) or ((), ())
    return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])


def bridges(nodes: DataFrame, ratio: tuple[int, int], agree: int, region_rows: int) -> DataFrame:
    """Pairs of components of ``nodes`` (node, comp, n, sig) that their regions may link; those
    that do not come up as a pair are connected through others."""
    found = []
    plan = [(DEPTH, ORDERS), (2 * DEPTH, DEEP_ORDERS)]
    sigs = nodes.select("node", "n", "sig")
    todo = nodes
    for depth, count in plan:
        dealt = deal(todo, depth, count, "comp").drop("more")
        sizes = persisted(dealt.groupBy("t", "key").agg(
            F.count(F.lit(1)).alias("size"), F.min("comp").alias("lo"), F.max("comp").alias("hi")
        ).where("lo != hi").select("t", "key", "size"))
        mixed = persisted(dealt.join(small(sizes), ["t", "key"]))
        crowd = mixed.where(F.col("size") > region_rows)
        fine = mixed.where(F.col("size") <= region_rows)
        found.append(across(fine.join(sigs, "node"), ["t", "key"], ratio, agree))
        if crowd.isEmpty():
            break
        if depth == plan[-1][0]:  # the exact way for what is crowded at any depth
            chunks = F.ceil(F.col("size") / (region_rows // 2)).cast("int")
            cut = crowd.withColumn("k", chunks).withColumn("c", F.pmod(F.xxhash64("node"), F.col("k")).cast("int"))
            paired = cut.withColumn("j", F.explode(F.sequence(F.lit(0), F.col("k") - 1))).select(
                "t", "key", "node", "comp", F.least("c", "j").alias("lo"), F.greatest("c", "j").alias("hi"))
            found.append(across(paired.join(sigs, "node"), ["t", "key", "lo", "hi"], ratio, agree))
        todo = persisted(crowd.select("node").distinct().join(nodes, "node"))
    out = found[0]
    for f in found[1:]:
        out = out.unionByName(f)
    return out.distinct()


# --- confirmation ----------------------------------------------------------------------------

def promising(pairs: DataFrame, nodes: DataFrame, ratio: tuple[int, int], agree: int) -> DataFrame:
    """The pairs whose sizes and signatures allow the similarity."""
    num, den = ratio

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            same = (_matrix(b.column(2)) == _matrix(b.column(3))).sum(1) >= agree if b.num_rows else np.zeros(0, bool)
            yield pa.RecordBatch.from_arrays([b.column(i).filter(pa.array(same)) for i in (0, 1)], ["a", "b"])

    side = nodes.select("node", "n", "sig")
    met = pairs.join(side.toDF("a", "na", "sa"), "a").join(side.toDF("b", "nb", "sb"), "b")
    sized = met.where(F.least("na", "nb") * den >= num * F.greatest("na", "nb"))
    return sized.select("a", "b", "sa", "sb").mapInArrow(run, "a long, b long")


def bodies(need: DataFrame, nodes: DataFrame, docs: DataFrame, text: str, repeated: bool) -> DataFrame:
    """(node, text) of the nodes in ``need``, stored. ``docs`` has row keys, ``nodes`` names
    one row of each node; ``repeated`` tells that some rows share their key."""
    rows = small(persisted(nodes.select("node", "_k1", "_k2").join(need, "node")))
    out = docs.select("_k1", "_k2", F.col(text).alias("text")).join(rows, ["_k1", "_k2"]).select("node", "text")
    return persisted(out.dropDuplicates(["node"]) if repeated else out)


def confirmed(pairs: DataFrame, texts: DataFrame, shingle: int, ratio: tuple[int, int]) -> DataFrame:
    """The pairs (a, b) whose whole sets have the similarity."""
    num, den = ratio

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = _WordHashes()
        last, right = None, None
        for batch in batches:
            out = []
            for a, b, left_text, right_text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(),
                                                   batch.column(2), batch.column(3)):
                if b != last:
                    last, right = b, shingle_set(right_text.as_py(), cache, shingle)
                left = shingle_set(left_text.as_py(), cache, shingle)
                both = np.concatenate([left, right])
                both.sort()
                shared = int(np.count_nonzero(both[1:] == both[:-1]))
                if den * shared >= num * (len(both) - shared):
                    out.append((a, b))
            yield _pair_batch(out)

    met = pairs.join(texts.toDF("a", "ta"), "a").join(texts.toDF("b", "tb"), "b")
    return met.select("a", "b", "ta", "tb").mapInArrow(run, "a long, b long")


def _linked(rows: list, shingle: int, cache: dict, ratio: tuple[int, int], agree: int) -> list[tuple[int, int]]:
    """Links between the components of a group, as many as connect all that are linked.

    ``rows`` are (node, comp, n, chunk, sig, text); those of the lower chunk meet all others.
    """
    num, den = ratio
    node, comp, size, chunk = (np.array(c) for c in list(zip(*rows))[:4])
    sig = np.frombuffer(b"".join(r[4] for r in rows), np.uint16).reshape(-1, COLUMNS)
    sets = [shingle_set(r[5], cache, shingle) for r in rows]
    # shingles numbered inside the group, so that a set is a list of places in one array
    names, local = np.unique(np.concatenate(sets), return_inverse=True)
    ends = np.cumsum([len(x) for x in sets])
    sets = np.split(local, ends[:-1])
    mark = np.zeros(len(names), np.int64)
    met, out = _Groups(), []
    for i in np.flatnonzero(chunk == chunk.min()).tolist():
        mine = met.root(int(comp[i]))
        rest = np.array([j for j in range(len(rows)) if (j > i or chunk[j] != chunk[i])
                         and met.root(int(comp[j])) != mine], np.int64)
        rest = _possible(i, rest, size, sig, ratio, agree)
        mark[sets[i]] = 1
        for j in rest.tolist():
            if met.root(int(comp[j])) != met.root(int(comp[i])):
                shared = int(mark[sets[j]].sum())
                if den * shared >= num * (int(size[i]) + int(size[j]) - shared):
                    met.unite(int(comp[i]), int(comp[j]))
                    out.append((int(node[i]), int(node[j])))
        mark[sets[i]] = 0
    return out


def linked(nodes: DataFrame, cluster_of: DataFrame, docs: DataFrame, all_nodes: DataFrame, text: str, shingle: int,
           ratio: tuple[int, int], agree: int, chunk_shingles: int, repeated: bool) -> DataFrame:
    """Links (a, b) across the components of each cluster, by comparing whole sets.

    A cluster's largest component (its bulk) need not meet itself: the other nodes' chunks
    meet each other and the chunks of the bulk. Chunks hold about ``chunk_shingles``.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = _WordHashes()
        held: list = []
        mark = None
        for b in batches:
            out = []
            for group, *row in zip(*(c.to_pylist() for c in b.columns)):
                if group != mark:
                    out += _linked(held, shingle, cache, ratio, agree) if held else []
                    held, mark = [], group
                held.append(row)
            yield _pair_batch(out)
        yield _pair_batch(_linked(held, shingle, cache, ratio, agree) if held else [])

    inside = persisted(nodes.select("node", "comp", "n").join(cluster_of, "comp"))
    comps = inside.groupBy("cluster", "comp").agg(F.sum("n").alias("total"))
    per = comps.groupBy("cluster").agg(F.max_by("comp", F.struct("total", "comp")).alias("bulk"),
                                       F.sum("total").alias("all"), F.max("total").alias("most"))
    per = persisted(per.select(
        "cluster", "bulk", F.ceil((F.col("all") - F.col("most")) / chunk_shingles).alias("ko"),
        F.ceil(F.col("most") / chunk_shingles).alias("kb")))
    own = F.col("comp") != F.col("bulk")
    placed = inside.join(per, "cluster").withColumn("chunk", F.when(own, F.pmod(F.xxhash64("node"), "ko")).otherwise(
        F.col("ko") + F.pmod(F.xxhash64("node"), F.col("kb"))))
    partners = F.sequence(F.lit(0).cast("long"), F.when(own, F.col("ko") + F.col("kb")).otherwise(F.col("ko")) - 1)
    grouped = placed.withColumn("j", F.explode(partners)).select(
        "node", "comp", "n", "chunk", "cluster", F.least("chunk", "j").alias("lo"), F.greatest("chunk", "j").alias("hi"))
    texts = bodies(inside.select("node"), all_nodes, docs, text, repeated)
    full = grouped.join(texts.join(nodes.select("node", "sig"), "node"), "node")
    ordered = full.repartition("cluster", "lo", "hi").sortWithinPartitions("cluster", "lo", "hi", "node")
    group = F.xxhash64("cluster", "lo", "hi").alias("g")
    return ordered.select(group, "node", "comp", "n", "chunk", "sig", "text").mapInArrow(run, "a long, b long")


# --- operator --------------------------------------------------------------------------------

def near_copies(docs: DataFrame, id_col: str = "doc_id", text: str = "text", shingle: int = SHINGLE,
                ratio: tuple[int, int] = SIMILARITY, agree: int = AGREE,
                region_rows: int = REGION_ROWS, chunk_shingles: int = CHUNK_SHINGLES) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) of every row of ``docs``.

    Two documents are linked if their sets of lower-cased (A-Z) word shingles have
    ``ratio[1]`` * intersection >= ``ratio[0]`` * union; ``component_id`` is the smallest
    doc_id reachable, ``kept`` marks the rows that bear it.

    Edge cases: null, empty and blank texts have an empty set, are linked with nothing
    and are kept; a text of fewer words than a shingle is one shingle; repeated rows and
    equal ids come back one by one; a null id is never the smallest: a component of null
    ids only has a null component_id, and its rows are kept; an empty table gives an empty
    result; other columns of ``docs`` play no part. Shingles are told apart by 64 bits,
    sets by 128.
    """
    keyed = row_key(docs.select(id_col, text), id_col, text)
    of_doc = persisted(sketches(keyed, id_col, text, shingle))
    nodes = persisted(of_doc.where("n > 0").groupBy("s1", "s2").agg(
        F.max("n").alias("n"), F.max("sig").alias("sig"), F.min("doc_id").alias("least_id"),
        F.min(F.struct("_k1", "_k2")).alias("row")).select(
        "s1", "s2", "n", "sig", "least_id", "row._k1", "row._k2",
        F.monotonically_increasing_id().alias("node")))
    repeated = not of_doc.groupBy("_k1", "_k2").agg(F.count(F.lit(1)).alias("c")).where("c > 1").isEmpty()

    tried = persisted(promising(neighbours(deal(nodes, DEPTH, ORDERS)), nodes, ratio, agree))
    ends = tried.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    links = persisted(confirmed(tried, bodies(ends, nodes, keyed, text, repeated), shingle, ratio))
    first = components(links).withColumnRenamed("root", "comp")
    placed = persisted(nodes.select("node", "n", "sig").join(first, "node", "left").withColumn(
        "comp", F.coalesce("comp", "node")))
    clusters = components(persisted(bridges(placed, ratio, agree, region_rows))).toDF("comp", "cluster")
    links = persisted(links.unionByName(linked(
        placed, persisted(clusters), keyed, nodes, text, shingle, ratio, agree, chunk_shingles, repeated)))

    roots = components(links)
    rooted = nodes.select("s1", "s2", "node", "least_id").join(roots, "node", "left").withColumn(
        "root", F.coalesce("root", "node"))
    # stored, so that the rows of a large component or group of copies can be split
    least = persisted(rooted.groupBy("root").agg(F.min("least_id").alias("component_id")))
    group_of = persisted(rooted.join(least, "root").select("s1", "s2", "component_id"))
    some = of_doc.where("n > 0").join(group_of, ["s1", "s2"]).select("doc_id", "n", "component_id")
    none = of_doc.where("n = 0").select("doc_id", "n", F.col("doc_id").alias("component_id"))
    return some.unionByName(none).select(
        "doc_id", F.col("n").alias("n_shingles"), "component_id",
        F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))
