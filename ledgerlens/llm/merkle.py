"""Merkle manifest of a dataset: a digest tree per source, and one over the sources.

Leaves are the digests of whole rows. A tree has ``fanout`` children to a node, the last
run of a level may be shorter. Levels are tables of (tree, n, idx, digest), n being the
nodes of that tree's level:

1. Leaves get their place inside the source by a range-partitioned sort: a row number in
   (partition, source) and the counts of the partitions before it, so that a source of a
   third of all rows is never gathered.
2. Sibling shift: the slot-zero node of each run computes the indices of its siblings (XOR 1
   in a binary tree, slot offsets otherwise) and meets them in an equijoin on (tree, index).
   It then emits the parent: the digest of the run, and the run itself.
3. Paths go down the same levels: a node joins its parent's row on the parent's index and
   puts the digests left and right of its own slot before the parent's path. Only levels
   above the leaves are stored with their paths (one row to ``fanout`` children).

A proof is the digest of a path; folding a leaf's digest up its path gives the root that
this leaf stands for. A manifest can so be checked leaf by leaf without the other rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerlens.llm.common import lower_ascii, persisted, small
from ledgerlens.operators.ranking import global_positions

FANOUT = 16
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
_LOW_BITS = 33  # monotonically_increasing_id: partition index << 33 | row index
_PATH = "array<struct<l: string, r: string>>"


def field(value: Column) -> Column:
    """``-`` for null, else the UTF-8 byte count, a colon and the value."""
    text = value.cast("string")
    return F.when(value.isNull(), F.lit("-")).otherwise(
        F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def row_digest(values: list[Column]) -> Column:
    return F.sha2(F.concat(*[field(v) for v in values]), 256)


# --- places ------------------------------------------------------------------------------

def _placed(leaves: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(leaves with tree, n and idx; one row per source with its tree, n and the source).

    Trees are numbered in the order of the sources, null first.
    """
    order = [F.col("source").asc_nulls_first(), F.col("doc_id").asc_nulls_first(), "leaf", "_tie"]
    stored = persisted(leaves.withColumn("_tie", F.monotonically_increasing_id())
                       .repartitionByRange(*order).sortWithinPartitions(*order).drop("_tie")
                       .withColumn("_mid", F.monotonically_increasing_id()))
    stored = stored.withColumn("_pid", F.shiftrightunsigned("_mid", _LOW_BITS))
    pieces = persisted(stored.groupBy("_pid", "source").agg(
        F.count(F.lit(1)).alias("here"), F.min("_mid").alias("_first")))
    totals = persisted(pieces.groupBy("source").agg(F.sum("here").alias("n")))
    sources = persisted(global_positions(totals, [F.col("source").asc_nulls_first()], "tree"))
    # as many rows to a source as partitions hold some of it
    before = Window.partitionBy("source").orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    pieces = pieces.withColumn("_before", F.coalesce(F.sum("here").over(before), F.lit(0)))
    same = pieces["source"].eqNullSafe(sources["source"])
    pieces = persisted(pieces.join(sources, same).select(
        "_pid", pieces["source"].alias("_source"), "_first", "_before", "tree", "n"))
    bounds = small(pieces)
    here = (stored["_pid"] == bounds["_pid"]) & stored["source"].eqNullSafe(bounds["_source"])
    idx = F.col("_mid") - F.col("_first") + F.col("_before")
    return persisted(stored.join(bounds, here).select(
        "tree", "n", idx.alias("idx"), "doc_id", "leaf", "altered")), sources


# --- levels ------------------------------------------------------------------------------

def _sibling(idx: Column, offset: Column, fanout: int) -> Column:
    """Index of the sibling ``offset`` slots after a slot-zero node."""
    return idx.bitwiseXOR(offset) if fanout == 2 else idx + offset


def _parents(nodes: DataFrame, fanout: int) -> DataFrame:
    """(tree, n, idx, digest, run) of the level above: slot-zero nodes meet their siblings."""
    last = F.least(F.lit(fanout).cast("long"), F.col("n") - F.col("idx")) - 1
    offsets = F.when(last > 0, F.sequence(F.lit(1).cast("long"), last))
    heads = nodes.where(F.pmod("idx", F.lit(fanout)) == 0).select(
        "tree", "n", "idx", "digest", F.explode_outer(offsets).alias("offset"))
    heads = heads.withColumn("sibling", _sibling(F.col("idx"), F.col("offset"), fanout))
    others = nodes.select("tree", F.col("idx").alias("sibling"), F.col("digest").alias("other"))
    met = heads.join(others, ["tree", "sibling"], "left").groupBy("tree", "idx").agg(
        F.max("n").alias("n"), F.max("digest").alias("digest"),
        F.sort_array(F.collect_list(F.when(F.col("offset").isNotNull(), F.struct("offset", "other")))).alias("met"))
    run = F.concat(F.array("digest"), F.col("met.other"))
    up = met.select("tree", F.ceil(F.col("n") / fanout).alias("n"),
                    F.floor(F.col("idx") / fanout).alias("idx"), run.alias("run"))
    return up.withColumn("digest", F.sha2(F.array_join("run", ""), 256))


def _levels(leaves: DataFrame, most: int, fanout: int) -> list[DataFrame]:
    """The stored levels above ``leaves`` up to one node, for trees of at most ``most`` leaves."""
    out, below = [], leaves
    while most > 1:
        below = persisted(_parents(below.where("n > 1"), fanout))
        out.append(below)
        most = -(-most // fanout)
    return out


def _step(family: Column, slot: Column) -> Column:
    """The part of a path beside the node in ``slot`` of its run."""
    left = F.array_join(F.slice(family, F.lit(1), slot), "")
    right = F.array_join(F.slice(family, slot + 2, F.size(family)), "")
    return F.array(F.struct(left.alias("l"), right.alias("r")))


def _with_paths(nodes: DataFrame, above: DataFrame | None, ends: DataFrame, fanout: int) -> DataFrame:
    """``nodes`` with the columns of ``ends`` (tree, path and others).

    ``above`` is the next level with these columns. A node alone on its level ends its
    tree: its path is that of ``ends``.
    """
    more = [c for c in ends.columns if c != "tree"]
    cols = [*nodes.columns, *more]
    tops = nodes.where("n = 1").join(ends, "tree").select(*cols)
    if above is None:
        return tops
    up = above.select("tree", F.col("idx").alias("_up"), F.col("run").alias("_family"), *more)
    met = nodes.where("n > 1").withColumn("_up", F.floor(F.col("idx") / fanout)).join(up, ["tree", "_up"])
    slot = F.pmod("idx", F.lit(fanout)).cast("int")
    path = F.concat(_step(F.col("_family"), slot), F.col("path"))
    return met.withColumn("path", path).select(*cols).unionByName(tops)


def _paths(leaves: DataFrame, levels: list[DataFrame], ends: DataFrame, fanout: int) -> DataFrame:
    """``leaves`` with their paths, from the top level down; those above are stored."""
    above = None
    for level in reversed(levels):
        above = persisted(_with_paths(level, above, ends, fanout))
    return _with_paths(leaves, above, ends, fanout)


def _tops(leaves: DataFrame, levels: list[DataFrame], name: str) -> DataFrame:
    """(tree, ``name``): the digest that remains of each tree."""
    out = leaves.where("n = 1").select("tree", F.col("digest").alias(name))
    for level in levels:
        out = out.unionByName(level.where("n = 1").select("tree", F.col("digest").alias(name)))
    return out


# --- operator ----------------------------------------------------------------------------

def manifest(docs: DataFrame, fields: tuple[str, ...] = FIELDS, id_col: str = "doc_id",
             group: str = "source", fanout: int = FANOUT,
             seen: tuple[Column, dict[str, Column]] | None = None) -> DataFrame:
    """(doc_id, leaf, seen_leaf, subroot, root, path) of every row of ``docs``.

    ``path`` lists from the leaf up the digests left and right of the path's node in its
    run, joined to one text each. ``seen`` describes a copy to check: the rows it differs
    in, and its values there; ``seen_leaf`` is the copy's digest, ``leaf`` in other rows.

    Edge cases: a null in any field has its own mark in the digest; null sources are a
    tree of their own, the first; null ids come first in their tree; rows that share an id
    stand in the order of their digests, repeated rows side by side; a source of one row
    is its own subroot, and the root if it is the only one; an empty table gives an empty
    result; other columns of ``docs`` play no part.
    """
    leaf = row_digest([F.col(f) for f in fields])
    where, values = seen or (F.lit(False), {})
    copy = row_digest([values.get(f, F.col(f)) for f in fields])
    rows = persisted(docs.select(
        F.col(group).alias("source"), F.col(id_col).alias("doc_id"), leaf.alias("leaf"),
        F.when(where, copy).alias("altered")))
    leaves, sources = _placed(rows)
    nodes = leaves.select("tree", "n", "idx", F.col("leaf").alias("digest"))
    most, trees = sources.agg(F.max("n"), F.count(F.lit(1))).head()
    levels = _levels(nodes, most or 0, fanout)

    subroots = persisted(_tops(nodes, levels, "subroot"))
    tops = subroots.select(F.lit(0).cast("long").alias("tree"), F.lit(trees).cast("long").alias("n"),
                           F.col("tree").alias("idx"), F.col("subroot").alias("digest"))
    upper = _levels(tops, trees, fanout)
    root = _tops(tops, upper, "root").withColumn("path", F.array().cast(_PATH))
    ends = persisted(_paths(tops, upper, root, fanout).select(
        F.col("idx").alias("tree"), "path", F.col("digest").alias("subroot"), "root"))

    out = _paths(leaves, levels, ends, fanout)
    return out.select("doc_id", "leaf", F.coalesce("altered", "leaf").alias("seen_leaf"),
                      "subroot", "root", "path")


def proof(path: Column) -> Column:
    """Digest of all siblings on a path, from the leaf up, left to right."""
    return F.sha2(F.array_join(F.transform(path, lambda s: F.concat(s["l"], s["r"])), ""), 256)


def fold(leaf: Column, path: Column) -> Column:
    """The root that a leaf's digest and its path give."""
    return F.aggregate(path, leaf, lambda d, s: F.sha2(F.concat(s["l"], d, s["r"]), 256))


def verified_manifest(docs: DataFrame) -> DataFrame:
    """(doc_id, leaf, subroot, root, proof_sha256, folded_root, verified): the manifest of
    ``docs`` against a copy in which some rows' texts were lower-cased (A-Z), those whose
    doc_id's CRC-32 is divisible by 5. A null id is in no such row."""
    hit = F.crc32(F.col("doc_id").cast("string")) % 5 == 0
    rows = manifest(docs, seen=(F.coalesce(hit, F.lit(False)), {"text": lower_ascii(F.col("text"))}))
    folded = rows.select("doc_id", "leaf", "subroot", "root", proof(F.col("path")).alias("proof_sha256"),
                         fold(F.col("seen_leaf"), F.col("path")).alias("folded_root"))
    return folded.withColumn("verified", F.col("folded_root") == F.col("root"))
