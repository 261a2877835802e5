"""Benchmark decontamination: containment search with size-partitioned MinHash sketches.

An item is found in a document if at least ``threshold`` of the item's distinct word
shingles stand in it. Items are short and documents long, so a document's own MinHash
says little about an item inside it (their Jaccard similarity is near zero). Sketches are
therefore kept for the items only, and their length is set so that none can be missed:

* Items are partitioned by size, the number n of their distinct shingles, in powers of
  two. A partition's sketch length is that of its largest size, n - ceil(threshold n) + 1.
* An item's sketch is its so many least shingle hashes (bottom-k MinHash). A document
  that holds ``threshold`` of the shingles lacks at most n - ceil(threshold n) of them,
  so it holds at least one of the sketch.
* Documents are searched by all their shingle hashes; each (document, item) met is then
  verified by exact shingles.

All steps are built-in expressions; texts are shuffled only in the verification, and
only those with a candidate, when their list is too long to broadcast.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlens.llm.common import (is_small, let, lower_ascii, packed, persisted, row_key, small,
                                   unpacked, words)

SHINGLE = 5
#: Containment threshold as a fraction, in whole numbers.
NUMERATOR, DENOMINATOR = 4, 5


def _per_shingle(text: Column, k: int, join) -> Column:
    """``join(word, next, ...)`` of each shingle; a shorter text is one shingle, a text
    without words has none."""
    def of(w: Column) -> Column:
        n = F.when(F.size(w) == 0, 0).otherwise(F.greatest(F.size(w) - (k - 1), F.lit(1)))
        return F.slice(F.transform(w, lambda x, i: join(x, *[F.get(w, i + d) for d in range(1, k)])), 1, n)

    return let(words(lower_ascii(text)), of)


def shingle_hashes(text: Column, k: int = SHINGLE) -> Column:
    return _per_shingle(text, k, F.xxhash64)


def shingles(text: Column, k: int = SHINGLE) -> Column:
    return _per_shingle(text, k, lambda *w: F.concat_ws(" ", *w))


def sketches(items: DataFrame, item_id: str, text: str, k: int = SHINGLE) -> DataFrame:
    """(item_id, hash): each item's least shingle hashes, as many as its size partition asks."""
    sized = items.select(F.col(item_id).alias("item_id"),
                         F.array_sort(F.array_distinct(shingle_hashes(F.col(text), k))).alias("h"))
    sized = sized.where(F.size("h") > 0)
    upper = F.pow(F.lit(2.0), F.ceil(F.log2(F.size("h").cast("double")))).cast("int")
    length = upper - F.ceil(upper * F.lit(NUMERATOR) / F.lit(DENOMINATOR)).cast("int") + 1
    return sized.select("item_id", F.explode(F.slice("h", F.lit(1), length)).alias("hash"))


def find_items(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text: str = "text",
               item_id: str = "item_id", item_text: str = "text", k: int = SHINGLE) -> DataFrame:
    """(_k1, _k2, doc_id, item_id, n_shared, n_shingles) of each item in each row.

    Edge cases: null, empty and blank texts have no shingles, as documents and as items,
    and are never found; a text shorter than a shingle is one shingle; repeated rows give
    repeated results; repeated items and null ids are reported as they are; empty tables
    give an empty result; further columns play no part.
    """
    sketch = small(persisted(sketches(items, item_id, item_text, k)))
    keyed = row_key(docs.select(F.col(id_col).alias("doc_id"), F.col(text).alias("_text")), "doc_id", "_text")
    met = keyed.select("_k1", "_k2", F.explode(shingle_hashes(F.col("_text"), k)).alias("hash"))
    candidates = persisted(met.join(sketch, "hash").select("_k1", "_k2", "item_id").distinct())
    exact = items.select(F.col(item_id).alias("item_id"), F.array_distinct(
        shingles(F.col(item_text), k)).alias("_of_item")).where(F.size("_of_item") > 0)
    exact = small(persisted(exact), 20_000, F.octet_length(F.array_join("_of_item", "")))
    pairs = candidates.withColumnRenamed("item_id", "_i").join(
        exact, F.col("_i").eqNullSafe(F.col("item_id"))).drop("_i")
    rows = keyed
    ids = candidates.select("_k1", "_k2").distinct()
    if is_small(ids):
        rows = rows.join(F.broadcast(ids), ["_k1", "_k2"], "left_semi")
    of_doc = rows.select("_k1", "_k2", "doc_id", F.array_distinct(shingles(F.col("_text"), k)).alias("_of_doc"))
    both = of_doc.join(pairs, ["_k1", "_k2"])
    return both.select(
        "_k1", "_k2", "doc_id", "item_id",
        F.size(F.array_intersect("_of_item", "_of_doc")).cast("long").alias("n_shared"),
        F.size("_of_item").cast("long").alias("n_shingles")).where(
        DENOMINATOR * F.col("n_shared") >= NUMERATOR * F.col("n_shingles"))


def contamination(docs: DataFrame, items: DataFrame, **names) -> DataFrame:
    """(doc_id, item_id, n_shared, n_shingles, containment) of each item in each document."""
    return find_items(docs, items, **names).select(
        "doc_id", "item_id", "n_shared", "n_shingles",
        (F.col("n_shared") / F.col("n_shingles")).alias("containment"))


def remove_contaminated(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text: str = "text",
                        **names) -> DataFrame:
    """``docs`` without the rows that hold an item; edge cases as in ``find_items``."""
    found = find_items(docs, items, id_col=id_col, text=text, **names)
    gone = small(persisted(found.select("_k1", "_k2").distinct()))
    rows = row_key(packed(docs, id_col, text), "doc_id", "text")
    return unpacked(rows.join(gone, ["_k1", "_k2"], "left_anti"))
