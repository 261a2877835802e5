"""Packing into optimal length buckets.

1. Token counts of whole texts under a public tokenizer (its path is a parameter; the
   driver reads it once and sends the ranks, of bounded size, to the tasks).
2. The histogram of lengths over all documents. Dynamic programming over it chooses the
   bucket boundaries with the least padding when each document is padded to its bucket's
   length: best[b][j] = min over i of best[b-1][i] + cost(i, j). The cost satisfies the
   quadrangle inequality, so the best i never falls as j grows and each layer is solved
   by divide and conquer in O(n log n).
3. Within a bucket, documents fill batches of a token budget: budget // bucket length
   documents each. Positions come from stored scan partitions: a row number inside
   (partition, bucket) and the counts of the partitions before it, so a bucket that holds
   a third of all documents is never gathered.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerlens.llm.common import persisted

TOKENIZER = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"
#: The word pattern of that tokenizer's family (fixed value).
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
BUCKETS = 16
BATCH_TOKENS = 32_768
#: Rows of the histogram that the driver fetches at once. The whole of it comes there: it
#: has a row per different length, at most as many as the longest text has tokens.
MAX_LENGTHS = 65_536


def _read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


def token_lengths(docs: DataFrame, id_col: str, text: str, tokenizer: str = TOKENIZER) -> DataFrame:
    """(doc_id, n_tokens) of every row; an end token closes each text."""
    ranks = docs.sparkSession.sparkContext.broadcast(_read_ranks(tokenizer))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import tiktoken
        encode = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks.value,
                                   special_tokens={}).encode_ordinary
        for b in batches:
            n = [len(encode(t or "")) + 1 for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64())], ["doc_id", "n_tokens"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text)).mapInArrow(
        run, "doc_id long, n_tokens long")


def best_boundaries(lengths: np.ndarray, counts: np.ndarray, buckets: int) -> list[int]:
    """Upper lengths of at most ``buckets`` buckets with the least padding in all."""
    n = len(lengths)
    if n <= buckets:
        return [int(x) for x in lengths]
    docs = np.concatenate([[0], np.cumsum(counts)]).astype(np.float64)
    tokens = np.concatenate([[0], np.cumsum(counts * lengths)]).astype(np.float64)

    def cost(i: np.ndarray, j: int) -> np.ndarray:
        """Padding of one bucket over lengths i..j-1."""
        return lengths[j - 1] * (docs[j] - docs[i]) - (tokens[j] - tokens[i])

    best = np.full(n + 1, np.inf)
    best[0] = 0.0
    cuts = []
    for _ in range(buckets):
        now, cut = np.full(n + 1, np.inf), np.zeros(n + 1, np.int64)
        now[0] = 0.0
        todo = [(1, n, 0, n - 1)]
        while todo:
            a, b, lo, hi = todo.pop()
            if a > b:
                continue
            j = (a + b) // 2
            i = np.arange(lo, min(j - 1, hi) + 1)
            total = best[i] + cost(i, j)
            k = int(np.argmin(total))
            now[j], cut[j] = total[k], i[k]
            todo += [(a, j - 1, lo, cut[j]), (j + 1, b, cut[j], hi)]
        best = now
        cuts.append(cut)
    ends, j = [], n
    for cut in reversed(cuts):
        if j == 0:
            break
        ends.append(int(lengths[j - 1]))
        j = int(cut[j])
    return sorted(set(ends))


def _histogram(lengths: DataFrame, max_lengths: int) -> tuple[np.ndarray, np.ndarray]:
    """The different lengths in order, and how many documents have each."""
    hist = persisted(lengths.groupBy("n_tokens").agg(F.count(F.lit(1)).alias("n")))
    parts = -(-hist.count() // max_lengths)
    rows = hist.repartitionByRange(parts, "n_tokens").toLocalIterator() if parts > 1 else hist.collect()
    found = np.fromiter((x for r in rows for x in r), np.int64).reshape(-1, 2)
    found = found[np.argsort(found[:, 0])]
    return found[:, 0], found[:, 1]


def pack(docs: DataFrame, id_col: str = "doc_id", text: str = "text", tokenizer: str = TOKENIZER,
         buckets: int = BUCKETS, batch_tokens: int = BATCH_TOKENS, max_lengths: int = MAX_LENGTHS) -> DataFrame:
    """(doc_id, n_tokens, bucket, bucket_tokens, batch, slot) of every row.

    ``bucket_tokens`` is the length its documents are padded to, ``batch`` a number inside
    the bucket, ``slot`` the place inside the batch. Every batch of a bucket but its last
    is full.

    Edge cases: a null or empty text is one end token; a text longer than the budget is a
    batch of its own; repeated rows and null ids are packed like any other; equal lengths
    share a bucket; an empty table gives an empty result; other columns play no part.
    """
    stored = persisted(token_lengths(docs, id_col, text, tokenizer).withColumn(
        "_part", F.spark_partition_id()).withColumn("_row", F.monotonically_increasing_id()))
    lengths, counts = _histogram(stored, max_lengths)
    ends = best_boundaries(lengths, counts, buckets) if len(lengths) else []
    bucket, padded = F.lit(None).cast("int"), F.lit(None).cast("long")
    for i, end in reversed(list(enumerate(ends))):
        fits = F.col("n_tokens") <= end
        bucket, padded = F.when(fits, F.lit(i)).otherwise(bucket), F.when(fits, F.lit(end).cast("long")).otherwise(padded)
    rows = stored.withColumn("bucket", bucket).withColumn("bucket_tokens", padded)
    here = Window.partitionBy("bucket", "_part").orderBy("doc_id", "_row")
    placed = rows.withColumn("_at", F.row_number().over(here).cast("long") - 1)
    sizes = rows.groupBy("bucket", "_part").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("bucket").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.withColumn("_before", F.coalesce(F.sum("n").over(before), F.lit(0))).drop("n")
    # one row per (partition, bucket): partitions times at most ``buckets``
    position = placed.join(offsets, ["bucket", "_part"])
    per_batch = F.greatest(F.lit(1).cast("long"), F.floor(F.lit(batch_tokens) / F.col("bucket_tokens")))
    at = F.col("_at") + F.col("_before")
    return position.select(
        "doc_id", "n_tokens", "bucket", "bucket_tokens",
        F.floor(at / per_batch).cast("long").alias("batch"), F.pmod(at, per_batch).alias("slot"))
