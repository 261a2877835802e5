"""Distinct counts that merge: sets of whole-number keys as bucketed bitmaps.

A set is rows of (key name, bucket, bitmap): the bucket is the key's high part, the
bitmap marks its low parts. Bitmaps of a bucket are united by OR, so counts taken by
fine dimensions fold exactly to coarser ones, which plain distinct counts do not.

A bitmap covers ``BITS`` neighbouring numbers (4 KB). Buckets that hold only a few keys
(sparse keys) would waste most of it: they keep their keys as rows (``few``) instead.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlens.session import stored

# Numbers of a bitmap (fixed by the SQL functions used).
BITS = 32_768
# A bucket's keys are stored as numbers up to this count: 8 bytes each against 4 KB.
FEW = 256


def key_bitmaps(df: DataFrame, keys: list[str], dims: list[str] = ()) -> DataFrame:
    """(dims, key, bucket, few, bits): the distinct non-null values of each of ``keys`` by ``dims``.

    One pass over the rows: the keys are stacked, distinct (dims, key, value) come first
    (partial on every executor), then each bucket is folded.
    """
    stack = F.array(*[F.struct(F.lit(k).alias("key"), F.col(k).cast("long").alias("value")) for k in keys])
    values = df.select(*dims, F.inline(stack)).where("value is not null").distinct()
    # at most BITS positions to a bucket
    lists = stored(values.groupBy(*dims, "key", F.bitmap_bucket_number("value").alias("bucket")).agg(
        F.collect_list(F.bitmap_bit_position("value").cast("int")).alias("few")))
    few = lists.where(F.size("few") <= FEW).withColumn("bits", F.lit(None).cast("binary"))
    return few.unionByName(_as_bits(lists.where(F.size("few") > FEW), dims).withColumn(
        "few", F.lit(None).cast("array<int>")))


def _as_bits(lists: DataFrame, dims: list[str]) -> DataFrame:
    return lists.select(*dims, "key", "bucket", F.explode("few").alias("at")).groupBy(
        *dims, "key", "bucket").agg(F.bitmap_construct_agg(F.col("at").cast("long")).alias("bits"))


def merged_count(maps: DataFrame, keys: list[str], dims: list[str] = ()) -> DataFrame:
    """``dims`` and the number of distinct values of each of ``keys`` over all of ``maps``."""
    of_keys = maps.where(F.col("key").isin(keys))
    whole = of_keys.where("bits is not null").select(*dims, "key", "bucket", "bits")
    united = whole.unionByName(_as_bits(of_keys.where("bits is null"), dims)).groupBy(*dims, "key", "bucket").agg(F.bitmap_or_agg("bits").alias("bits"))
    count = [F.coalesce(F.sum(F.when(F.col("key") == k, F.bitmap_count("bits"))), F.lit(0)).cast("long").alias(k)
             for k in keys]
    return united.groupBy(*dims).agg(*count)
