"""Salting for joins where one key may hold a large share of the rows.

AQE splits a skewed join partition only when the join reads two shuffle
stages directly; when joins on the same key share a stage (the partitioning
is reused), it cannot. A salted join spreads the rows of each hot key over
several tasks itself: the big side's hot rows get a salt from a hash of the
row, the small side's row for that key is repeated once per salt, and the
join runs on (key, salt). Keys that are not hot keep salt 0 and cost nothing
extra.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlens.functions.sizing import broadcast_if_bounded
from ledgerlens.session import stored

HOT_KEY_ROWS = 1_000_000
# Hot lists up to so many keys are broadcast, longer ones shuffled.
BROADCAST_KEYS = 100_000
# Session setting that overrides HOT_KEY_ROWS (e.g. to rehearse on small data).
HOT_KEY_CONF = "spark.ledgerlens.hotKeyRows"


def hot_key_rows(spark) -> int:
    return int(spark.conf.get(HOT_KEY_CONF, None) or HOT_KEY_ROWS)


def hot_keys(counts: DataFrame, keys: list[str], count_col: str, rows_per_task: int
             ) -> DataFrame | None:
    """Keys with more than ``rows_per_task`` rows and their number of salts.

    Stays a DataFrame of any size (written to the scratch folder, since both sides
    of the join read it); ``None`` when no key is hot.
    """
    salts = F.ceil(F.col(count_col) / F.lit(max(rows_per_task, 1))).cast("int").alias("_salts")
    hot = stored(counts.where(F.col(count_col) > rows_per_task).select(*keys, salts))
    return None if hot.isEmpty() else hot


def salted_join(big: DataFrame, small: DataFrame, keys: list[str], hot: DataFrame | None,
                how: str = "inner") -> DataFrame:
    """``big`` joined to ``small`` (at most one row per key) on ``keys``.

    ``hot`` (from ``hot_keys``) lists keys whose ``big`` rows are split into
    ``_salts`` pieces. Without hot keys this is a plain join. A hot list of at most
    ``BROADCAST_KEYS`` keys goes to every task, so that tagging the big side needs no
    shuffle; a longer one is joined by shuffle, where AQE splits the hot keys (nothing
    after that join needs their partitioning).
    """
    if hot is None:
        return big.join(small, keys, how)
    salts = broadcast_if_bounded(hot.select(*keys, "_salts"), BROADCAST_KEYS)
    b = big.join(salts, keys, "left").withColumn(
        "_salt", F.when(F.col("_salts").isNull(), F.lit(0)).otherwise(
            F.pmod(F.xxhash64(*[F.col(c) for c in big.columns]), F.col("_salts")).cast("int")))
    s = small.join(salts, keys, "left").withColumn(
        "_salt", F.explode(F.when(F.col("_salts").isNull(), F.array(F.lit(0))).otherwise(
            F.sequence(F.lit(0), F.col("_salts") - 1))))
    return b.drop("_salts").join(s.drop("_salts"), [*keys, "_salt"], how).drop("_salt")
