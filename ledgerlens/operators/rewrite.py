"""UPDATE and DELETE on a stored, partitioned table: only changed partitions are rewritten."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ledgerlens.functions.sizing import row_count_at_most
from ledgerlens.operators.skew import BROADCAST_KEYS
from ledgerlens.session import stored

OP = "_op"
DELETE, UPDATE = "delete", "update"


def apply_changes(spark: SparkSession, path: str, changes: DataFrame, keys: list[str], partition: str) -> int:
    """Apply a keyed change list to the Parquet table at ``path``, partitioned by ``partition``.

    ``changes`` has ``keys``, ``_op`` (``delete`` or ``update``) and the columns to set; a key
    occurs once (repeated equal changes count once), a null value of an update sets null.
    Rows without a change and keys without a row are left alone. Returns the number of
    partitions rewritten.

    Each row meets its change once. The change list is counted first. A short one is stored
    and broadcast, so the table is only scanned. A longer one is joined by shuffle and the joined rows are
    written to the scratch folder, from which the touched partitions (where changed rows
    are, and where an update moves them) are found and written. A dynamic partition
    overwrite swaps exactly those partitions in at commit: it stages new files and only
    then drops the old, so that it may read the table. All other partitions keep their
    files, and a job that fails before the commit leaves the table as it was. Partitions
    that lost all rows are removed last.
    """
    table = spark.read.parquet(path)
    sets = [c for c in changes.columns if c not in (*keys, OP)]
    fresh = [F.col(c).alias(f"_new_{c}") for c in sets]
    short = row_count_at_most(changes, BROADCAST_KEYS)
    # by key first: the distinct and the join then share one shuffle
    listed = stored(changes.distinct()) if short else changes.repartition(*keys).distinct()
    side = listed.select(*keys, OP, *fresh)
    met = table.join(F.broadcast(side), keys, "left") if short else stored(table.join(side, keys, "left"))
    moved = [F.col(f"_new_{partition}").alias("p")] if partition in sets else []
    places = F.explode(F.array(F.col(partition).alias("p"), *moved))
    # as many rows as the table has partitions
    touched = stored(met.where(F.col(OP).isin(DELETE, UPDATE)).select(places.alias("_p")).distinct())
    n = touched.count()
    if n == 0:
        return 0
    inside = met.join(F.broadcast(touched), met[partition].eqNullSafe(touched["_p"]), "left_semi")
    kept = inside.where(F.coalesce(F.col(OP), F.lit("")) != DELETE)
    after = kept.select(*[
        F.when(F.col(OP) == UPDATE, F.col(f"_new_{c}").cast(table.schema[c].dataType)).otherwise(F.col(c)).alias(c)
        if c in sets else F.col(c) for c in table.columns])
    # the partitions that have rows, noted while they are written
    seen = Observation()
    (after.observe(seen, F.collect_set(F.struct(F.col(partition).alias("_p"))).alias("left"))
     .write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(partition).parquet(path))
    left = {row[0] for row in seen.get["left"]}
    for row in touched.collect():
        if row[0] not in left:
            _drop_partition(spark, path, partition, row[0])
    return n


def _drop_partition(spark: SparkSession, path: str, partition: str, value) -> None:
    jvm = spark.sparkContext._jvm
    name = "__HIVE_DEFAULT_PARTITION__" if value is None else \
        jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils.escapePathName(str(value))
    folder = jvm.org.apache.hadoop.fs.Path(f"{path}/{partition}={name}")
    folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)
