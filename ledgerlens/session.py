"""Session defaults and the shared checkpoint folder."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

# Settings every job relies on. AQE re-plans joins from real shuffle sizes,
# splits skewed join partitions and coalesces small ones; ANSI mode stays on
# (the operators use try_* where the reference expected NULL).
SESSION_DEFAULTS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.localShuffleReader.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def build_session(master: str = "local[*]", shuffle_partitions: int = 8,
                  app_name: str = "ledgerlens", extra: dict | None = None) -> SparkSession:
    """A session for local runs and tests; on a cluster use the provided one."""
    builder = SparkSession.builder.master(master).appName(app_name)
    conf = dict(SESSION_DEFAULTS)
    conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.setdefault("spark.driver.memory", "8g")
    conf.update(extra or {})
    for k, v in conf.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    checkpoint_dir(spark)
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder for checkpoints and written intermediate tables.

    Taken from ``spark.checkpoint.dir`` when the cluster names one. Only a
    local-mode session without the setting (tests, laptops) gets a fresh
    temporary folder; a cluster session without it is an error, because a
    machine-local folder does not survive the loss of an executor.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    configured = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get(
        "spark.checkpoint.dir", None)
    if configured:
        sc.setCheckpointDir(configured)
        return sc.getCheckpointDir() or configured
    if not sc.master.startswith("local"):
        raise RuntimeError(
            "spark.checkpoint.dir is not set; name a shared folder for checkpoints")
    path = tempfile.mkdtemp(prefix="ledgerlens-ckpt-", dir=os.environ.get("TMPDIR", "/tmp"))
    sc.setCheckpointDir(path)
    return sc.getCheckpointDir() or path


def scratch_dir(spark: SparkSession) -> str:
    """This application's folder for written tables, inside the shared checkpoint folder."""
    app = spark.conf.get("spark.app.id", "app")
    return f"{checkpoint_dir(spark).rstrip('/')}/ledgerlens-{app}"


def stored(df: DataFrame) -> DataFrame:
    """``df`` written as a table in the scratch folder and read back: computed once, kept when
    an executor is lost, and removed by ``drop_scratch``."""
    spark = df.sparkSession
    path = f"{scratch_dir(spark)}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_scratch(spark: SparkSession) -> None:
    """Remove the tables this application has written to its scratch folder. Reports read
    them lazily, so the caller does this once the results are stored."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(scratch_dir(spark))
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def input_bytes(paths: list[str]) -> int:
    """Total size of local input files (for sizing a local run)."""
    total = 0
    for p in paths:
        if os.path.isfile(p):
            total += os.path.getsize(p)
        for root, _, files in os.walk(p):
            total += sum(os.path.getsize(os.path.join(root, f)) for f in files)
    return total


def size_settings(scan_bytes: int, cores: int, partition_bytes: int = 256 << 20,
                  expansion: float = 3.0) -> dict[str, str]:
    """Partition settings for an input of ``scan_bytes`` on ``cores`` task slots.

    Scan splits of ``partition_bytes``; the initial shuffle partition count
    assumes shuffles move up to ``expansion`` x the compressed scan (columnar
    parquet inflates once decoded), at most ``partition_bytes`` each, and
    never fewer than the slots. There is no upper bound: for an input so large that
    the number of partitions is itself a burden, ask for a larger ``partition_bytes``.
    AQE merges small partitions back to ``partition_bytes`` and splits skewed ones, so
    over-estimating is cheap and under-estimating (spills, huge tasks) is not.
    """
    shuffle_parts = max(cores, int(scan_bytes * expansion // partition_bytes) + 1)
    return {
        "spark.sql.files.maxPartitionBytes": str(partition_bytes),
        "spark.sql.shuffle.partitions": str(shuffle_parts),
        "spark.sql.adaptive.coalescePartitions.initialPartitionNum": str(shuffle_parts),
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": str(partition_bytes),
    }
