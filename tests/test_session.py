"""Checkpoint folder rules."""

from types import SimpleNamespace

import pytest

from ledgerlens.session import checkpoint_dir


class _Conf:
    def __init__(self, values):
        self.values = values

    def get(self, key, default=None):
        return self.values.get(key, default)


class _Context:
    def __init__(self, master, current=None, conf=None):
        self.master = master
        self.current = current
        self._conf = _Conf(conf or {})

    def getCheckpointDir(self):
        return self.current

    def getConf(self):
        return self._conf

    def setCheckpointDir(self, path):
        self.current = path


def _session(master, current=None, conf=None):
    return SimpleNamespace(sparkContext=_Context(master, current, conf), conf=_Conf(conf or {}))


def test_existing_checkpoint_dir_is_kept():
    assert checkpoint_dir(_session("yarn", current="hdfs:///ckpt")) == "hdfs:///ckpt"


def test_configured_dir_is_used():
    s = _session("spark://m:7077", conf={"spark.checkpoint.dir": "s3a://b/ckpt"})
    assert checkpoint_dir(s) == "s3a://b/ckpt"


def test_cluster_without_shared_dir_is_an_error():
    with pytest.raises(RuntimeError):
        checkpoint_dir(_session("yarn"))


def test_local_without_dir_gets_a_fresh_folder():
    path = checkpoint_dir(_session("local[4]"))
    assert path and "ledgerlens-ckpt-" in path


def test_size_settings_scale_with_input():
    from ledgerlens.session import size_settings
    small = size_settings(30 << 20, cores=8)
    big = size_settings(100 << 40, cores=8000)
    assert int(small["spark.sql.shuffle.partitions"]) == 8
    assert int(big["spark.sql.shuffle.partitions"]) == 3 * (100 << 40) // (256 << 20) + 1
    assert big["spark.sql.files.maxPartitionBytes"] == str(256 << 20)


def test_scratch_is_dropped(spark):
    import os
    from ledgerlens.session import drop_scratch, scratch_dir
    spark.range(3).write.parquet(f"{scratch_dir(spark)}/t")
    assert os.path.exists(scratch_dir(spark).removeprefix("file:"))
    drop_scratch(spark)
    assert not os.path.exists(scratch_dir(spark).removeprefix("file:"))


def test_input_bytes_counts_files(tmp_path):
    from ledgerlens.session import input_bytes
    (tmp_path / "a").mkdir()
    (tmp_path / "a" / "x.bin").write_bytes(b"1234")
    (tmp_path / "y.bin").write_bytes(b"12")
    assert input_bytes([str(tmp_path)]) == 6
    assert input_bytes([str(tmp_path / "y.bin")]) == 2


def test_row_count_at_most(spark):
    from ledgerlens.functions.sizing import broadcast_if_bounded, row_count_at_most
    df = spark.range(10)
    assert row_count_at_most(df, 10) and not row_count_at_most(df, 9)
    joined = spark.range(100).join(broadcast_if_bounded(df, 10), "id")
    assert "BroadcastHashJoin" in joined._jdf.queryExecution().executedPlan().toString()
