"""Session helpers: a local session for tests/bench, the shared folder, and
materialisation of intermediate tables into it.

On a cluster the shared folder is whatever ``spark.checkpoint.dir`` names;
we only invent one when the session leaves it unset (local tests).
"""

from __future__ import annotations

import math
import os
import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_CONF = "spark.checkpoint.dir"


def local_session(cores: int | str = "*", shuffle_partitions: int = 8,
                  app: str = "aislelens") -> SparkSession:
    """Session for tests and the bench (UI off, UTC, AQE on)."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "8g")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    shared_dir(spark)
    return spark


def cluster_conf(input_bytes: int, partition_bytes: int = 256 << 20) -> dict[str, str]:
    """Settings sized to the input so tasks fit executor memory.

    Scans split files at ``partition_bytes``; shuffles start with about one
    partition per ``partition_bytes`` of input (AQE coalesces the small ones
    after partial aggregation and splits skewed ones). Streaming state lives
    in RocksDB so per-customer state can exceed the heap.
    """
    parts = max(200, math.ceil(input_bytes / partition_bytes))
    return {
        "spark.sql.files.maxPartitionBytes": str(partition_bytes),
        "spark.sql.shuffle.partitions": str(parts),
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": str(partition_bytes // 2),
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.streaming.stateStore.providerClass":
            "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    }


def apply_conf(spark: SparkSession, conf: dict[str, str]) -> None:
    """Set runtime SQL settings on the session (call before the jobs)."""
    for k, v in conf.items():
        spark.conf.set(k, v)


def shared_dir(spark: SparkSession) -> str:
    """The cluster-shared folder for checkpoints and materialised tables.

    Read from ``spark.checkpoint.dir``; only when it is unset on a local
    master a fresh folder is created and registered, as tests do. On a
    cluster an unset folder is an error: each executor would write to its
    own disk.
    """
    d = spark.conf.get(CHECKPOINT_CONF, None)
    if not d:
        if not is_local(spark.sparkContext.master):
            raise ValueError(f"{CHECKPOINT_CONF} must name a folder that all executors share")
        d = tempfile.mkdtemp(prefix="aislelens-ckpt-")
        spark.conf.set(CHECKPOINT_CONF, d)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(os.path.join(d, "rdd"))
    return d


def is_local(master: str) -> bool:
    """Whether driver and executors are one process."""
    return master == "local" or master.startswith("local[")


def file_state(spark: SparkSession, path: str) -> tuple:
    """(name, length, modification time) of a file, or of the files in a folder."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = at.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(at)
    return tuple(sorted((f.getPath().getName(), f.getLen(), f.getModificationTime()) for f in files))


def is_file(spark: SparkSession, path: str) -> bool:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(at).isFile()


def delete_path(spark: SparkSession, path: str) -> None:
    """Removes a folder of the shared store that nothing reads any more."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def folder_names(spark: SparkSession, path: str) -> list[str]:
    """The names in a folder; none if it does not exist."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(spark._jsc.hadoopConfiguration())
    return sorted(f.getPath().getName() for f in fs.listStatus(at)) if fs.exists(at) else []


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new, unique path below the shared folder."""
    return os.path.join(shared_dir(spark), "tables", f"{name}-{uuid.uuid4().hex[:12]}")


_SCOPES: list[list[str]] = []


@contextmanager
def scratch_scope(spark: SparkSession):
    """Tables materialised inside are deleted at the end; write what shall
    stay before."""
    paths: list[str] = []
    _SCOPES.append(paths)
    try:
        yield
    finally:
        _SCOPES.remove(paths)
        for path in paths:
            delete_path(spark, path)


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as parquet into the shared folder and read it back.

    Cuts lineage (a lost executor re-reads the file instead of re-running
    the plan) and lets several consumers share one computation.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    for paths in _SCOPES[-1:]:
        paths.append(path)
    df.write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)
