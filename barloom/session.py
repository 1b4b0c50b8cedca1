"""Session settings and the shared folder that jobs may write to."""

from __future__ import annotations

import tempfile
import uuid
from functools import cache

from pyspark.sql import SparkSession

#: Settings a job relies on; a cluster profile may set the same keys.
SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
}

ROCKSDB_PROVIDER = (
    "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
)


def local_session(cores: int = 8, app: str = "barloom", memory: str = "8g") -> SparkSession:
    """Session for tests and the benchmark; clusters bring their own."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", memory)
        .config("spark.sql.shuffle.partitions", str(cores))
    )
    for key, value in SETTINGS.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def is_local(spark: SparkSession) -> bool:
    """One process for driver and executors; ``local-cluster`` is a cluster."""
    master = spark.sparkContext.master
    return master == "local" or master.startswith("local[")


def shared_dir(spark: SparkSession) -> str:
    """Folder for checkpoints and intermediate tables, visible to every executor.

    The cluster names it in ``spark.checkpoint.dir``. Only a local session, where
    driver and executors are one process, may fall back to a temporary folder.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root is None:
        if not is_local(spark):
            raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")
        root = _local_dir()
    return root.rstrip("/")


@cache
def _local_dir() -> str:
    return tempfile.mkdtemp(prefix="barloom-")


def shared_path(spark: SparkSession, label: str) -> str:
    """A fresh path under the shared folder."""
    return f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"


def materialize(df, label: str, codec: str | None = None):
    """Cut lineage through a written table, so that a lost executor or a second
    reader never recomputes what came before. ``codec`` packs a large table tighter."""
    path = shared_path(df.sparkSession, label)
    df.write.mode("errorifexists").parquet(path, compression=codec)
    return df.sparkSession.read.schema(df.schema).parquet(path)
