"""Where iterative plans cut their lineage."""

from __future__ import annotations

import gc
import tempfile
import time
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the cluster's ``spark.checkpoint.dir``; only a local session without one gets a folder of its own."""
    sc = spark.sparkContext
    if sc.getCheckpointDir():
        return
    told = spark.conf.get("spark.checkpoint.dir", None)
    if told:
        sc.setCheckpointDir(told)
    elif sc.master == "local" or sc.master.startswith(("local[", "local-cluster[")):
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="ckpt-"))
    else:
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")


def shared_path(spark: SparkSession, name: str) -> str:
    """A path of its own for ``name`` in the checkpoint folder."""
    ensure_checkpoint_dir(spark)
    return f"{spark.sparkContext.getCheckpointDir()}/{name}-{uuid.uuid4().hex}"


def dropped(spark: SparkSession, path: str) -> None:
    """Delete a table that nothing reads any more."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def let_go(spark: SparkSession) -> None:
    """Have the cleaner delete the shuffles and checkpoints that nothing refers to any more.

    It learns of them when the driver collects its garbage, which a driver with little to do may put off for as long as
    half an hour; until then the files of every finished step stay beside those of the next.
    """
    for _ in range(2):  # what Python lets go of reaches the driver's side with some delay
        gc.collect()
        spark._jvm.System.gc()
        time.sleep(0.2)


def broadcast_small(df: DataFrame, most: int = 100_000) -> DataFrame:
    """``df``, to be broadcast if it has at most ``most`` rows; else the planner finds another way."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


def few_or_merge(df: DataFrame, most: int = 100_000) -> DataFrame:
    """``df``, to be broadcast if it has at most ``most`` rows; else for a merge join, so that the other side never is."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df.hint("merge")


def cut(df: DataFrame) -> DataFrame:
    """Materialise ``df`` in the checkpoint folder, which all executors share, and cut its lineage there."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)
