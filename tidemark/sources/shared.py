"""The folder that driver and executors share, and results kept in it."""

from __future__ import annotations

import gc
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def base_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``, or the checkpoint folder set before; only a local session gets a temporary one where neither is set."""
    sc = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if folder is None:
        if not sc.master.startswith("local[") and sc.master != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="tidemark-")
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(folder)
    return folder


def shared_folder(spark: SparkSession) -> str:
    """A new folder below the shared one."""
    return f"{base_folder(spark).rstrip('/')}/tidemark-{uuid.uuid4().hex}"


def materialise(df: DataFrame) -> DataFrame:
    """df, written to the shared folder and cut off from what it was made from."""
    base_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def release(spark: SparkSession) -> None:
    """Let the files of shuffles and checkpoints go that nothing refers to any more; they would else stay until the driver happens to collect its garbage."""
    for _ in range(2):  # Python's references first
        gc.collect()
        spark.sparkContext._jvm.System.gc()


def keep(df: DataFrame) -> DataFrame:
    """df from Parquet files in a new shared folder, once the files of the shuffles that made it are let go: smaller than a checkpoint's rows."""
    spark = df.sparkSession
    path = shared_folder(spark)
    df.write.parquet(path)
    release(spark)
    return spark.read.schema(df.schema).parquet(path)
