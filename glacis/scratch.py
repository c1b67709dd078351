"""A folder that all executors share, for files that a query writes and reads again."""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def path(spark: SparkSession, name: str) -> str:
    """A path of its own in the folder that ``spark.checkpoint.dir`` names; where it is unset and all runs in one
    process, in one of ours. What is there goes when the driver ends."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named and spark.sparkContext.master.partition("[")[0] != "local":
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    own = (named or f"file://{os.path.join(tempfile.gettempdir(), 'checkpoints', f'glacis-{os.getpid()}')}").rstrip("/") + f"/glacis-{uuid.uuid4().hex}"
    atexit.register(_drop, spark, own)
    return f"{own}/{name}"


def _drop(spark: SparkSession, folder: str) -> None:
    try:
        target = spark._jvm.org.apache.hadoop.fs.Path(folder)
        target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)
    except Exception:  # noqa: BLE001  the session may be gone by then
        pass


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written there and read again: what builds on it doesn't carry its plan along."""
    at = path(df.sparkSession, name)
    df.write.parquet(at)
    return df.sparkSession.read.schema(df.schema).parquet(at)
