"""Written intermediate tables: lineage ends there, and a lost executor costs no more than reading them again.

They stay until ``discard``, because frames that were made from them read them whenever they are used."""
from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def folder(spark: SparkSession) -> str:
    """The shared folder that the cluster names; a local session without one gets a temporary folder of its own."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not named and not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if not named:
        named = f"file://{tempfile.mkdtemp(prefix='spark-', dir='/tmp')}"
        spark.sparkContext.setCheckpointDir(named)
    return named.rstrip("/")


#: What this driver has written and not discarded.
_kept: list[str] = []


def discard(spark: SparkSession) -> int:
    """Deletes all intermediate tables that this driver has written, once their frames are no longer used; how many."""
    n, fs = len(_kept), spark.sparkContext._jvm.org.apache.hadoop.fs
    while _kept:
        path = fs.Path(_kept.pop())
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
    return n


def written(df: DataFrame) -> DataFrame:
    path = f"{folder(df.sparkSession)}/staged-{uuid.uuid4().hex}"
    _kept.append(path)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
