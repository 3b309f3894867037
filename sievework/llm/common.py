"""Small helpers shared by the corpus operators."""
from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The white space of every word rule: space and the bytes 9 to 13.
WHITE = " \t\n\x0b\x0c\r"
WHITE_RE = r"[\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder the cluster names; in local mode without one (tests), a new temporary one becomes the checkpoint
    folder.  Elsewhere a missing name is an error: a folder of one machine would lose data."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not named and not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if not named:
        named = f"file://{tempfile.mkdtemp(prefix='spark-', dir='/tmp')}"
        spark.sparkContext.setCheckpointDir(named)
    return named.rstrip("/")


def materialise(df: DataFrame) -> DataFrame:
    """Write df as Parquet into the shared folder and read it back: the lineage ends there and survives lost executors."""
    path = f"{scratch_dir(df.sparkSession)}/sievework-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    df.sparkSession.sparkContext._jvm.System.gc()  # what only the written plan used, its shuffle files among it, can go now
    return df.sparkSession.read.schema(df.schema).parquet(path)


def ascii_lower(col: Column) -> Column:
    """A-Z only, unlike lower()."""
    return F.translate(col, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def crc_mod(col: Column, mod: int) -> Column:
    """crc32 of the id as decimal text, modulo mod."""
    return F.crc32(col.cast("string").cast("binary")) % mod


def blocks_for(total: int, per_block: int) -> int:
    return max(1, -(-int(total or 0) // per_block))


def fresh(df: DataFrame, name: str) -> str:
    """A column name that df does not have, whatever the case of its letters."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def long_key(df: DataFrame, key: str) -> Column:
    """The key as a long; keys that are not whole numbers are an error before any work."""
    kind = df.schema[key].dataType
    if kind.simpleString() not in ("tinyint", "smallint", "int", "bigint"):
        raise TypeError(f"{key} must be a whole number, not {kind.simpleString()}")
    return F.col(f"`{key}`").cast("long")
