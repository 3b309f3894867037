"""Streaming forms of the maintenance jobs (extensions: the batch jobs are the reference behaviour)."""
from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.store import Store


def deduplicated(stream: DataFrame, key: list[str], time: str, late: str = "1 hour") -> DataFrame:
    """The first row of each key within the watermark; state older than it is dropped."""
    return stream.withWatermark(time, late).dropDuplicatesWithinWatermark(key)


def ask_sessions(stream: DataFrame, user: str, time: str, gap: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Sessions of each user that end after an hour's silence: when to ask whether they applied."""
    return stream.withWatermark(time, late).groupBy(F.session_window(time, gap).alias("session"), user).agg(F.count("*").alias("events"), F.max(time).alias("left_at"))


def upsert_batches(stream: DataFrame, apply: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    """Each micro-batch goes through a batch job (an upsert or a sweep); a replayed batch has the same id."""
    return stream.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def latest_into(table: Store, key: str, order: list[str], written: list[str]) -> Callable[[DataFrame, int], None]:
    """A batch job for ``upsert_batches``: the last row of each key in the batch goes into a stored table.  A batch that comes
    again writes the same rows again."""

    def apply(batch: DataFrame, number: int) -> None:
        last = batch.groupBy(key, table.part).agg(F.max_by(F.struct(*written), F.struct(*order)).alias("_sw_last"))
        table.upsert(last.select(key, table.part, *[F.col("_sw_last").getField(c).alias(c) for c in written]), written)

    return apply


def events_stream(spark: SparkSession, path: str) -> DataFrame:
    """The events as they lie; times have no zone."""
    return spark.readStream.schema("event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string").option("maxFilesPerTrigger", 1).parquet(path)
