"""Keyed state with expiry: ask once about a job a user left for, and a cache of answers.  Batch forms beside the streams.

Events of one key must arrive in order from batch to batch, as a partitioned log gives them; within a batch they are put
in order.  State is small (a few ids a key) and leaves by event-time timers; rows are written by a sink that takes each
batch once, so a replayed batch changes nothing.
"""
from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

HOUR = 3_600_000_000
DAY = 24 * HOUR
ASKS = "user_id long, job_id long, company string, left_at long, asked_at long"


def step(state: dict, kind: str, job: int | None, company: str | None, at: int, window: int) -> tuple | None:
    """One event on a user's state (left: job -> [when, company], in the order first left; asked, applied: jobs).

    Coming back asks about the first job left within the window and not asked about yet; if that one is applied for, nothing.
    What the window has passed is dropped."""
    for old in [j for j, (when, _) in state["left"].items() if at - when >= window]:
        del state["left"][old]
    if kind == "leave":
        state["left"][str(job)] = [at, company or state["left"].get(str(job), [0, None])[1]]
    elif kind == "apply":
        state["applied"] = sorted({*state["applied"], job})
    elif kind == "return":
        for j, (when, name) in state["left"].items():
            if int(j) not in state["asked"]:
                if int(j) in state["applied"]:
                    return None
                state["asked"] = sorted({*state["asked"], int(j)})
                return int(j), name or "this employer", when, at
    return None


def asked(events: DataFrame, window: int = HOUR, idle: str = "30 days", late: str = "1 hour") -> DataFrame:
    """events: user_id, kind (leave, return, apply), job_id, company, ts (timestamp), micros (the same as a number), seq.

    A stream of questions.  A user's state goes when nothing came from them for ``idle``."""

    def ask(key: tuple, batches: Iterator[pd.DataFrame], held: GroupState) -> Iterator[pd.DataFrame]:
        if held.hasTimedOut:
            held.remove()
            return
        state = json.loads(held.get[0]) if held.exists else {"left": {}, "asked": [], "applied": []}
        rows = pd.concat(list(batches)).sort_values(["micros", "seq"], kind="stable")
        out = []
        for kind, job, company, at in zip(rows["kind"], rows["job_id"], rows["company"], rows["micros"], strict=True):
            found = step(state, kind, None if pd.isna(job) else int(job), None if pd.isna(company) else company, int(at), window)
            if found:
                out.append((key[0], *found))
        held.update((json.dumps(state),))
        held.setTimeoutTimestamp(max(held.getCurrentWatermarkMs(), int(rows["micros"].max()) // 1000) + idle_ms)
        yield pd.DataFrame(out, columns=["user_id", "job_id", "company", "left_at", "asked_at"])

    idle_ms = int(pd.Timedelta(idle).total_seconds() * 1000)
    return events.withWatermark("ts", late).groupBy("user_id").applyInPandasWithState(ask, ASKS, "state string", "append", GroupStateTimeout.EventTimeTimeout)


LOOKUPS = "key string, seq long, micros long, answer double, age long"


def looked_up(events: DataFrame, ttl: int = 30 * DAY, late: str = "1 hour") -> DataFrame:
    """events: key, kind (put, get), value, ts, micros, seq.  One row for each get: the cached answer and its age, null on a miss.

    An answer lives for ``ttl`` after it was put; a timer drops it then."""

    def look(key: tuple, batches: Iterator[pd.DataFrame], held: GroupState) -> Iterator[pd.DataFrame]:
        if held.hasTimedOut:
            held.remove()
            return
        at, value = held.get if held.exists else (None, None)
        rows = pd.concat(list(batches)).sort_values(["micros", "seq"], kind="stable")
        out = []
        for kind, v, now, seq in zip(rows["kind"], rows["value"], rows["micros"], rows["seq"], strict=True):
            if kind == "put":
                at, value = int(now), float(v)
            elif at is not None and now - at < ttl:
                out.append((key[0], int(seq), int(now), value, int(now - at)))
            else:
                out.append((key[0], int(seq), int(now), None, None))
        if at is not None:
            held.update((at, value))
            held.setTimeoutTimestamp(max(held.getCurrentWatermarkMs() + 1, (at + ttl) // 1000))
        yield pd.DataFrame(out, columns=["key", "seq", "micros", "answer", "age"]).astype({"answer": "float64", "age": "Int64"})

    return events.withWatermark("ts", late).groupBy("key").applyInPandasWithState(look, LOOKUPS, "at long, value double", "append", GroupStateTimeout.EventTimeTimeout)


def looked_up_batch(events: DataFrame, ttl: int = 30 * DAY) -> DataFrame:
    """The same over a table: one window down each key."""
    down = Window.partitionBy("key").orderBy("micros", "seq").rowsBetween(Window.unboundedPreceding, -1)
    rows = events.withColumn("put", F.last(F.when(F.col("kind") == "put", F.struct("micros", "value")), True).over(down)).filter("kind = 'get'")
    age = F.col("micros") - F.col("put.micros")
    return rows.select("key", "seq", "micros", F.when(age < ttl, F.col("put.value")).alias("answer"), F.when(age < ttl, age).alias("age"))


def run_to_end(stream: DataFrame, out: str, checkpoint: str) -> DataFrame:
    """Takes all that is there, writes it once and returns what was written; started again, it takes only what is new."""
    query = stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(out)
