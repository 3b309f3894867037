"""The application log: an ordered fold of what users did, status changes by owners, and the saved profile."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import column, scalars

#: Profile fields that a resume states; an empty one is reported.
STATED = ("field", "targetRole", "degree")
LONGEST_RESUME = 100_000


def folded_applications(events: DataFrame, track_direct: bool = False) -> DataFrame:
    """One row for each user and job: user_id, job_id, seq (the order of events), ts, title, company, resume, attach_only,
    score_before, score_after.

    An event without a resume counts only with ``track_direct``.  The first counted event that is not attach_only inserts;
    what comes before it is ignored.  Later ones update: a blank title or company keeps the last that was not blank; the
    last resume and its scores stay; a resume counts as sent from the first apply that carried one on.
    """
    optimized = F.coalesce(F.col("resume"), F.lit("")) != ""
    counted = events.filter(optimized | F.lit(track_direct)).withColumn("attach_only", F.coalesce("attach_only", F.lit(False)))
    start = F.min(F.when(~F.col("attach_only"), F.col("seq"))).over(Window.partitionBy("user_id", "job_id"))
    rows = counted.withColumn("start", start).filter(F.col("seq") >= F.col("start"))
    last = lambda c, when: F.max_by(c, F.when(when, F.col("seq")))
    said = lambda c: F.coalesce(last(c, F.coalesce(F.col(c), F.lit("")) != ""), F.lit("")).alias(c)
    return rows.groupBy("user_id", "job_id").agg(
        said("title"), said("company"), F.lit("opened").alias("status"), last("resume", optimized).alias("resume"), F.max(optimized).alias("optimized"),
        F.coalesce(F.max(optimized & ~F.col("attach_only")), F.lit(False)).alias("resume_was_sent"), last("score_before", optimized).alias("score_before"), last("score_after", optimized).alias("score_after"),
        F.min("ts").alias("applied_at"), F.max_by("ts", "seq").alias("updated_at"))


def changed_status(log: DataFrame, changes: DataFrame) -> DataFrame:
    """changes: user_id, job_id, action (opened, applied or delete), seq, ts.  The owner's last change wins; others' and
    unknown actions do nothing; a deleted row stays deleted."""
    known = changes.filter(F.col("action").isin("opened", "applied", "delete"))
    last = known.groupBy("user_id", "job_id").agg(
        F.max_by("action", F.when(F.col("action") != "delete", F.col("seq"))).alias("new_status"), F.max_by("ts", F.when(F.col("action") != "delete", F.col("seq"))).alias("changed_at"),
        F.max(F.col("action") == "delete").alias("gone"))
    both = log.join(last, ["user_id", "job_id"], "left").filter(~F.coalesce("gone", F.lit(False)))
    return both.withColumns({"status": F.coalesce("new_status", "status"), "updated_at": F.coalesce("changed_at", "updated_at")}).drop("new_status", "changed_at", "gone")


def listed(log: DataFrame, user: int) -> DataFrame:
    """A user's applications, the newest first, without the resumes."""
    return log.filter(F.col("user_id") == user).drop("resume").orderBy(F.desc("applied_at"), "job_id")


def attachable(events: DataFrame, log: DataFrame) -> DataFrame:
    return events.filter("attach_only").join(log.select("user_id", "job_id"), ["user_id", "job_id"], "left_semi")


def saved_resumes(rows: DataFrame) -> DataFrame:
    """Rows whose resume has text and is not too long, trimmed."""
    bare = F.regexp_replace("resume", r"^\s+|\s+$", "")
    return rows.filter((bare != "") & (F.length("resume") <= LONGEST_RESUME)).withColumn("resume", bare)


def saved_profiles(rows: DataFrame, fields: list[str]) -> DataFrame:
    """Trimmed fields, the category of the target role ('' where it tells none), and which stated fields are missing."""
    out = rows.withColumns({c: F.trim(F.coalesce(F.col(c), F.lit(""))) for c in fields})
    guess = column(scalars.category, "targetRole")
    out = out.withColumn("field", F.when((F.col("targetRole") == "") | (guess == "Other"), "").otherwise(guess))
    return out.withColumn("missing", F.filter(F.array(*[F.when(F.col(c) == "", c) for c in STATED]), lambda x: x.isNotNull()))


def fresh_cache(rows: DataFrame, now: str, days: int = 30) -> DataFrame:
    """The last entry of each key that is not older than ``days``."""
    last = rows.groupBy("key").agg(F.max("created_at").alias("created_at"), F.max_by("score", "created_at").alias("score"))
    return last.filter(F.col("created_at") > F.expr(f"timestamp_ntz '{now}' - interval '{days}' day"))


def next_open(rows: DataFrame, order: list[Column], usable: Column, partition: str) -> DataFrame:
    """The id a reader moves on to from each row: the next usable one below, else the nearest above.

    Both directions are running frames, one step a row; a frame from a row to the end would be gone through again for each
    row.  The second goes by the places of the first, so that rows of equal order stand alike in both."""
    down, up = Window.partitionBy(partition).orderBy(*order), Window.partitionBy(partition).orderBy(F.desc("_sw_place"))
    nearest = lambda way: F.last(F.when(usable, F.col("id")), ignorenulls=True).over(way.rowsBetween(Window.unboundedPreceding, -1))
    placed = rows.withColumns({"_sw_above": nearest(down), "_sw_place": F.row_number().over(down)})
    return placed.withColumn("next_id", F.coalesce(nearest(up), F.col("_sw_above"))).drop("_sw_above", "_sw_place")
