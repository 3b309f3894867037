"""What asking the sources again tells: retries, dead boards, postings that closed, counts before and after a rewrite."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import column, scalars

#: A share of recoveries (percent) that means the source was throttling.
THROTTLED = 30


def retry_verdicts(first: DataFrame, second: DataFrame) -> DataFrame:
    """slug, ok and status of two attempts to live, recovered, dead (not found twice) or unreachable."""
    both = first.join(second.select("slug", F.col("ok").alias("ok2"), F.col("status").alias("status2")), "slug", "left")
    verdict = F.when(F.col("ok"), "live").when(F.coalesce("ok2", F.lit(False)), "recovered").when((F.col("status") == 404) & (F.col("status2") == 404), "dead").otherwise("unreachable")
    return both.withColumn("verdict", verdict).select("slug", "verdict")


def retry_report(verdicts: DataFrame) -> DataFrame:
    """One row: how many were tried again and what became of them, the rate of recovery and what it means."""
    n = verdicts.filter("verdict <> 'live'").agg(
        F.count("*").alias("retried"), F.count_if(F.col("verdict") == "recovered").alias("recovered"), F.count_if(F.col("verdict") == "dead").alias("dead"),
        F.count_if(F.col("verdict") == "unreachable").alias("unreachable"))
    rate = F.when(F.col("retried") > 0, F.floor(F.col("recovered") * 100 / F.col("retried") + F.lit(0.5)).cast("long"))
    return n.withColumn("rate", rate).withColumn("cause", F.when(F.col("rate") >= THROTTLED, "throttled").when(F.col("dead") > F.col("unreachable"), "dead boards").otherwise("timeouts"))


def rechecked(jobs: DataFrame, answers: DataFrame, boards: DataFrame) -> DataFrame:
    """jobs with ``closed`` after a live check.

    answers: id, status: of the sources that answer for one posting, 404 closes it and 200 opens it; of the source that answers
    with a whole board, a row of 200 says that the posting is on it.  boards: slug, ok of that source: a posting missing from a
    board that answered is closed.  No answer, or any other status, changes nothing.
    """
    out = jobs.join(answers.select("id", "status"), "id", "left").join(boards.select("slug", F.col("ok").alias("board_ok")), "slug", "left")
    one = F.when(F.col("status") == 404, True).when(F.col("status") == 200, False)
    board = F.when(F.col("board_ok"), ~F.coalesce(F.col("status") == 200, F.lit(False)))
    return out.withColumn("closed", F.coalesce(F.when(F.col("ats") == "ashby", board).otherwise(one), "closed")).drop("status", "board_ok")


def job_details(jobs: DataFrame, answers: DataFrame, boards: DataFrame) -> DataFrame:
    """id, description and closed as a reader of one posting gets them: the live text where the source gives one, else the stored
    head; entities are decoded for the source that escapes its markup.  answers: id, status, live."""
    told = rechecked(jobs, answers, boards).join(answers.filter("status = 200").select("id", F.nullif("live", F.lit("")).alias("live")), "id", "left")
    live = F.when(F.col("ats") == "greenhouse", F.when(F.col("live").isNotNull(), column(scalars.decode_entities, "live"))).otherwise(F.col("live"))
    # a board that did not answer gives no text
    heard = F.when((F.col("ats") == "ashby") & ~F.coalesce("heard", F.lit(False)), F.lit(None)).otherwise(live)
    told = told.join(boards.filter("ok").select("slug", F.lit(True).alias("heard")), "slug", "left")
    return told.select("id", F.coalesce(heard, "description", F.lit("")).alias("description"), F.coalesce("closed", F.lit(False)).alias("closed"))


def shapes(probes: DataFrame, names: list[str]) -> DataFrame:
    """slug, shape, status to one row a slug: whether each shape of its address answers, and whether any does."""
    out = probes.groupBy("slug").agg(*[F.coalesce(F.max(F.when(F.col("shape") == n, F.col("status") == 200)), F.lit(False)).alias(n) for n in names])
    return out.withColumn("alive", F.greatest(*names))


def reconciled(before: DataFrame, after: DataFrame, label: str) -> DataFrame:
    """Counts of a label in the preview and in the table that was written, and whether they agree."""
    a, b = before.groupBy(label).agg(F.count("*").alias("preview")), after.groupBy(label).agg(F.count("*").alias("written"))
    both = a.join(b, a[label].eqNullSafe(b[label]), "full_outer").select(F.coalesce(a[label], b[label]).alias(label), F.coalesce("preview", F.lit(0)).alias("preview"), F.coalesce("written", F.lit(0)).alias("written"))
    return both.withColumn("agrees", F.col("preview") == F.col("written"))
