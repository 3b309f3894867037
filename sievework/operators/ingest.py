"""Ingest of landed board rows: one projection for each source, one chain of gates, one table of postings.

The text is stripped once, and only where the cheap gates (listing, date, place, details) let a row through; the rules
on text and title run after them, the extraction on what is saved.  Sources differ in which gates they have:

* an undated posting passes at the first source and stops at the others; an unlisted one exists at the second only;
* a posting without a place passes at the first source only; the third states a country as well, and needs a detail.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import column, scalars
from ..functions.dialect import SPARK
from ..sources import boards
from . import staging
from .store import Store

MAX_AGE_DAYS = 30
HEAD = 500
#: What stops a posting, in the order of the gates.
VERDICTS = ("delisted", "no_date", "old", "non_us", "detail_failed", "disqualified", "contract", "saved")


def parsed(greenhouse: DataFrame, ashby: DataFrame, smart: DataFrame, details: DataFrame, names: DataFrame, log: DataFrame) -> DataFrame:
    """The rows of the boards that answered, all sources in one shape."""
    both = boards.all_sources(boards.greenhouse_rows(greenhouse), boards.ashby_rows(ashby, names), boards.smart_rows(smart, details, names))
    return both.join(log.filter("ok").select("slug").distinct(), "slug", "left_semi")


def _text() -> str:
    return f"if(ats = 'ashby', coalesce(body, ''), {scalars.strip_html(SPARK, 'body')})"


def judged(rows: DataFrame, now: str, max_age_days: int = MAX_AGE_DAYS) -> DataFrame:
    """rows with verdict.  It is one expression that holds each of its parts once, so that a filter on it may be pushed down."""
    ats, cutoff = F.col("ats"), F.expr(f"timestamp_ntz '{now}' - interval '{max_age_days}' day")
    abroad = ~column(scalars.location_kind, "place").isin("us", "weak-us", "ambiguous")
    cheap = (
        F.when(~F.col("listed"), "delisted").when(F.col("posted_at").isNull() & (ats != "greenhouse"), "no_date").when(F.col("posted_at") < cutoff, "old").when(F.col("country") != "us", "non_us")
        .when((F.col("place") == "") & (ats != "greenhouse"), "non_us").when((F.col("place") != "") & abroad, "non_us").when(~F.col("detailed"), "detail_failed"))
    rules = f"case when {scalars.disqualified(SPARK, 'concat(title, chr(32), t)')} then 'disqualified' when {scalars.contract(SPARK, 't', 'title')} then 'contract' else 'saved' end"
    return rows.withColumn("verdict", F.coalesce(cheap, F.expr(SPARK.let(_text(), "t", rules))))


def saved(rows: DataFrame, now: str) -> DataFrame:
    """The 22 stored columns of the judged rows that pass."""
    work_type = F.coalesce("own_work_type", column(scalars.work_type, "place", "text"))
    made: dict[str, Column] = {
        "id": F.col("id"), "title": F.col("title"), "company": F.col("company"), "company_slug": F.col("slug"), "location": F.col("shown"), "is_remote": F.col("is_remote"),
        "description": F.substring("text", 1, HEAD), "apply_url": F.col("apply_url"), "posted_at": F.col("posted_at"), "sponsor_badge": F.lit(False), "field": column(scalars.category, "title"),
        "needs_license": column(scalars.licence, "title"), "ats": F.col("ats"), "fetched_at": F.expr(f"timestamp_ntz '{now}'"), "experience_level": column(scalars.experience_level, "title"), "work_type": work_type,
        "state": column(scalars.state_of, "place"), "salary_min": column(scalars.salary, "text", 1), "salary_max": column(scalars.salary, "text", 2), "employment_type": column(scalars.employment_type, "text"),
        "years_min": column(scalars.years, "text", 1), "years_max": column(scalars.years, "text", 2)}
    return rows.filter("verdict = 'saved'").withColumn("text", F.expr(_text())).select(*[v.alias(k) for k, v in made.items()])


def funnel(rows: DataFrame) -> DataFrame:
    return rows.groupBy("ats", "verdict").agg(F.count("*").alias("n"))


#: The stored table: what a run writes, and a mark that only a live check sets.
STORED = (
    "id string, title string, company string, company_slug string, location string, is_remote boolean, description string, apply_url string, posted_at timestamp_ntz, sponsor_badge boolean, field string, needs_license boolean, "
    "ats string, fetched_at timestamp_ntz, experience_level string, work_type string, state string, salary_min bigint, salary_max bigint, employment_type string, years_min int, years_max int, closed boolean")


def stored(spark: SparkSession, path: str) -> Store:
    return Store(spark, path, STORED, "id", "ats")


def run(table: Store, rows: DataFrame, log: DataFrame, now: str, max_age_days: int = MAX_AGE_DAYS, dry: bool = False) -> DataFrame:
    """A whole run over parsed rows; its report: ats, measure, n.

    What passes is written over what is stored; then, source by source, stored rows of boards that answered and that this run
    did not write go (closed, or no longer passing), and last all rows older than the limit, each behind its guard.  One cutoff
    and one time hold for the whole run.  A dry run counts and writes nothing.
    """
    spark = rows.sparkSession
    found = staging.written(judged(rows, now, max_age_days))
    report = funnel(found).select("ats", F.col("verdict").alias("measure"), "n")
    if dry:
        return report
    fresh = saved(found, now)
    table.upsert(fresh, [c for c in fresh.columns if c not in ("id", "ats")])
    answered = log.filter("ok").select(F.col("slug").alias("company_slug"), F.lit(True).alias("answered")).distinct()
    begun, cutoff = F.expr(f"timestamp_ntz '{now}'"), F.expr(f"timestamp_ntz '{now}' - interval '{max_age_days}' day")
    went = []
    for source in sorted(r.ats for r in found.select("ats").distinct().collect()):
        own = F.col("ats") == source
        went.append((source, "swept" if table.delete(own & F.col("answered") & (F.col("fetched_at") < begun), own, helper=answered, on="company_slug") else "sweep stopped", 1))
    went.append((None, "purged" if table.delete(F.col("posted_at") < cutoff, F.lit(True)) else "purge stopped", 1))
    left = table.read().groupBy("ats").agg(F.lit("stored").alias("measure"), F.count("*").alias("n"))
    return report.unionByName(left).unionByName(spark.createDataFrame(went, "ats string, measure string, n long"))
