"""The ranked, filtered, paged listing and its folded cards."""
from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import column, rules, scalars

PAGE_SIZE = 20
WINDOWS = {"today": 1, "3days": 3, "week": 7, "2weeks": 14, "month": 30}
CATEGORIES = (*dict.fromkeys(c for _, c in rules.CATEGORY_RULES), "Other")


@dataclass(frozen=True)
class Search:
    """What a reader asks for.  Unknown fields and windows are ignored, as is a page below 1."""

    query: str = ""
    role: str = ""
    work_type: str = ""
    experience_level: str = ""
    state: str = ""
    field: str = ""
    time_posted: str = ""
    page: int = 1

    @property
    def words(self) -> str:
        return self.query.strip() or self.role.strip()


def matching(jobs: DataFrame, search: Search, now: str) -> DataFrame:
    """Open jobs without a licence need that fit; cheap tests come first, text tests last."""
    out = jobs.filter(~F.coalesce("closed", F.lit(False)))
    days = WINDOWS.get(search.time_posted)
    if days:
        out = out.filter(F.col("posted_at") >= F.expr(f"timestamp_ntz '{now}' - interval '{days}' day"))
    for name, wanted in (("work_type", search.work_type), ("experience_level", search.experience_level), ("state", search.state)):
        if wanted:
            out = out.filter(F.col(name) == wanted)
    if search.field in CATEGORIES:
        out = out.filter(F.col("field") == search.field)
    out = out.filter(~F.coalesce("needs_license", F.lit(False)))
    if search.words:
        out = out.filter(column(scalars.found_by, search.words, "title", "company"))
    return out


def ranked(jobs: DataFrame, search: Search) -> tuple[DataFrame, list[Column]]:
    """jobs with tier, day and score, and the order of the listing; the id makes it total."""
    if not search.words:
        return jobs, [F.desc_nulls_last("posted_at"), F.asc("id")]
    out = jobs.withColumns({"tier": column(scalars.tier, "title", search.words), "day": F.date_format("posted_at", "yyyy-MM-dd"), "score": column(scalars.score, "title", search.words)})
    return out, [F.desc("tier"), F.desc_nulls_last("day"), F.desc("score"), F.desc_nulls_last("posted_at"), F.asc("id")]


def page(jobs: DataFrame, search: Search, now: str) -> DataFrame:
    """One page: a top-k, never a full sort of the table."""
    out, order = ranked(matching(jobs, search, now), search)
    return out.orderBy(*order).offset((max(1, search.page) - 1) * PAGE_SIZE).limit(PAGE_SIZE)


def totals(jobs: DataFrame, search: Search, now: str) -> DataFrame:
    return matching(jobs, search, now).agg(F.count("*").alias("total")).withColumn("pages", F.greatest(F.lit(1).cast("long"), F.ceil(F.col("total") / PAGE_SIZE)))


#: What a card keeps of each of its rows.
VARIANT = ("id", "location", "apply_url", "state", "work_type", "closed")


def folded(rows: DataFrame, order: list[Column]) -> DataFrame:
    """One card for each title and company (case apart): all fields of its first row, its rows' variants in order, and their
    number.  Cards keep the columns that the order reads, so they can be put in it again.

    Meant for a page; over a whole table it is the exact fold, where a card's list is as long as its group.
    """
    key = [F.lower(F.coalesce("title", F.lit(""))), F.lower(F.coalesce("company", F.lit("")))]
    numbered = rows.withColumns({"_sw_title": key[0], "_sw_company": key[1]}).withColumn("_sw_place", F.row_number().over(Window.partitionBy("_sw_title", "_sw_company").orderBy(*order)))
    cards = numbered.groupBy("_sw_title", "_sw_company").agg(
        F.min_by(F.struct(*rows.columns), "_sw_place").alias("first"), F.array_sort(F.collect_list(F.struct("_sw_place", *VARIANT))).alias("found"), F.count("*").alias("location_count"))
    return cards.select("first.*", "location_count", F.transform("found", lambda v: F.struct(*[v[c].alias(c) for c in VARIANT])).alias("locations"))
