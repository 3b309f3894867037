"""Landed source files: their schemas, readers and projections into one posting schema.

The three kinds of boards land as JSON lines; no schema is inferred.  Bad values become null, never errors.
"""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalars

GREENHOUSE = "id BIGINT, title STRING, location STRUCT<name: STRING>, content STRING, absolute_url STRING, company_name STRING, first_published STRING, updated_at STRING"
ASHBY = (
    "id STRING, title STRING, isListed BOOLEAN, publishedAt STRING, location STRING, secondaryLocations ARRAY<STRUCT<location: STRING>>, descriptionPlain STRING, "
    "descriptionHtml STRING, isRemote BOOLEAN, applyUrl STRING, jobUrl STRING")
SMART = "id STRING, name STRING, releasedDate STRING, location STRUCT<city: STRING, region: STRING, country: STRING, remote: BOOLEAN, hybrid: BOOLEAN>"
SMART_DETAIL = "id STRING, applyUrl STRING, jobAd STRUCT<sections: MAP<STRING, STRUCT<text: STRING>>>"
FETCH_LOG = "slug STRING, ok BOOLEAN, status INT, attempt INT"


def read_json(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).json(path)


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """One trimmed, non-blank value a line."""
    return spark.read.text(path).select(F.regexp_replace("value", scalars.ENDS, "").alias("value")).filter("value <> ''")


def read_map(spark: SparkSession, path: str) -> DataFrame:
    """A JSON object of strings as (key, value) rows."""
    whole = spark.read.text(path, wholetext=True)
    return whole.select(F.explode(F.from_json("value", "map<string,string>")))


def first_time(*columns: str):
    """The first non-blank value, as a time if it is one; an unreadable first value does not fall through."""
    return F.try_to_timestamp(F.coalesce(*[F.nullif(F.col(c), F.lit("")) for c in columns]))


def or_default(value, default):
    return F.coalesce(F.nullif(F.trim(value), F.lit("")), default)


def greenhouse_name(slug):
    """The slug with its first letter raised."""
    return F.concat(F.upper(F.substring(slug, 1, 1)), F.substr(slug, F.lit(2)))


def ashby_name(slug):
    """Hyphens, underscores and dots to spaces, the first letter of every word raised."""
    words = F.split(F.regexp_replace(slug, "[-_.]+", " "), r"(?<![A-Za-z0-9_])(?=[A-Za-z0-9_])")
    return F.trim(F.array_join(F.transform(words, greenhouse_name), ""))


def smart_name(slug):
    """Without the number at its end; hyphens, underscores, dots and changes of case to spaces."""
    spaced = F.regexp_replace(F.regexp_replace(slug, "[0-9]+$", ""), "[-_.]+", " ")
    return F.trim(F.regexp_replace(spaced, "([a-z])([A-Z])", "$1 $2"))


def _named(rows: DataFrame, names: DataFrame, otherwise) -> DataFrame:
    """company: the map's name of a slug unless it is blank, else one made from the slug.  The map has one row a slug."""
    known = names.select(F.col("slug"), F.nullif("name", F.lit("")).alias("known"))
    return rows.join(known, "slug", "left").withColumn("company", F.coalesce("known", otherwise)).drop("known")


def _time(*columns: str):
    """The first non-blank value as a time without a zone (UTC); null if it is none."""
    return F.to_utc_timestamp(first_time(*columns).cast("timestamp"), F.current_timezone()).cast("timestamp_ntz")


#: What the three projections share.
ROW = ("id", "title", "company", "slug", "place", "shown", "body", "posted_at", "apply_url", "is_remote", "own_work_type", "country", "listed", "detailed", "ats")


def _row(rows: DataFrame, **made) -> DataFrame:
    default = {"own_work_type": F.lit(None).cast("string"), "country": F.lit("us"), "listed": F.lit(True), "detailed": F.lit(True), "company": F.col("company"), "slug": F.col("slug")}
    return rows.select(*[(made | {k: v for k, v in default.items() if k not in made})[c].alias(c) for c in ROW])


def greenhouse_rows(rows: DataFrame) -> DataFrame:
    place = F.coalesce("location.name", F.lit(""))
    return _row(
        rows, id=F.col("id").cast("string"), title=F.coalesce("title", F.lit("")), company=or_default(F.col("company_name"), greenhouse_name(F.col("slug"))), place=place, shown=F.coalesce(F.nullif(place, F.lit("")), F.lit("United States")),
        body=F.col("content"), posted_at=_time("first_published", "updated_at"), apply_url=F.coalesce("absolute_url", F.lit("")), is_remote=F.contains(F.lower(place), F.lit("remote")), ats=F.lit("greenhouse"))


def ashby_rows(rows: DataFrame, names: DataFrame) -> DataFrame:
    """The gates read all places of a posting, the reader sees its first; a missing mark counts as listed."""
    places = F.filter(F.concat(F.array("location"), F.coalesce(F.col("secondaryLocations.location"), F.array().cast("array<string>"))), lambda x: F.coalesce(x, F.lit("")) != "")
    rows = _named(rows, names, ashby_name(F.col("slug"))).withColumn("place", F.array_join(places, ", "))
    return _row(
        rows, id=F.concat(F.lit("ashby_"), "id"), title=F.coalesce("title", F.lit("")), place=F.col("place"), shown=F.coalesce(F.nullif("location", F.lit("")), "place"), body=F.col("descriptionPlain"), posted_at=_time("publishedAt"),
        apply_url=F.coalesce(F.nullif("applyUrl", F.lit("")), "jobUrl", F.lit("")), is_remote=F.coalesce("isRemote", F.lit(False)) | F.contains(F.lower("place"), F.lit("remote")), listed=F.coalesce("isListed", F.lit(True)), ats=F.lit("ashby"))


def smart_rows(rows: DataFrame, details: DataFrame, names: DataFrame) -> DataFrame:
    """List rows with their details; ``detailed`` is false where the second call gave none."""
    city, region = F.nullif("location.city", F.lit("")), F.nullif("location.region", F.lit(""))
    place = F.when(F.lower(city) == F.lower(region), city).otherwise(F.concat_ws(", ", city, region))
    remote = F.coalesce("location.remote", F.lit(False)) | F.coalesce(F.col("name").rlike(r"(?i)\bremote\b"), F.lit(False))
    body = F.array_join(F.transform(F.map_values("jobAd.sections"), lambda s: F.coalesce(s["text"], F.lit(""))), "\n")
    both = rows.withColumn("posting", F.struct("*")).select("slug", "posting", F.col("id").alias("key")).join(details.withColumnRenamed("id", "key").withColumn("found", F.lit(True)), "key", "left").select("posting.*", "applyUrl", "jobAd", "found")
    both = _named(both, names, smart_name(F.col("slug"))).withColumn("place", place)
    return _row(
        both, id=F.concat(F.lit("sr_"), "id"), title=F.coalesce("name", F.lit("")), place=F.col("place"), shown=F.col("place"), body=body, posted_at=_time("releasedDate"),
        apply_url=F.coalesce(F.nullif("applyUrl", F.lit("")), F.concat(F.lit("https://jobs.smartrecruiters.com/"), F.url_encode("slug"), F.lit("/"), "id")),
        is_remote=remote | F.contains(F.lower("place"), F.lit("remote")), own_work_type=F.when(F.coalesce("location.hybrid", F.lit(False)), "Hybrid").when(remote, "Remote US"),
        country=F.lower(F.trim(F.coalesce("location.country", F.lit("")))), detailed=F.coalesce("found", F.lit(False)), ats=F.lit("smartrecruiters"))


def us_gate(ats, location, country, kind):
    """Whether a posting counts as one in the US: a blank place passes for one source only, another gives the country too."""
    us = kind.isin("us", "weak-us", "ambiguous")
    return F.when(ats == "greenhouse", (location == "") | us).when(ats == "ashby", (location != "") & us).otherwise(us & (F.lower(country) == "us"))


def all_sources(*parts: DataFrame) -> DataFrame:
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out
