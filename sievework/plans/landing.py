"""Rows as the three kinds of boards land them, made from the provided tables, and their flat SQL twin.

Every order is a posting of one source.  Its text is two pool sentences and, where a document has the order's number, that
whole document; its date lies within 80 days before ``NOW``, is missing or is unreadable.
"""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.dialect import SPARK, Dialect
from ..sources import boards
from .postings import BODIES, LOCATIONS, NOW, TITLES

SOURCES = ("greenhouse", "ashby", "smartrecruiters")


def _slug(k: str) -> str:
    return f"case c_custkey % 97 % 4 when 0 then concat('base-ten-', {k}) when 1 then concat('north_wind.labs', {k}) when 2 then concat('BlueSky', {k}) else concat('co', {k}) end"


def flat_sql(d: Dialect, orders: str = "orders", customer: str = "customer", documents: str = "documents") -> str:
    """n, ats, k, slug, title, place, body, posted_at (null if missing or unreadable), posted (as it lands)."""
    text = "string" if d.spark else "varchar"
    k = f"cast(c_custkey % 97 as {text})"
    days = "o_orderkey * 37 % 80"
    at = f"({d.time(NOW)} - {d.days(days)})"
    written = f"date_format({at}, \"yyyy-MM-dd'T'HH:mm:ss'Z'\")" if d.spark else f"strftime({at}, '%Y-%m-%dT%H:%M:%SZ')"
    slug = _slug(k)
    first, second = (d.pick(BODIES, f"(o_orderkey * {a} + o_custkey * {b}) % {len(BODIES)} + 1") for a, b in ((13, 5), (7, 3)))
    return f"""
select o_orderkey as n, c_custkey % 97 as k, {d.pick(SOURCES, 'o_orderkey % 3 + 1')} as ats, {slug} as slug, {d.pick(TITLES, f'(o_orderkey * 7 + o_custkey) % {len(TITLES)} + 1')} as title,
  {d.pick(LOCATIONS, f'(o_orderkey * 11 + o_custkey * 3) % {len(LOCATIONS)} + 1')} as place, concat({first}, ' ', {second}, case when text is null then '' else concat({d.text(chr(10)) if not d.spark else "char(10)"}, text) end) as body,
  case when o_orderkey % 13 = 0 or o_orderkey % 17 = 0 then null else {at} end as posted_at, case when o_orderkey % 13 = 0 then null when o_orderkey % 17 = 0 then 'soon' else {written} end as posted
from {orders} join {customer} on o_custkey = c_custkey left join {documents} on doc_id = o_orderkey"""


def flat(spark: SparkSession, sf_dir: str) -> DataFrame:
    tables = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("orders", "customer", "documents")}
    sql = flat_sql(SPARK, *[f"<{t}>" for t in tables]).replace("{", "{{").replace("}", "}}")
    for t in tables:
        sql = sql.replace(f"<{t}>", "{" + t + "}")
    return spark.sql(sql, **tables)


def _landed(rows: DataFrame, schema: str, made: str) -> DataFrame:
    """Through JSON and back by the source's schema, as a landed file is read."""
    return rows.select("slug", F.from_json(F.expr(f"to_json({made})"), schema).alias("r")).select("slug", "r.*")


def greenhouse(spark: SparkSession, sf_dir: str) -> DataFrame:
    content = "replace(replace(concat('<h2>About</h2><p>', body, '</p>&nbsp;<b>Apply&#33;</b>'), '<', '&lt;'), '>', '&gt;')"
    made = (
        f"named_struct('id', n, 'title', title, 'location', named_struct('name', place), 'content', {content}, 'absolute_url', if(n % 5 = 0, null, concat('https://jobs.example.org/', slug, '/', n)), "
        "'company_name', case k % 3 when 0 then concat(' Company ', k, ' ') when 1 then ' ' end, 'first_published', if(n % 7 = 0, '', posted), 'updated_at', if(n % 7 = 0, posted, '1999-01-01T00:00:00Z'))")
    return _landed(flat(spark, sf_dir).filter("ats = 'greenhouse'"), boards.GREENHOUSE, made)


def ashby(spark: SparkSession, sf_dir: str) -> DataFrame:
    others = "case n % 4 when 0 then array() when 1 then array(named_struct('location', null), named_struct('location', '')) when 2 then array(named_struct('location', 'Remote, US')) end"
    made = (
        f"named_struct('id', cast(n as string), 'title', title, 'isListed', case n % 5 when 0 then false when 1 then null else true end, 'publishedAt', posted, 'location', place, 'secondaryLocations', {others}, "
        "'descriptionPlain', body, 'isRemote', if(n % 7 = 0, true, null), 'applyUrl', if(n % 2 = 0, '', concat('https://apply.example.org/', n)), 'jobUrl', concat('https://job.example.org/', n))")
    return _landed(flat(spark, sf_dir).filter("ats = 'ashby'"), boards.ASHBY, made)


def smart(spark: SparkSession, sf_dir: str) -> DataFrame:
    region = "case n % 4 when 0 then upper(place) when 1 then '' else 'TX' end"
    country = "case n % 8 when 3 then 'ca' when 5 then ' US ' else 'us' end"
    made = f"named_struct('id', cast(n as string), 'name', title, 'releasedDate', posted, 'location', named_struct('city', place, 'region', {region}, 'country', {country}, 'remote', if(n % 10 = 0, null, n % 5 = 0), 'hybrid', n % 6 = 1))"
    return _landed(flat(spark, sf_dir).filter("ats = 'smartrecruiters'"), boards.SMART, made)


def smart_details(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The answers to the second call; every ninth has none."""
    part = lambda text: f"named_struct('text', {text})"
    sections = f"map('companyDescription', {part(chr(39) + 'About us.' + chr(39))}, 'jobDescription', {part(chr(34) + '<p>' + chr(34) + ' || body')}, 'qualifications', {part('null')}, 'additionalInformation', {part(chr(39) + 'Sponsorship&#xa0;is open.' + chr(39))})"
    made = f"named_struct('id', cast(n as string), 'applyUrl', if(n % 2 = 0, concat('https://apply.example.org/', n), null), 'jobAd', named_struct('sections', {sections}))"
    return _landed(flat(spark, sf_dir).filter("ats = 'smartrecruiters' and n % 9 <> 5"), boards.SMART_DETAIL, made).drop("slug")


def _slugs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """slug, k of every board."""
    customers = spark.read.parquet(f"{sf_dir}/customer.parquet")
    return customers.select(F.expr(_slug("cast(c_custkey % 97 as string)")).alias("slug"), F.expr("c_custkey % 97").alias("k")).distinct()


def names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The map of display names: slug, name; some slugs have a blank one, most none."""
    return _slugs(spark, sf_dir).filter("k % 5 < 2").select("slug", F.expr("if(k % 5 = 0, concat('Known Name ', k), '')").alias("name"))


def fetch_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """slug, ok, status of this run's first call."""
    return _slugs(spark, sf_dir).select("slug", F.expr("k % 11 <> 3").alias("ok"), F.expr("case when k % 11 <> 3 then 200 when k % 2 = 0 then 404 else 0 end").alias("status"))
