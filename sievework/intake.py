"""Queries of the ingest, each with SQL written by hand from the landed values, not from the projections."""
from __future__ import annotations

import uuid

from pyspark.sql import Window
from pyspark.sql import functions as F

from . import queries as Q
from .functions import scalars as S
from .functions.dialect import CHECK
from .operators import ingest, staging
from .plans import landing, postings as P
from .sources import boards

query = Q.query
_FLAT = f"({landing.flat_sql(CHECK)})"
_K = "cast(k as varchar)"
_N = "cast(n as varchar)"

_GREENHOUSE = f"""(select {_N} as id, title, case when k % 3 = 0 then 'Company ' || {_K} else upper(slug[1]) || slug[2:] end as company, slug, place, case when place = '' then 'United States' else place end as shown,
replace(replace(concat('<h2>About</h2><p>', body, '</p>&nbsp;<b>Apply&#33;</b>'), '<', '&lt;'), '>', '&gt;') as body, case when n % 7 <> 0 and n % 13 = 0 then timestamp '1999-01-01' else posted_at end as posted_at,
case when n % 5 = 0 then '' else concat('https://jobs.example.org/', slug, '/', {_N}) end as apply_url, contains(lower(place), 'remote') as is_remote, cast(null as varchar) as own_work_type, 'us' as country, true as listed, true as detailed, ats, k
from {_FLAT} where ats = 'greenhouse')"""
_PLACES = "case when n % 4 <> 2 then place when place = '' then 'Remote, US' else place || ', Remote, US' end"
_ASHBY = f"""(select 'ashby_' || {_N} as id, title, case when k % 5 = 0 then 'Known Name ' || {_K} else case k % 4 when 0 then 'Base Ten ' || {_K} when 1 then 'North Wind Labs' || {_K} when 2 then 'BlueSky' || {_K} else 'Co' || {_K} end end as company, slug,
{_PLACES} as place, case when place = '' then {_PLACES} else place end as shown, body, posted_at, case when n % 2 = 0 then 'https://job.example.org/' || {_N} else 'https://apply.example.org/' || {_N} end as apply_url,
n % 7 = 0 or contains(lower({_PLACES}), 'remote') as is_remote, cast(null as varchar) as own_work_type, 'us' as country, n % 5 <> 0 as listed, true as detailed, ats, k from {_FLAT} where ats = 'ashby')"""
_SPOT = "case when n % 4 in (0, 1) then place when place = '' then 'TX' else place || ', TX' end"
_REMOTE = r"((n % 5 = 0 and n % 10 <> 0) or regexp_matches(title, '(?i)\bremote\b'))"
_SMART = f"""(select 'sr_' || {_N} as id, title, case when k % 5 = 0 then 'Known Name ' || {_K} else case k % 4 when 0 then 'base ten' when 1 then 'north wind labs' when 2 then 'Blue Sky' else 'co' end end as company, slug,
{_SPOT} as place, {_SPOT} as shown, concat('About us.', chr(10), '<p>', body, chr(10), chr(10), 'Sponsorship&#xa0;is open.') as body, posted_at,
case when n % 2 = 0 and n % 9 <> 5 then 'https://apply.example.org/' || {_N} else concat('https://jobs.smartrecruiters.com/', slug, '/', {_N}) end as apply_url, {_REMOTE} or contains(lower({_SPOT}), 'remote') as is_remote,
case when n % 6 = 1 then 'Hybrid' when {_REMOTE} then 'Remote US' end as own_work_type, case n % 8 when 3 then 'ca' else 'us' end as country, true as listed, n % 9 <> 5 as detailed, ats, k from {_FLAT} where ats = 'smartrecruiters')"""
_ROW = ", ".join(c for c in boards.ROW if c not in ("own_work_type", "country", "listed", "detailed", "body"))


def _judged(days: int = ingest.MAX_AGE_DAYS, boards_of: str = "k % 11 <> 3") -> str:
    """Gate by gate; the text is stripped where no cheap gate stopped the row."""
    kind = S.location_kind(CHECK, "place")
    return f"""(select *, case when stopped is not null then stopped when {S.disqualified(CHECK, "concat(title, ' ', text)")} then 'disqualified' when {S.contract(CHECK, 'text', 'title')} then 'contract' else 'saved' end as verdict
from (select *, case when stopped is null then case when ats = 'ashby' then body else {S.strip_html(CHECK, 'body')} end end as text from (select *, case when not listed then 'delisted' when posted_at is null and ats <> 'greenhouse' then 'no_date'
when posted_at < timestamp '{P.NOW}' - interval {days} day then 'old' when country <> 'us' or (place = '' and ats <> 'greenhouse') or (place <> '' and {kind} not in ('us', 'weak-us', 'ambiguous')) then 'non_us' when not detailed then 'detail_failed' end as stopped
from (select * from {_GREENHOUSE} union all select * from {_ASHBY} union all select * from {_SMART}) where {boards_of})))"""


_ALL = _judged()


def parsed(spark, sf):
    names = landing.names(spark, sf)
    return ingest.parsed(landing.greenhouse(spark, sf), landing.ashby(spark, sf), landing.smart(spark, sf), landing.smart_details(spark, sf), names, landing.fetch_log(spark, sf))


def judged(spark, sf, days: int = ingest.MAX_AGE_DAYS):
    return ingest.judged(parsed(spark, sf), P.NOW, days)


@query("source_greenhouse", f"select {_ROW} from {_GREENHOUSE}")
def source_greenhouse(spark, sf):
    return boards.greenhouse_rows(landing.greenhouse(spark, sf)).selectExpr(*_ROW.split(", "))


@query("source_ashby", f"select {_ROW}, listed from {_ASHBY}")
def source_ashby(spark, sf):
    return boards.ashby_rows(landing.ashby(spark, sf), landing.names(spark, sf)).selectExpr(*_ROW.split(", "), "listed")


@query("source_smart", f"select {_ROW}, own_work_type, country, detailed from {_SMART}")
def source_smart(spark, sf):
    return boards.smart_rows(landing.smart(spark, sf), landing.smart_details(spark, sf), landing.names(spark, sf)).selectExpr(*_ROW.split(", "), "own_work_type", "country", "detailed")


@query("union_sources", f"select ats as source, count(*) as n, count(distinct slug) as boards from (select ats, slug from {_GREENHOUSE} union all select ats, slug from {_ASHBY} union all select ats, slug from {_SMART}) group by ats")
def union_sources(spark, sf):
    names = landing.names(spark, sf)
    rows = boards.all_sources(
        boards.greenhouse_rows(landing.greenhouse(spark, sf)), boards.ashby_rows(landing.ashby(spark, sf), names), boards.smart_rows(landing.smart(spark, sf), landing.smart_details(spark, sf), names))
    return rows.groupBy(F.col("ats").alias("source")).agg(F.count("*").alias("n"), F.count_distinct("slug").alias("boards"))


@query("display_name_join", f"select id, company from {_ASHBY} union all select id, company from {_SMART}")
def display_name_join(spark, sf):
    """Names by the map, and where it has none made from the slug, each source in its own way."""
    names = landing.names(spark, sf)
    return boards.ashby_rows(landing.ashby(spark, sf), names).select("id", "company").unionByName(boards.smart_rows(landing.smart(spark, sf), landing.smart_details(spark, sf), names).select("id", "company"))


@query("ingest_funnel", f"select ats, verdict, count(*) as n from {_ALL} group by ats, verdict")
def ingest_funnel(spark, sf):
    return ingest.funnel(judged(spark, sf))


@query("ingest_funnel_week", f"select ats, verdict, count(*) as n from {_judged(7)} group by ats, verdict")
def ingest_funnel_week(spark, sf):
    """The same run with another limit on age."""
    return ingest.funnel(judged(spark, sf, 7))


@query("posting_verdict", f"select id, verdict from {_ALL}")
def posting_verdict(spark, sf):
    return judged(spark, sf).select("id", "verdict")


_SAVED = {
    "description": "substring(text, 1, 500)", "sponsor_badge": "false", "field": S.category(CHECK, "title"), "needs_license": S.licence(CHECK, "title"), "fetched_at": f"timestamp '{P.NOW}'",
    "experience_level": S.experience_level(CHECK, "title"), "work_type": f"coalesce(own_work_type, {S.work_type(CHECK, 'place', 'text')})", "state": S.state_of(CHECK, "place"), "salary_min": S.salary(CHECK, "text", 1),
    "salary_max": S.salary(CHECK, "text", 2), "employment_type": S.employment_type(CHECK, "text"), "years_min": S.years(CHECK, "text", 1), "years_max": S.years(CHECK, "text", 2)}


@query("ingest_rows", f"select id, title, company, slug as company_slug, shown as location, is_remote, apply_url, posted_at, ats, {', '.join(f'{v} as {k}' for k, v in _SAVED.items())} from {_ALL} where verdict = 'saved'")
def ingest_rows(spark, sf):
    return ingest.saved(judged(spark, sf), P.NOW)


# a run over what a run of five days ago left, which reached every board and kept postings of 35 days
_BEFORE = f"(select id, ats, company, posted_at, k, timestamp '{P.NOW}' - interval 5 day as fetched_at from {_judged(35, 'true')} where verdict = 'saved')"
_RUN = f"""with n as (select id, ats, company, posted_at, k, timestamp '{P.NOW}' as fetched_at from {_ALL} where verdict = 'saved'), m as (select * from n union all select * from {_BEFORE} where id not in (select id from n)),
s as (select *, fetched_at < timestamp '{P.NOW}' and k % 11 <> 3 as stale from m), t as (select *, count(*) filter (stale) over (partition by ats) > 0.25 * count(*) over (partition by ats) as stopped from s),
u as (select *, posted_at is not null and posted_at < timestamp '{P.NOW}' - interval {ingest.MAX_AGE_DAYS} day as old from t where not stale or stopped), v as (select *, count(*) filter (old) over () > 0.25 * count(*) over () as kept from u),
w as (select * from v where not old or kept)"""


def _whole_run(spark, sf):
    table, log = ingest.stored(spark, f"{staging.folder(spark)}/sievework-{uuid.uuid4().hex}"), landing.fetch_log(spark, sf)
    rows = lambda known: ingest.parsed(landing.greenhouse(spark, sf), landing.ashby(spark, sf), landing.smart(spark, sf), landing.smart_details(spark, sf), landing.names(spark, sf), known)
    before = ingest.saved(ingest.judged(rows(log.withColumn("ok", F.lit(True))), P.NOW, 35), P.NOW)
    table.create(before.withColumns({"fetched_at": F.expr(f"timestamp_ntz '{P.NOW}' - interval '5' day"), "closed": F.lit(False)}))
    return table, rows(log), log


@query("ingest_run", f"{_RUN} select id, ats, company, posted_at, fetched_at from w")
def ingest_run(spark, sf):
    """A run from landed rows to the stored table: gates, upsert, sweep and purge behind their guards."""
    table, rows, log = _whole_run(spark, sf)
    ingest.run(table, rows, log, P.NOW)
    return table.read().select("id", "ats", "company", "posted_at", "fetched_at")


@query("ingest_report", f"""{_RUN} select ats, verdict as measure, count(*) as n from {_ALL} group by ats, verdict union all select ats, 'stored', count(*) from w group by ats
union all select ats, case when any_value(stopped) then 'sweep stopped' else 'swept' end, 1 from t group by ats union all select null, case when any_value(kept) then 'purge stopped' else 'purged' end, 1 from v""")
def ingest_report(spark, sf):
    table, rows, log = _whole_run(spark, sf)
    return ingest.run(table, rows, log, P.NOW)


@query("ingest_dry_run", f"select ats, verdict as measure, count(*) as n from {_ALL} group by ats, verdict")
def ingest_dry_run(spark, sf):
    """The counts of a run that writes nothing."""
    table = ingest.stored(spark, f"{staging.folder(spark)}/sievework-{uuid.uuid4().hex}")
    return ingest.run(table, parsed(spark, sf), landing.fetch_log(spark, sf), P.NOW, dry=True)


@query("verdict_companies", f"select verdict, company, n from (select verdict, company, count(*) as n, row_number() over (partition by verdict order by count(*) desc, company) as place from {_ALL} group by verdict, company) where place <= 5")
def verdict_companies(spark, sf):
    counts = judged(spark, sf).groupBy("verdict", "company").agg(F.count("*").alias("n"))
    return counts.withColumn("place", F.row_number().over(Window.partitionBy("verdict").orderBy(F.desc("n"), "company"))).filter("place <= 5").drop("place")
