"""Named queries over the provided tables, each with the SQL that checks it."""
from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import column, rules
from .functions import scalars as S
from .functions.dialect import CHECK, SPARK, Dialect
from .operators import documents, gates, listing, maintenance
from .plans import postings as P
from .plans import resumes as R

SEARCH = listing.Search(query="data engineer")
CUTOFF = "2001-07-02 00:00:00"


def _jobs(d: Dialect) -> dict[str, str]:
    return {
        "field": S.category(d, "title"), "needs_license": S.licence(d, "title"), "experience_level": S.experience_level(d, "title"),
        "work_type": S.work_type(d, "location", "plain"), "state": S.state_of(d, "location"), "salary_min": S.salary(d, "plain", 1), "salary_max": S.salary(d, "plain", 2),
        "years_min": S.years(d, "plain", 1), "years_max": S.years(d, "plain", 2),
    }


#: Different values that are classified apart and broadcast.
MOST_VALUES = 10_000


def per_value(df: DataFrame, name: str, made: dict[str, str], most: int = MOST_VALUES) -> DataFrame:
    """df with columns that depend on one of its own: where that has few different values, worked out once for each of them
    and broadcast; else in place.  Their number is counted first, over that column alone; df itself is never shuffled."""
    values = df.select(name).distinct()
    if values.limit(most + 1).count() > most:
        return df.withColumns({k: F.expr(v) for k, v in made.items()})
    values = values.withColumns({k: F.expr(v) for k, v in made.items()}).withColumnRenamed(name, "_value")
    return df.join(F.broadcast(values), F.col(name).eqNullSafe(F.col("_value")), "left").drop("_value")


#: The columns of jobs that a title or a place alone decides.
_BY = {"title": ("field", "needs_license", "experience_level"), "location": ("state",)}


def jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Postings with everything extracted."""
    made, out = _jobs(SPARK), P.postings(spark, sf_dir)
    for name, columns in _BY.items():
        out = per_value(out, name, {c: made.pop(c) for c in columns})
    out = out.withColumns({"company_slug": F.col("slug"), "is_remote": F.contains(F.lower("location"), F.lit("remote"))})
    return out.withColumn("plain", column(S.strip_html, "body")).withColumns({k: F.expr(v) for k, v in made.items()})


_POSTINGS = f"({P.sql(CHECK)})"
_JOBS = f"(select *, {', '.join(f'{v} as {k}' for k, v in _jobs(CHECK).items())} from (select *, {S.strip_html(CHECK, 'body')} as plain, slug as company_slug, contains(lower(location), 'remote') as is_remote from {_POSTINGS}))"


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def _both(name: str, made: Callable[[Dialect], dict[str, str]], source: str = "postings", keep: tuple[str, ...] = ("id",), where: Callable[[Dialect], str] | None = None, group: bool = False, per: str = "") -> None:
    """A projection (or its counts) written once: columns by name, over one source; ``per`` names the one column they need,
    so that they are made once for each of its values."""
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        df = {"postings": P.postings, "jobs": jobs}[source](spark, sf_dir) if source in ("postings", "jobs") else spark.read.parquet(f"{sf_dir}/{source}.parquet")
        if where is not None:
            df = df.filter(F.expr(where(SPARK)))
        if per:
            df = per_value(df.select(*keep, per), per, made(SPARK)).select(*keep, *made(SPARK))
        else:
            df = df.select(*keep, *[F.expr(v).alias(k) for k, v in made(SPARK).items()])
        return df.groupBy(*made(SPARK)).agg(F.count("*").alias("n")) if group else df

    names = list(made(CHECK))
    inner = ", ".join([*keep, *[f"{v} as {k}" for k, v in made(CHECK).items()]])
    base = {"postings": _POSTINGS, "jobs": _JOBS}.get(source, source)
    text = f"select {inner} from {base}" + (f" where {where(CHECK)}" if where is not None else "")
    QUERIES[name] = run
    ORACLES[name] = f"select {', '.join(names)}, count(*) as n from ({text}) group by {', '.join(names)}" if group else text


def query(name: str, oracle: str | None = None):
    def add(f):
        QUERIES[name] = f
        if oracle:
            ORACLES[name] = oracle
        return f
    return add


# gates and classification
_both("age_gate", lambda d: {"kept": f"(posted_at is null or posted_at >= {d.time(CUTOFF)})", "kept_dated": f"coalesce(posted_at >= {d.time(CUTOFF)}, false)"})
_both("location_kind", lambda d: {"kind": S.location_kind(d, "location")}, per="location")
_both("is_us", lambda d: {"is_us": f"({S.location_kind(d, 'location')} in ('us', 'weak-us', 'ambiguous'))"}, per="location")
_both("state_extract", lambda d: {"state": S.state_of(d, "location")}, per="location")
_plain = lambda d: S.strip_html(d, "body")
_said = lambda d: f"concat(coalesce(title, ''), ' ', {_plain(d)})"
_both("disqualified", lambda d: {"disqualified": S.disqualified(d, _said(d))})
_both("disqualifier_rule", lambda d: {"rule": S.disqualifier(d, S.normalised(d, _said(d)))})
_both("contract_flag", lambda d: {"contract": d.let(_plain(d), "plain", S.contract(d, "plain", "title"))})
_both("category_counts", lambda d: {"field": S.category(d, "title")}, keep=(), group=True, per="title")
_both("license_flag", lambda d: {"needs_license": S.licence(d, "title")}, per="title")
_both("experience_level", lambda d: {"level": S.experience_level(d, "title")}, per="title")
_both("work_type", lambda d: {"work_type": S.work_type(d, "location", _plain(d))})
_both("salary_extract", lambda d: {f"salary_{n}": d.let(_plain(d), "plain", S.salary(d, "plain", i)) for i, n in ((1, "min"), (2, "max"))})
_both("years_extract", lambda d: {f"years_{n}": d.let(_plain(d), "plain", S.years(d, "plain", i)) for i, n in ((1, "min"), (2, "max"))})
_both("employment_type", lambda d: {"employment_type": S.employment_type(d, "body")})
_both("experience_breakdown", lambda d: {"experience_level": "experience_level"}, source="jobs", keep=(), group=True)
_both("work_type_breakdown", lambda d: {"work_type": "work_type"}, source="jobs", keep=(), group=True)
_both("red_flags", lambda d: {"flags": d.joined(S.red_flags(d, "body"), "; ")})
_both("snippet", lambda d: {"context": f"case when {d.match('lower(body)', 'sponsor')} then {S.snippet(d, 'body', d.at('lower(body)', 'sponsor'), '7', 12)} end"})
_both("phrase_signature", lambda d: {"signature": S.phrase_signature(d, "body")}, keep=(), group=True, where=lambda d: S.refuses_sponsor(d, "body"))
_both("sponsor_mentions", lambda d: {"mentions": d.match("lower(coalesce(body, ''))", rules.SPONSOR_MENTION), "refuses": S.refuses_sponsor(d, "body"), "other": d.any_match("lower(concat(title, ' ', body))", rules.OTHER_HINTS)})
# HTML and text
_both("strip_html", lambda d: {"plain": S.strip_html(d, "html")}, source="pages", keep=("page_id",))
_both("strip_html_plain_entities", lambda d: {"plain": S.strip_html(d, "html", False)}, source="pages", keep=("page_id",))
_both("decode_entities", lambda d: {"decoded": S.decode_entities(d, "html")}, source="pages", keep=("page_id",))
_both("escape_html", lambda d: {"escaped": S.escape_html(d, "text")}, source="benchmark", keep=("item_id",))
_both("looks_like_resume", lambda d: {"signs": S.resume_signs(d, "text"), "is_resume": f"{S.resume_signs(d, 'text')} >= 2"}, source="documents", keep=("doc_id",))
_both("assess_extraction", lambda d: {"status": S.extraction_status(d, "text")}, source="documents", keep=(), group=True)
_both("title_histogram", lambda d: {"stem": S.title_stem(d, "title")}, keep=(), group=True, per="title")
_both("cache_key", lambda d: {"cache_key": S.cache_key(d, "text", "lang")}, source="documents", keep=("doc_id",))
_both("content_words", lambda d: {"words": d.size(S.content_words(d, "text"))}, source="documents", keep=("doc_id",))
_both("skill_filter", lambda d: {"kept": S.keep_skill(d, "p_brand"), "type_kept": S.keep_skill(d, "upper(substring(p_name, 1, 5))")}, source="part", keep=("p_partkey",))
_both("number_tokens", lambda d: {"numbers": d.size(d.distinct(d.groups("text", "[0-9]+(?:[.,][0-9]+)*%?")))}, source="documents", keep=("doc_id",))
# formatting
_both("format_salary", lambda d: {"label": S.salary_label(d, "salary_min", "salary_max")}, source="jobs")
_both("format_years", lambda d: {"label": S.years_label(d, "years_min", "years_max")}, source="jobs")
_both("time_ago", lambda d: {"label": S.age_label(d, "posted_at", d.time(P.NOW))})
_both("age_buckets", lambda d: {"bucket": S.age_bucket(d, "posted_at", d.time(P.NOW))}, keep=(), group=True)
_both("short_location", lambda d: {"label": S.short_location(d, "location")}, per="location")
# listing predicates
_both("any_word_match", lambda d: {"found": S.found_by(d, "data nurse", "title", "company")})
_both("rank_tier", lambda d: {"tier": S.tier(d, "title", SEARCH.query), "score": S.score(d, "title", SEARCH.query)}, per="title")
_both("dq_missing", lambda d: {"no_url": "coalesce(apply_url, '') = ''", "no_place": "coalesce(location, '') = ''", "no_date": "posted_at is null"}, keep=(), group=True)
_both("url_shape", lambda d: {"odd_url": f"not coalesce({d.match('apply_url', '^https://')}, false)"}, keep=(), group=True)


@query("category_pct", f"select field, count(*) as n, 100.0 * count(*) / sum(count(*)) over () as pct from {_JOBS} group by field")
def category_pct(spark, sf):
    counts = jobs(spark, sf).groupBy("field").agg(F.count("*").alias("n"))
    return counts.crossJoin(F.broadcast(counts.agg(F.sum("n").alias("all")))).select("field", "n", (F.lit(100.0) * F.col("n") / F.col("all")).alias("pct"))


@query("license_by_category", f"select field, count(*) as n, count(*) filter (where needs_license) as hidden from {_JOBS} group by field")
def license_by_category(spark, sf):
    return jobs(spark, sf).groupBy("field").agg(F.count("*").alias("n"), F.count_if("needs_license").alias("hidden"))


_OPEN = f"not coalesce(closed, false) and not coalesce(needs_license, false)"
_CARD = ("id", "title", "company", "company_slug", "location", "is_remote", "apply_url", "posted_at", "work_type", "experience_level", "state", "salary_min", "salary_max", "years_min", "years_max", "closed")


@query("listing_recent", f"select {', '.join(_CARD)} from {_JOBS} where {_OPEN} order by posted_at desc nulls last, id limit 20")
def listing_recent(spark, sf):
    return listing.page(jobs(spark, sf), listing.Search(), P.NOW).select(*_CARD)


_FOUND = f"select *, {S.tier(CHECK, 'title', SEARCH.query)} as tier, strftime(posted_at, '%Y-%m-%d') as day, {S.score(CHECK, 'title', SEARCH.query)} as score from {_JOBS} where {_OPEN} and {S.found_by(CHECK, SEARCH.query, 'title', 'company')}"
_RANKED = "order by tier desc, day desc nulls last, score desc, posted_at desc nulls last, id"


@query("listing_ranked", f"select {', '.join(_CARD)} from ({_FOUND}) {_RANKED} limit 20 offset 20")
def listing_ranked(spark, sf):
    return listing.page(jobs(spark, sf), listing.Search(query=SEARCH.query, page=2), P.NOW).select(*_CARD)


@query("listing_total_pages", f"select count(*) as total, greatest(1, cast(ceil(count(*) / 20.0) as bigint)) as pages from ({_FOUND})")
def listing_total_pages(spark, sf):
    return listing.totals(jobs(spark, sf), SEARCH, P.NOW)


@query("listing_fold", f"""with p as (select *, row_number() over ({_RANKED}) as nth from ({_FOUND}) {_RANKED} limit 20), q as (select *, row_number() over (partition by lower(title), lower(company) order by nth) as place from p)
select max(case when place = 1 then id end) as id, max(case when place = 1 then title end) as title, max(case when place = 1 then company end) as company, max(case when place = 1 then salary_min end) as salary_min, count(*) as location_count,
string_agg(concat_ws('|', id, location, coalesce(apply_url, '?'), coalesce(state, '?'), work_type, coalesce(cast(closed as varchar), '?')), ',' order by place) as variants, cast(row_number() over (order by min(nth)) as int) as card from q group by lower(title), lower(company)""")
def listing_fold(spark, sf):
    found, order = listing.ranked(listing.matching(jobs(spark, sf), SEARCH, P.NOW), SEARCH)
    cards = listing.folded(found.orderBy(*order).limit(20), order).orderBy(*order)
    told = F.array_join(F.transform("locations", lambda x: F.concat_ws("|", *[F.coalesce(x[c].cast("string"), F.lit("?")) for c in listing.VARIANT])), ",")
    # a page: its cards are numbered as they are read
    numbered = cards.groupBy().agg(F.collect_list(F.struct("id", "title", "company", "salary_min", "location_count", told.alias("variants"))).alias("c")).select(F.posexplode("c").alias("p", "c"))
    return numbered.select("c.*", (F.col("p") + 1).alias("card"))


@query("time_window", f"select count(*) as n from {_JOBS} where {_OPEN} and posted_at >= timestamp '{P.NOW}' - interval 30 day")
def time_window(spark, sf):
    return listing.matching(jobs(spark, sf), listing.Search(time_posted="month"), P.NOW).agg(F.count("*").alias("n"))


@query("filtered_listing", f"select id from {_JOBS} where {_OPEN} and work_type = 'Remote US' and experience_level = 'Senior' and field = 'Tech'")
def filtered_listing(spark, sf):
    return listing.matching(jobs(spark, sf), listing.Search(work_type="Remote US", experience_level="Senior", field="Tech"), P.NOW).select("id")


@query("stats_by_field", f"select field, count(*) as total from {_JOBS} where not coalesce(closed, false) group by field")
def stats_by_field(spark, sf):
    return jobs(spark, sf).filter(~F.coalesce("closed", F.lit(False))).groupBy("field").agg(F.count("*").alias("total"))


_NEW = f"(select id, title, concat(company, ' Inc') as company, cast(null as varchar) as location from {_POSTINGS} where fetched_at >= timestamp '2000-06-01' union all select concat('new_', cast(c_custkey as varchar)), 'Data Engineer', c_name, 'Remote' from customer )"


@query("upsert_latest", f"""select coalesce(n.id, o.id) as id, case when n.id is not null then n.title else o.title end as title, case when n.id is not null then n.company else o.company end as company,
case when n.id is not null then n.location else o.location end as location, o.slug from {_POSTINGS} o full outer join {_NEW} n on o.id = n.id""")
def upsert_latest(spark, sf):
    old = P.postings(spark, sf).select("id", "title", "company", "location", "slug", "fetched_at")
    fresh = old.filter("fetched_at >= timestamp_ntz '2000-06-01'").select("id", "title", F.concat("company", F.lit(" Inc")).alias("company"), F.lit(None).cast("string").alias("location"))
    extra = spark.read.parquet(f"{sf}/customer.parquet").selectExpr("concat('new_', c_custkey) as id", "'Data Engineer' as title", "c_name as company", "'Remote' as location")
    return maintenance.upsert(old.drop("fetched_at"), fresh.unionByName(extra), "id", ["title", "company", "location"])


@query("latest_per_slug", f"select slug, id, fetched_at from (select *, row_number() over (partition by slug order by fetched_at desc, id) as place from {_POSTINGS}) where place = 1")
def latest_per_slug(spark, sf):
    return maintenance.latest(P.postings(spark, sf), "slug", [F.desc("fetched_at"), F.asc("id")]).select("slug", "id", "fetched_at")


def _swept(run_start: str) -> str:
    doomed = f"coalesce(ats = 'ashby' and cast(substring(slug, 3) as bigint) % 2 = 0 and fetched_at < timestamp '{run_start}', false)"
    return f"select id from {_POSTINGS} where not ({doomed}) or (select count(*) filter (where {doomed}) > 0.25 * count(*) filter (where ats = 'ashby') from {_POSTINGS})"


def _answered(spark, sf):
    return P.postings(spark, sf).select("slug").distinct().filter("cast(substring(slug, 3) as bigint) % 2 = 0")


@query("stale_sweep", _swept("1996-01-01 00:00:00"))
def stale_sweep(spark, sf):
    return maintenance.stale_sweep(P.postings(spark, sf), _answered(spark, sf), "ashby", "1996-01-01 00:00:00").select("id")


@query("guard_abort", _swept(P.RUN_START))
def guard_abort(spark, sf):
    return maintenance.stale_sweep(P.postings(spark, sf), _answered(spark, sf), "ashby", P.RUN_START).select("id")


@query("age_purge", f"select id from {_POSTINGS} where not coalesce(posted_at < timestamp '1996-01-01', false) or (select count(*) filter (where posted_at < timestamp '1996-01-01') > 0.25 * count(*) from {_POSTINGS})")
def age_purge(spark, sf):
    return maintenance.age_purge(P.postings(spark, sf), "1996-01-01 00:00:00").select("id")


@query("null_outliers", f"select id, case when years_min <= 5 then years_min end as years_min, case when years_max <= 5 then years_max end as years_max from {_JOBS}")
def null_outliers(spark, sf):
    return maintenance.null_out(jobs(spark, sf), ["years_min", "years_max"], 5).select("id", "years_min", "years_max")


@query("delete_disqualified", f"select id from {_POSTINGS} where not {S.disqualified(CHECK, _said(CHECK))}")
def delete_disqualified(spark, sf):
    return P.postings(spark, sf).filter(~F.expr(S.disqualified(SPARK, _said(SPARK)))).select("id")


_APPS = "(select distinct concat('job_', cast(o_orderkey as varchar)) as job_id from orders where o_orderpriority = '1-URGENT')"


def _applied(spark, sf):
    return spark.read.parquet(f"{sf}/orders.parquet").filter("o_orderpriority = '1-URGENT'").select(F.concat(F.lit("job_"), F.col("o_orderkey").cast("string")).alias("job_id")).distinct().withColumn("status", F.lit("applied"))


@query("hide_applied", f"select id from {_POSTINGS} where id not in (select job_id from {_APPS})")
def hide_applied(spark, sf):
    return maintenance.hide_applied(P.postings(spark, sf).select("id"), _applied(spark, sf))


@query("left_join_apps", f"select id, job_id is not null as applied from {_POSTINGS} p left join {_APPS} a on p.id = a.job_id")
def left_join_apps(spark, sf):
    return P.postings(spark, sf).join(_applied(spark, sf), F.col("id") == F.col("job_id"), "left").select("id", F.col("job_id").isNotNull().alias("applied"))


@query("slug_except", f"select distinct slug from {_POSTINGS} except select concat('co', cast(s_suppkey * 2 as varchar)) from supplier")
def slug_except(spark, sf):
    known = spark.read.parquet(f"{sf}/supplier.parquet").select(F.concat(F.lit("co"), (F.col("s_suppkey") * 2).cast("string")).alias("slug"))
    return P.postings(spark, sf).select("slug").distinct().join(known, "slug", "left_anti")


#: Fixed values.  A board's name in a link, and what stands there without being one.
SLUG = r"greenhouse\.io/(?:embed/job_board\?for=)?([a-zA-Z0-9_-]+)"
NOT_SLUGS = ("embed", "job_board", "jobs", "v1", "boards", "api")
_LINK = "case doc_id % 4 when 0 then concat(' https://job-boards.greenhouse.io/co', cast(doc_id % 120 as varchar), '/jobs/9 and ') when 1 then concat(chr(10), '(https://boards.greenhouse.io/embed/job_board?for=New_', cast(doc_id % 40 as varchar), ')') when 2 then ' boards-api.greenhouse.io/v1/boards ' else '' end"


@query("slug_harvest", f"""select slug, slug in (select slug from {_POSTINGS}) as known from (select distinct unnest(regexp_extract_all(said, '{SLUG}', 1)) as slug from (select concat(coalesce(text, ''), {_LINK}, coalesce(lang, '')) as said from documents union all
select concat(coalesce(url, ''), ' ', coalesce(html, '')) from pages)) where lower(slug) not in ({', '.join(f"'{x}'" for x in NOT_SLUGS)})""")
def slug_harvest(spark, sf):
    """Names of boards in links anywhere in free texts, and whether they are known."""
    link = F.expr(_LINK.replace("varchar", "string").replace("chr(10)", "char(10)"))
    said = _docs(spark, sf).select(F.concat(F.coalesce("text", F.lit("")), link, F.coalesce("lang", F.lit(""))).alias("said"))
    said = said.unionByName(spark.read.parquet(f"{sf}/pages.parquet").select(F.concat_ws(" ", F.coalesce("url", F.lit("")), F.coalesce("html", F.lit(""))).alias("said")))
    slugs = said.select(F.explode(F.regexp_extract_all("said", F.lit(SLUG), F.lit(1))).alias("slug")).filter(~F.lower("slug").isin(*NOT_SLUGS)).distinct()
    known = P.postings(spark, sf).select("slug").distinct().withColumn("known", F.lit(True))
    return slugs.join(known, "slug", "left").withColumn("known", F.coalesce("known", F.lit(False)))


@query("dup_ids", "select count(*) as duplicated, coalesce(sum(n), 0)::bigint as rows from (select concat('job_', cast(l_orderkey as varchar)) as id, count(*) as n from lineitem group by 1 having count(*) > 1)")
def dup_ids(spark, sf):
    ids = spark.read.parquet(f"{sf}/lineitem.parquet").select(F.concat(F.lit("job_"), F.col("l_orderkey").cast("string")).alias("id"))
    return ids.groupBy("id").agg(F.count("*").alias("n")).filter("n > 1").agg(F.count("*").alias("duplicated"), F.coalesce(F.sum("n"), F.lit(0)).cast("long").alias("rows"))


@query("distinct_companies", f"select count(*) as companies from (select apply_url from {_POSTINGS} group by apply_url)")
def distinct_companies(spark, sf):
    """The group of nulls counts as one."""
    return P.postings(spark, sf).agg((F.count_distinct("apply_url") + F.max(F.col("apply_url").isNull().cast("int"))).cast("long").alias("companies"))


@query("top_companies", f"select company, count(*) as n from {_POSTINGS} group by company order by n desc, company limit 5")
def top_companies(spark, sf):
    return P.postings(spark, sf).groupBy("company").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "company").limit(5)


@query("dq_completeness", f"select count(*) as n, avg(case when salary_min is not null then 1.0 else 0.0 end) as salary, avg(case when state is not null then 1.0 else 0.0 end) as state, avg(case when years_min is not null then 1.0 else 0.0 end) as years, count(*) filter (where salary_min > salary_max) as odd from {_JOBS}")
def dq_completeness(spark, sf):
    share = lambda c: F.avg(F.col(c).isNotNull().cast("double"))
    return jobs(spark, sf).agg(F.count("*").alias("n"), share("salary_min").alias("salary"), share("state").alias("state"), share("years_min").alias("years"), F.count_if(F.col("salary_min") > F.col("salary_max")).alias("odd"))


@query("date_spread", f"select ats, count(distinct cast(posted_at as date)) as days, cast(min(cast(posted_at as date)) as varchar) as first_day, cast(max(cast(posted_at as date)) as varchar) as last_day, count(distinct cast(posted_at as date)) < 5 as narrow from (select ats, posted_at from {_POSTINGS} union all select 'slow', posted_at from {_POSTINGS} where id in ('job_1', 'job_2', 'job_3')) group by ats")
def date_spread(spark, sf):
    day = F.to_date("posted_at")
    rows = P.postings(spark, sf).select("ats", "posted_at", F.explode(F.when(F.col("id").isin("job_1", "job_2", "job_3"), F.array("ats", F.lit("slow"))).otherwise(F.array("ats"))).alias("source"))
    found = rows.groupBy(F.col("source").alias("ats")).agg(F.count_distinct(day).alias("days"), F.min(day).cast("string").alias("first_day"), F.max(day).cast("string").alias("last_day"))
    return found.withColumn("narrow", F.col("days") < 5)


@query("word_histogram", "select word, count(*) as docs from (select distinct doc_id, unnest(regexp_extract_all(lower(text), '[a-z]{3,}')) as word from documents) group by word order by docs desc, word limit 150")
def word_histogram(spark, sf):
    words = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", F.explode(F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]{3,}"), F.lit(0)))).alias("word"))
    return words.groupBy("word").agg(F.count("*").alias("docs")).orderBy(F.desc("docs"), "word").limit(150)


@query("samples_per_group", f"select field, id from (select field, id, row_number() over (partition by field order by id) as place from {_JOBS}) where place <= 5")
def samples_per_group(spark, sf):
    return _first_five(jobs(spark, sf))


def _first_five(rows: DataFrame) -> DataFrame:
    from pyspark.sql import Window

    return rows.select("field", "id").withColumn("place", F.row_number().over(Window.partitionBy("field").orderBy("id"))).filter("place <= 5").drop("place")


@query("drop_reasons", f"select kind, company, n from (select kind, company, count(*) as n, row_number() over (partition by kind order by count(*) desc, company) as place from (select {S.location_kind(CHECK, 'location')} as kind, company from {_POSTINGS}) group by kind, company) where place <= 5")
def drop_reasons(spark, sf):
    from pyspark.sql import Window

    counts = P.postings(spark, sf).select(column(S.location_kind, "location").alias("kind"), "company").groupBy("kind", "company").agg(F.count("*").alias("n"))
    return counts.withColumn("place", F.row_number().over(Window.partitionBy("kind").orderBy(F.desc("n"), "company"))).filter("place <= 5").drop("place")


# documents
_LINES = "(select doc_id, unnest(string_split(text, chr(10))) as line, generate_subscripts(string_split(text, chr(10)), 1) - 1 as line_no from documents)"
_T = f"regexp_replace(line, '{S.ENDS}', '', 'g')"
_HEADER = f"(regexp_matches({_T}, '^[A-Z][A-Z &/]{{2,40}}$') and len(string_split({_T}, ' ')) <= 4)"
_SHORT_HEADER = _HEADER.replace("{2,40}", "{2,30}")


def _docs(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet")


@query("doc_dashes", f"select doc_id, line_no, {_T} as line from ({R.sql(CHECK, 1)}) where regexp_matches(line, '[—–]|--')")
def doc_dashes(spark, sf):
    return documents.dashed(R.lines(spark, sf, 1))


@query("doc_carry_section", f"select doc_id, line_no, last_value(case when {_HEADER} then {_T} end ignore nulls) over (partition by doc_id order by line_no rows between unbounded preceding and current row) as section from {_LINES}")
def doc_carry_section(spark, sf):
    return documents.with_section(documents.lines(_docs(spark, sf))).select("doc_id", F.col("line_no").cast("long").alias("line_no"), "section")


@query("doc_title_lookahead", rf"""with k as (select doc_id, line_no, t, case when regexp_matches(t, {CHECK.text(rules.RESUME_SECTION)}) then 'section' when regexp_matches(t, '^[•–-]') then 'bullet' when contains(t, ' | ') and (contains(t, 'Present') or regexp_matches(t, '\b(Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec)\b|\b(19|20)\d{{2}}\b')) then 'role'
when regexp_matches(t, '^[A-Za-z][A-Za-z /&+-]{{1,48}}:\s+.+$') and not contains(t, ' | ') and not regexp_matches(t, 'https?:|www\.|@') and len(string_split_regex(regexp_replace(string_split(t, ':')[1], '{S.ENDS}', '', 'g'), '\s+')) <= 6 then 'skill'
when t <> '' and length(t) <= 32 and not regexp_matches(t, '[.,;:|]') and len(string_split_regex(t, '\s+')) <= 4 and t = upper(t) and regexp_matches(t, '[A-Z]') then 'section' else 'text' end as own from (select doc_id, line_no, {_T} as t from ({R.sql(CHECK, 1)})))
select doc_id, line_no, case when line_no < coalesce(body, 1000000) then 'header' when own = 'text' and t <> '' and following = 'role' then 'title' else own end as kind from (select *, lead(own) over (partition by doc_id order by line_no) as following, min(case when own = 'section' and line_no > 0 then line_no end) over (partition by doc_id) as body from k)""")
def doc_title_lookahead(spark, sf):
    return documents.kinds(R.lines(spark, sf, 1)).select("doc_id", "line_no", "kind")


@query("doc_bullet_count", r"""select doc_id, cast(len(list_filter(list_transform(string_split(text, chr(10)), lambda x: regexp_replace(regexp_replace(x, 'ENDS', '', 'g'), '^[-•*▪]\s*', '')), lambda x: length(x) >= 40 and not regexp_matches(x, '^[A-Z][A-Z\s&/:]*$') and not regexp_matches(x, '(?i)^Environment\s*:') and regexp_matches(x, '\s'))) as bigint) as bullets from documents""".replace("ENDS", S.ENDS))
def doc_bullet_count(spark, sf):
    return documents.bullet_counts(_docs(spark, sf)).withColumn("bullets", F.col("bullets").cast("long"))


_RUNS = "select distinct {key}unnest(list_transform(generate_series(1, len(w) - 3), lambda i: array_to_string(list_slice(w, i, i + 3), ' '))) as run from (select {key}list_filter(string_split_regex(lower(text), '[^a-z0-9]+'), lambda x: x <> '') as w from {table}) where len(w) >= 4"


@query("lifted_4grams", f"select doc_id, count(*) as lifted from ({_RUNS.format(key='doc_id, ', table='documents')}) where run in (select run from ({_RUNS.format(key='', table='benchmark')})) group by doc_id")
def lifted_4grams(spark, sf):
    return documents.lifted(_docs(spark, sf), spark.read.parquet(f"{sf}/benchmark.parquet"))


@query("keyword_score", f"""with p as (select id, cast(floor(cast(substring(id, 5) as bigint) / {R.SIZE}) as bigint) as doc_id, list_distinct({S.content_words(CHECK, "concat(title, ' ', plain)")}) as words from {_JOBS}),
d as (select doc_id, lower(string_agg(line, chr(10) order by line_no)) as said from ({R.sql(CHECK, 1)}) group by doc_id) select id, cast(len(list_filter(words, lambda w: contains(said, w))) as int) as matched, cast(len(words) as int) as total,
case when len(words) = 0 then 0 else cast(floor(100.0 * len(list_filter(words, lambda w: contains(said, w))) / len(words) + 0.5) as bigint) end as score from p join d on p.doc_id = d.doc_id""")
def keyword_score(spark, sf):
    """The keywords of each posting, matched in the text of a draft."""
    from .operators import drafts

    words = F.array_distinct(gates.work_words(F.concat_ws(" ", "title", column(S.strip_html, "body"))))
    rows = P.postings(spark, sf).select("id", F.floor(F.expr("cast(substring(id, 5) as bigint)") / R.SIZE).alias("doc_id"), words.alias("words"))
    both = rows.join(drafts.whole(R.lines(spark, sf, 1)), "doc_id")
    return both.select("id", *drafts.keyword_match(F.col("words"), F.col("text")))


# a draft against its original
_OLD, _NEW_LINES = f"({R.sql(CHECK, 0)})", f"({R.sql(CHECK, 1)})"


def _carried(source: str, header: str = _HEADER) -> str:
    down = "partition by doc_id order by line_no rows between unbounded preceding and current row"
    return f"""(select *, last_value(case when regexp_matches({_T}, '{gates.ROLE}') then {_T} end ignore nulls) over (partition by doc_id, part order by line_no rows between unbounded preceding and current row) as role
from (select *, {header} as is_header, last_value(case when {header} then {_T} end ignore nulls) over ({down}) as section, sum(case when {header} then 1 else 0 end) over ({down}) as part from {source}))"""


def _in(values) -> str:
    return ", ".join(CHECK.text(v) for v in values)


_FIRST = rf"regexp_replace(lower(list_extract(string_split_regex(regexp_replace({_T}, '^[•–-]\s*', ''), '\s+'), 1)), '[^a-z]', '', 'g')"


@query("doc_past_tense", rf"""select doc_id, line_no, {_T} as line from {_carried(_OLD)} where not is_header and contains(section, 'EXPERIENCE') and regexp_matches(role, '(?i)\bpresent\b') and not regexp_matches({_T}, '{gates.ROLE}')
and regexp_matches({_T}, '^[•–-]\s+') and {_FIRST} <> '' and {_FIRST} not in ({_in(rules.PAST_IDENTICAL)}) and ({_FIRST} in ({_in(rules.IRREGULAR_PAST)}) or {_FIRST} like '%ed')""")
def doc_past_tense(spark, sf):
    return gates.past_tense_in_current_role(R.lines(spark, sf, 0))


_BULLETS = rf"(select doc_id, line_no, regexp_replace({_T}, '^-\s+', '') as bullet from {_carried(_NEW_LINES, _SHORT_HEADER)} where not is_header and contains(section, 'EXPERIENCE') and regexp_matches({_T}, '^-\s+'))"


@query("doc_experience_bullets", f"select * from {_BULLETS}")
def doc_experience_bullets(spark, sf):
    return gates.experience_bullets(R.lines(spark, sf, 1))


@query("doc_cert_dashes", rf"""select doc_id, line_no, case when not is_header and regexp_matches(line, '[—–]|--') and (coalesce(contains(section, 'CERTIF'), false) or (regexp_matches(line, '{gates.CERT_WORD}') and regexp_matches(line, '{gates.CERT_LEVEL}')))
then regexp_replace(line, '\s*(?:[—–]|--)\s*', ' - ', 'g') else line end as line from {_carried(_NEW_LINES)}""")
def doc_cert_dashes(spark, sf):
    return gates.cert_dashes(R.lines(spark, sf, 1))


def _sections(source: str) -> str:
    name = r"regexp_replace(t, '\s+', ' ', 'g')"
    chain = " ".join(f"when regexp_matches({name}, '{p}') then '{title}'" for p, title in gates.SECTION_ALIASES)
    return rf"""(select doc_id, line_no, case {chain} else {name} end as section from (select *, sum(case when t <> '' then 1 else 0 end) over (partition by doc_id order by line_no rows between unbounded preceding and current row) as seen
from (select *, regexp_replace({_T}, '[:：]\s*$', '') as t from {source})) where t <> '' and seen > 3 and length(t) <= 40 and regexp_matches(t, '^[A-Z][A-Z\s&/]*$') and len(string_split_regex(t, '\s+')) <= 4)"""


@query("doc_sections", f"select * from {_sections(_OLD)}")
def doc_sections(spark, sf):
    return gates.section_headers(R.lines(spark, sf, 0))


@query("doc_invented_sections", f"select doc_id, section from {_sections(_NEW_LINES)} except select doc_id, section from {_sections(_OLD)}")
def doc_invented_sections(spark, sf):
    return gates.invented_sections(R.lines(spark, sf, 1), R.lines(spark, sf, 0))


@query("doc_stray_prose", rf"""select doc_id, line_no, {_T} as line from (select *, max(case when regexp_matches({_T}, {CHECK.text(rules.RESUME_SECTION)}) then line_no end) over (partition by doc_id) as last from {_NEW_LINES})
where line_no > last and length({_T}) >= 120 and not regexp_matches({_T}, '^[-•*]') and (regexp_matches({_T}, '(?i)^note\s*:') or regexp_matches({_T}, '\b(?:I|I''m|I''ve|my|me)\b'))""")
def doc_stray_prose(spark, sf):
    return gates.stray_prose(R.lines(spark, sf, 1))


@query("doc_dropped_environment", rf"select doc_id, line_no, {_T} as line from {_OLD} o where regexp_matches({_T}, '(?i)^Environment\s*:') and not exists (select 1 from {_NEW_LINES} n where n.doc_id = o.doc_id and contains(lower(n.line), lower(substring({_T.replace('line', 'o.line')}, 1, 40))))")
def doc_dropped_environment(spark, sf):
    return gates.dropped_environment(R.lines(spark, sf, 1), R.lines(spark, sf, 0))


@query("doc_merged_bullets", rf"select doc_id, line_no, substring({_T}, 1, 140) as line from {_NEW_LINES} where regexp_matches(line, '[a-z0-9][.)]\s*[•▪]\s*[A-Z]')")
def doc_merged_bullets(spark, sf):
    return gates.merged_bullets(R.lines(spark, sf, 1))


@query("doc_invented_bullets", f"""with b as (select doc_id, line_no, bullet, unnest({S.content_words(CHECK, 'bullet')}) as word from {_BULLETS}), k as (select distinct doc_id, unnest({S.content_words(CHECK, 'line')}) as word from {_OLD})
select b.doc_id, line_no, bullet, count(*) as words, count(k.word) as hits from b left join k on b.doc_id = k.doc_id and b.word = k.word group by b.doc_id, line_no, bullet having count(*) >= 4 and count(k.word) < 0.4 * count(*)""")
def doc_invented_bullets(spark, sf):
    return gates.invented_bullets(R.lines(spark, sf, 1), R.lines(spark, sf, 0))


@query("doc_bullet_loss", r"""with c as (select doc_id, v, count(*) filter (where length(t) >= 40 and not regexp_matches(t, '^[A-Z][A-Z\s&/:]*$') and not regexp_matches(t, '(?i)^Environment\s*:') and regexp_matches(t, '\s')) as n
from (select doc_id, 0 as v, regexp_replace({_T}, '^[-•*▪]\s*', '') as t from OLD union all select doc_id, 1, regexp_replace({_T}, '^[-•*▪]\s*', '') from NEW) group by doc_id, v)
select o.doc_id, o.n as before, n.n as after from c o join c n on o.doc_id = n.doc_id where o.v = 0 and n.v = 1 and o.n >= 8 and n.n < o.n * 0.75""".replace("{_T}", _T).replace("OLD", _OLD).replace("NEW", _NEW_LINES))
def doc_bullet_loss(spark, sf):
    def counts(version: int, name: str) -> DataFrame:
        whole = R.lines(spark, sf, version).groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "line"))), lambda x: x["line"]), "\n").alias("text"))
        return documents.bullet_counts(whole).withColumnRenamed("bullets", name)

    both = counts(0, "before").join(counts(1, "after"), "doc_id")
    return both.filter("before >= 8 and after < before * 0.75").select("doc_id", F.col("before").cast("long").alias("before"), F.col("after").cast("long").alias("after"))


_US_FORMS = (r"\b(?:usa|u\.?s\.?a\.?|united\s+states)\b", r"(^|,\s*|\s)(?:" + "|".join(c for _, c in rules.STATES) + r")(\s*,|\s*$)")
_both("looks_us", lambda d: {"looks_us": d.any_match("lower(coalesce(location, ''))", _US_FORMS)}, per="location")
_both("sponsor_badge", lambda d: {"badge": f"({d.any_match(S.normalised(d, 'body'), rules.SPONSOR_SIGNS)} and not {S.disqualified(d, 'body')})", "mentions": d.match("lower(body)", "sponsor")})


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)


from . import audits, catalogue, intake, storage  # noqa: E402,F401  register their queries
