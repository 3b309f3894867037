"""Queries of stored tables, file sinks, uploads, streams, marks and numbering, each with SQL written by hand where SQL can."""
from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from . import queries as Q
from .catalogue import _STATUS, _VERDICTS, _verdicts
from .functions import column, rules
from .functions import scalars as S
from .functions.dialect import CHECK, SPARK
from .operators import drafts, marks, numbering, probes, staging, store
from .plans import postings as P
from .plans import resumes as R
from .sources import boards, files, uploads
from .streaming import asks, changes

query = Q.query
_P = Q._POSTINGS


def _table(spark, sf, name):
    return spark.read.parquet(f"{sf}/{name}.parquet")


def _new(spark) -> str:
    return f"{staging.folder(spark)}/sievework-{uuid.uuid4().hex}"


_SCHEMA = "id string, title string, company string, slug string, location string, fetched_at timestamp_ntz, ats string"
_COLUMNS = "id, title, company, slug, location, fetched_at, ats"


def _store(spark, sf) -> store.Store:
    out = store.Store(spark, _new(spark), _SCHEMA, "id", "ats")
    out.create(P.postings(spark, sf).selectExpr(*_COLUMNS.split(", ")))
    return out


_FRESH = f"(select id, 'New title' as title, 'New company' as company, cast(null as varchar) as location, ats from {_P} where ats = 'ashby' and fetched_at >= timestamp '2000-06-01' union all select concat('new_', cast(c_custkey as varchar)), c_name, 'Inc', 'Remote', 'ashby' from customer)"


@query("stored_upsert", f"""select coalesce(n.id, o.id) as id, case when n.id is not null then n.title else o.title end as title, case when n.id is not null then n.company else o.company end as company,
case when n.id is not null then n.location else o.location end as location, o.slug, coalesce(n.ats, o.ats) as ats from {_P} o full outer join {_FRESH} n on o.id = n.id""")
def stored_upsert(spark, sf):
    """An upsert into a table on disk: one source's folders are read and rewritten, the others stay as they are."""
    kept = _store(spark, sf)
    fresh = P.postings(spark, sf).filter("ats = 'ashby' and fetched_at >= timestamp_ntz '2000-06-01'").selectExpr("id", "'New title' as title", "'New company' as company", "cast(null as string) as location", "ats")
    kept.upsert(fresh.unionByName(_table(spark, sf, "customer").selectExpr("concat('new_', c_custkey) as id", "c_name as title", "'Inc' as company", "'Remote' as location", "'ashby' as ats")), ["title", "company", "location"])
    return kept.read().select("id", "title", "company", "location", "slug", "ats")


@query("stored_sweep", Q._swept("1996-01-01 00:00:00"))
def stored_sweep(spark, sf):
    kept = _store(spark, sf)
    answered = Q._answered(spark, sf).withColumn("answered", F.lit(True))
    doomed = (F.col("ats") == "ashby") & F.col("answered") & (F.col("fetched_at") < F.expr("timestamp_ntz '1996-01-01 00:00:00'"))
    kept.delete(doomed, F.col("ats") == "ashby", helper=answered, on="slug")
    return kept.read().select("id")


@query("truncate", f"select 0 as after, count(*) as before from {_P}")
def truncate(spark, sf):
    """A written table loses its rows and stays a table."""
    kept = _store(spark, sf)
    before = kept.read().count()
    kept.truncate()
    return kept.read().agg(F.count("*").cast("int").alias("after"), F.lit(before).cast("long").alias("before"))


@query("backfill_reconcile", f"select field, count(*) as preview, count(*) as written, true as agrees from {Q._JOBS} group by field")
def backfill_reconcile(spark, sf):
    """The counts that the rules promise, against those of the table that was written by them and read back."""
    preview = P.postings(spark, sf).select(column(S.category, "title").alias("field"))
    kept = store.Store(spark, _new(spark), "id string, field string, ats string", "id", "ats")
    kept.create(P.postings(spark, sf).selectExpr("id", "cast(null as string) as field", "ats"))
    kept.upsert(P.postings(spark, sf).select("id", column(S.category, "title").alias("field"), "ats"), ["field"])
    return probes.reconciled(preview, kept.read().select("field"), "field")


@query("slug_files", f"select slug, verdict from {_VERDICTS} where verdict in ('live', 'dead') union all select slug, 'name' from {_STATUS} union all select slug, 'again' from {_VERDICTS} where verdict = 'unreachable'")
def slug_files(spark, sf):
    """Lists of live and of dead boards as JSON arrays and a map of names as a JSON object, written and read back."""
    folder, out = _new(spark), None
    verdicts = staging.written(_verdicts(spark, sf))
    for verdict in ("live", "dead"):
        files.save(verdicts.filter(F.col("verdict") == verdict).select("slug").orderBy("slug"), f"{folder}-{verdict}.json")
        back = spark.read.text(f"{folder}-{verdict}.json", wholetext=True).select(F.explode(F.from_json("value", "array<string>")).alias("slug"), F.lit(verdict).alias("verdict"))
        out = back if out is None else out.unionByName(back)
    files.save(verdicts.select("slug", F.concat(F.lit("Board "), "slug")).orderBy("slug"), f"{folder}-names.json", "map")
    named = boards.read_map(spark, f"{folder}-names.json")
    verdicts.filter("verdict = 'unreachable'").select(F.concat(F.lit(" "), "slug", F.lit("\t\n"))).write.text(f"{folder}-again")
    out = out.unionByName(boards.read_lines(spark, f"{folder}-again").select(F.col("value").alias("slug"), F.lit("again").alias("verdict")))
    return out.unionByName(named.select(F.col("key").alias("slug"), F.when(F.col("value") == F.concat(F.lit("Board "), "key"), "name").alias("verdict")))


@query("report_file", f"""select string_agg(line, chr(10) order by place, line) as report from (select 0 as place, '# Filter report' as line union all select 1, concat(cast(count(*) as varchar), ' jobs of ', cast(count(distinct slug) as varchar), ' boards') from {_P}
union all select 2, concat('- ', kind, ': ', cast(count(*) as varchar)) from (select {S.location_kind(CHECK, 'location')} as kind from {_P}) group by kind)""")
def report_file(spark, sf):
    path = f"{_new(spark)}-report.md"
    rows = P.postings(spark, sf)
    head = spark.createDataFrame([(0, "# Filter report")], "place int, line string")
    counts = rows.agg(F.lit(1).alias("place"), F.concat(F.count("*").cast("string"), F.lit(" jobs of "), F.count_distinct("slug").cast("string"), F.lit(" boards")).alias("line"))
    kinds = rows.select(column(S.location_kind, "location").alias("kind")).groupBy("kind").agg(F.count("*").alias("n")).select(F.lit(2).alias("place"), F.concat(F.lit("- "), "kind", F.lit(": "), F.col("n").cast("string")).alias("line"))
    files.save(head.unionByName(counts).unionByName(kinds).orderBy("place", "line").select("line"), path, "report")
    return spark.read.text(path, wholetext=True).select(F.regexp_replace("value", "\n$", "").alias("report"))


_UNFIT = r"[\x00-\x08\x0b\x0c\x0e-\x1f\x{fffe}\x{ffff}]"
_TIDY = r"regexp_replace(regexp_replace(regexp_replace(replace(replace(regexp_replace(RAW, '(?m)^\s*--\s*\d+\s+of\s+\d+\s*--\s*$', '', 'g'), chr(13) || chr(10), chr(10)), chr(160), ' '), '[ \t]+\n', chr(10), 'g'), '\n{3,}', chr(10) || chr(10), 'g'), 'ENDS', '', 'g')".replace("ENDS", S.ENDS)


@query("upload_texts", f"select concat('doc_', cast(doc_id as varchar), '.docx') as name, {_TIDY.replace('RAW', f'''replace(regexp_replace(coalesce(text, ''), '{_UNFIT}', '', 'g'), chr(10), chr(10) || chr(10))''')} as text, cast(null as int) as pages, 'word' as method from documents")
def upload_texts(spark, sf):
    """Documents as Word files in folders, which are listed, let in by the guard and read inside the tasks."""
    folder = _new(spark)
    uploads.write_word_files(_table(spark, sf, "documents").selectExpr("concat('doc_', doc_id, '.docx') as name", "text"), folder)
    return uploads.extracted(uploads.read(spark, folder)).select(F.regexp_extract("path", "([^/]*)$", 1).alias("name"), "text", "pages", "method")


_UPLOAD = "concat('file_', cast(page_id as varchar), case page_id % 4 when 0 then '.PDF' when 1 then '.docx' when 2 then '.exe' else '' end)"


@query("oversized_uploads", f"select name, size, regexp_matches(lower(name), '\\.(pdf|docx|doc)$') and size <= 10485760 as taken from (select {_UPLOAD} as name, octet_length(encode(coalesce(html, ''))) * case when page_id % 5 = 0 then 100000 else 1 end as size from pages)")
def oversized_uploads(spark, sf):
    """The guard on names and sizes; every fifth upload is as long as a hundred thousand of its page."""
    name = _UPLOAD.replace("cast(page_id as varchar)", "cast(page_id as string)")
    rows = _table(spark, sf, "pages").select(F.expr(name).alias("name"), (F.octet_length(F.coalesce("html", F.lit(""))).cast("long") * F.expr("if(page_id % 5 = 0, 100000, 1)")).alias("size"))
    return rows.withColumn("taken", uploads.taken(F.col("name"), F.col("size")))


# streams over the events
def _events(spark, sf):
    return changes.events_stream(spark, f"{sf}/events.parquet*")


_MICROS = "timestampdiff(MICROSECOND, timestamp_ntz '1970-01-01 00:00:00', ts)"


def _keyed(events):
    """Clicks put a value under their props, views ask for it."""
    return events.filter("event_type in ('click', 'view', 'purchase')").selectExpr(
        "props as key", "if(event_type = 'view', 'get', 'put') as kind", "value", "cast(ts as timestamp) as ts", f"{_MICROS} as micros", "event_id as seq")


_TTL_DAYS = 3


@query("cache_stream", f"""select key, seq, micros, case when micros - put_at < {_TTL_DAYS * asks.DAY} then put_value end as answer, case when micros - put_at < {_TTL_DAYS * asks.DAY} then micros - put_at end as age from
(select key, seq, micros, kind, last_value(case when kind = 'put' then micros end ignore nulls) over w as put_at, last_value(case when kind = 'put' then value end ignore nulls) over w as put_value
from (select props as key, event_id as seq, epoch_us(ts) as micros, case when event_type = 'view' then 'get' else 'put' end as kind, value from events where event_type in ('click', 'view', 'purchase'))
window w as (partition by key order by micros, seq rows between unbounded preceding and 1 preceding)) where kind = 'get'""")
def cache_stream(spark, sf):
    """A cache of answers with a life of three days, kept as state of a stream and read to its end."""
    folder = _new(spark)
    return asks.run_to_end(asks.looked_up(_keyed(_events(spark, sf)), _TTL_DAYS * asks.DAY), f"{folder}-out", f"{folder}-state")


def _moves(events):
    """Clicks leave for a job, purchases apply for one, all else but errors comes back."""
    kind = "case event_type when 'click' then 'leave' when 'purchase' then 'apply' else 'return' end"
    return events.filter("event_type <> 'error'").selectExpr("user_id", f"{kind} as kind", "event_id % 20 as job_id", "if(event_id % 3 = 0, null, concat('Company ', event_id % 20)) as company", "cast(ts as timestamp) as ts", f"{_MICROS} as micros", "event_id as seq")


@query("ask_stream")
def ask_stream(spark, sf):
    """Whom to ask whether they applied: state of a stream; which job is asked about depends on all earlier questions."""
    folder = _new(spark)
    return asks.run_to_end(asks.asked(_moves(_events(spark, sf)), 12 * asks.HOUR), f"{folder}-out", f"{folder}-state")


@query("upsert_stream", "select user_id, user_id % 3 as part, arg_max(event_id, event_id) as event_id, arg_max(event_type, event_id) as event_type, arg_max(value, event_id) as value from events group by user_id")
def upsert_stream(spark, sf):
    """The last event of each user, kept in a stored table by a stream of batches."""
    folder = _new(spark)
    table = store.Store(spark, f"{folder}-table", "user_id long, part long, event_id long, event_type string, value double", "user_id", "part", 4)
    table.truncate()
    rows = _events(spark, sf).select("user_id", (F.col("user_id") % 3).alias("part"), "event_id", "event_type", "value")
    changes.upsert_batches(rows, changes.latest_into(table, "user_id", ["event_id"], ["event_id", "event_type", "value"]), f"{folder}-state").awaitTermination()
    return table.read()


@query("ask_sessions", """with g as (select *, case when ts - lag(ts) over (partition by user_id order by ts) < interval 6 hour then 0 else 1 end as starts from events where event_type = 'click'), s as (select *, sum(starts) over (partition by user_id order by ts, event_id) as n from g)
select user_id, min(ts) as started_at, max(ts) as left_at, count(*) as events from s group by user_id, n""")
def ask_sessions(spark, sf):
    """Sessions of clicks that six hours of silence end; the streaming form over a table."""
    rows = _table(spark, sf, "events").filter("event_type = 'click'").withColumn("at", F.col("ts").cast("timestamp"))
    out = changes.ask_sessions(rows, "user_id", "at", "6 hours")
    return out.select("user_id", F.col("session.start").cast("timestamp_ntz").alias("started_at"), F.col("left_at").cast("timestamp_ntz").alias("left_at"), "events")


# marks
_SKILLS = ("SQL", "Spark SQL", "spark", "Python", "data", "data engineer", "tables", "C++")
_ALTERNATIVES = r"(?i)data engineer|Spark SQL|Python|tables|spark|data|SQL|C\+\+"


@query("skills_highlighted", rf"""with d as (select doc_id, string_agg(line, chr(10) order by line_no) as text from ({R.sql(CHECK, 1)}) group by doc_id), h as (select doc_id, text, regexp_extract_all(text, '{_ALTERNATIVES}') as hits, string_split_regex(text, '{_ALTERNATIVES}') as rests from d),
p as (select doc_id, unnest(list_transform(hits, lambda x, i: {{'i': i, 'term': x, 'at': 1 + list_sum(list_transform(rests[1:i], lambda r: length(r))) + coalesce(list_sum(list_transform(hits[1:i - 1], lambda r: length(r))), 0)}})) as u from h)
select doc_id, u.term as term, cast(u.at as bigint) as at from (select doc_id, u, row_number() over (partition by doc_id, lower(u.term) order by u.i) as nth from p) where nth = 1""")
def skills_highlighted(spark, sf):
    rows = drafts.whole(R.lines(spark, sf, 1)).select("doc_id", F.explode(marks.claimed(F.col("text"), _SKILLS)).alias("p"))
    return rows.select("doc_id", "p.term", F.col("p.at").cast("long").alias("at"))


@query("headings_marked")
def headings_marked(spark, sf):
    """Headings of pages; bold blocks count, and tracking tags are taken off first.  Tested against stated pages."""
    html = marks.untracked(F.coalesce("html", F.lit("")))
    return _table(spark, sf, "pages").select("page_id", F.posexplode(marks.headings(html)).alias("place", "heading"))


@query("skills_blocks", rf"""select doc_id, regexp_replace(block, '{S.ENDS}', '', 'g') as block, regexp_matches(block, '(?m)^\s*[A-Za-z][\w\s&/-]*:') as grouped, cast(len(regexp_extract_all(block, '(?m)^\s*[A-Za-z][\w\s&/-]*:')) as int) as groups
from (select doc_id, regexp_extract(text, '(?is)SKILLS\s*\n(.*?)(?:\n\s*\n|\nEDUCATION|$)', 1) as block from (select doc_id, string_agg(line, chr(10) order by line_no) as text from ({R.sql(CHECK, 1)}) group by doc_id))""")
def skills_blocks(spark, sf):
    return drafts.whole(R.lines(spark, sf, 1)).select("doc_id", marks.skills_block(F.col("text")).alias("s")).select("doc_id", "s.*")


_ROLE_LINE = r"regexp_matches(line, '^[A-Z][^\n]*\(\d{4}')"


@query("role_bullets", rf"""with l as (select *, sum(case when line_no > 0 and {_ROLE_LINE} then 1 else 0 end) over (partition by doc_id order by line_no rows between unbounded preceding and current row) as role from ({R.sql(CHECK, 1)}))
select doc_id, cast(role - 1 as int) as place, regexp_replace(arg_min(line, line_no), '{S.ENDS}', '', 'g') as title, cast(count(*) filter (regexp_matches(line, '^\s*-\s')) as int) as bullets from l where role > 0 group by doc_id, role""")
def role_bullets(spark, sf):
    rows = drafts.whole(R.lines(spark, sf, 1)).select("doc_id", F.posexplode(marks.role_bullets(F.col("text"))).alias("place", "r"))
    return rows.select("doc_id", "place", "r.title", "r.bullets")


# numbering
@query("spread_samples", f"""with n as (select id, field, row_number() over (order by id) - 1 as row_number from {Q._JOBS}), s as (select *, row_number() over (partition by field order by row_number) as place from n where row_number % 7 = 0)
select id, field, row_number from s where place <= 5 union all select arg_min(id, row_number), field, min(row_number) from n where field not in (select field from s) group by field""")
def spread_samples(spark, sf):
    rows = P.postings(spark, sf).select("id", column(S.category, "title").alias("field"))
    return numbering.spread(rows, [F.asc("id")], "field")


@query("category_by_table", f"select title, {S.category(CHECK, 'title')} as field, count(*) as n from {_P} group by title")
def category_by_table(spark, sf):
    """Categories by a table of rules: a rule changes without code."""
    table = spark.createDataFrame([(i, p, c) for i, (p, c) in enumerate(rules.CATEGORY_RULES)], "number int, pattern string, label string")
    titles = P.postings(spark, sf).groupBy("title").agg(F.count("*").alias("n")).withColumn("padded", F.expr(S.padded_title(SPARK, "title")))
    found = numbering.by_rules(titles, "padded", table, "field", "Other")
    return titles.join(found, "padded").select("title", "field", "n")
