"""More named queries: tracker, probes, sources, whole drafts, audits and formats, each with SQL written by hand."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import queries as Q
from .functions import column, rules
from .functions import scalars as S
from .functions.dialect import CHECK
from .operators import audits as audit_rules
from .operators import drafts, gates, numbering, probes, tracker
from .plans import postings as P
from .plans import resumes as R
from .sources import boards

query = Q.query
_P, _J = Q._POSTINGS, Q._JOBS


def _table(spark, sf, name):
    return spark.read.parquet(f"{sf}/{name}.parquet")


# the application log, made from the events: views are plain applies, clicks attach, all others apply with a resume
_LOG = """(select user_id, event_id % 50 as job_id, event_id as seq, ts, case when event_id % 3 = 0 then '' else concat('Title ', cast(event_id % 7 as varchar)) end as title,
case when event_id % 4 = 0 then null else concat('Company ', cast(event_id % 5 as varchar)) end as company, case when event_type <> 'view' then concat('resume ', cast(event_id as varchar)) end as resume,
event_type = 'click' as attach_only, case when event_type <> 'error' then event_id % 100 end as score_before, event_id % 90 as score_after from events)"""


def _log(spark, sf) -> DataFrame:
    return _table(spark, sf, "events").selectExpr(
        "user_id", "event_id % 50 as job_id", "event_id as seq", "ts", "if(event_id % 3 = 0, '', concat('Title ', event_id % 7)) as title", "if(event_id % 4 = 0, null, concat('Company ', event_id % 5)) as company",
        "if(event_type <> 'view', concat('resume ', event_id), null) as resume", "event_type = 'click' as attach_only", "if(event_type <> 'error', event_id % 100, null) as score_before", "event_id % 90 as score_after")


def _state(counted: str) -> str:
    return f"""(with e as (select * from {_LOG} where {counted}), k as (select *, min(seq) filter (where not attach_only) over (partition by user_id, job_id) as start from e)
select user_id, job_id, coalesce(arg_max(title, seq) filter (where title <> ''), '') as title, coalesce(arg_max(company, seq) filter (where company <> ''), '') as company, 'opened' as status,
arg_max(resume, seq) filter (where resume is not null) as resume, bool_or(resume is not null) as optimized, bool_or(resume is not null and not attach_only) as resume_was_sent,
(list(score_before order by seq desc) filter (where resume is not null))[1] as score_before, arg_max(score_after, seq) filter (where resume is not null) as score_after, min(ts) as applied_at, arg_max(ts, seq) as updated_at
from k where seq >= start group by user_id, job_id)"""


_STATE = _state("resume is not null")


@query("applications_state", f"select * from {_STATE}")
def applications_state(spark, sf):
    return tracker.folded_applications(_log(spark, sf))


@query("applications_state_direct", f"select * from {_state('true')}")
def applications_state_direct(spark, sf):
    return tracker.folded_applications(_log(spark, sf), track_direct=True)


# every fifth customer key asks for a change, some of them of rows that are not theirs
_CHANGES = "(select c_custkey % 15 as user_id, c_custkey * 7 % 50 as job_id, (['applied', 'opened', 'delete', 'lost'])[c_custkey % 4 + 1] as action, c_custkey as seq, timestamp '2024-03-01' + interval 1 second * c_custkey as ts from customer)"


@query("application_status", f"""with c as (select user_id, job_id, arg_max(action, seq) filter (where action <> 'delete') as new_status, arg_max(ts, seq) filter (where action <> 'delete') as changed_at, bool_or(action = 'delete') as gone
from {_CHANGES} where action <> 'lost' group by user_id, job_id) select s.user_id, s.job_id, coalesce(new_status, status) as status, coalesce(changed_at, updated_at) as updated_at
from {_STATE} s left join c on s.user_id = c.user_id and s.job_id = c.job_id where not coalesce(gone, false)""")
def application_status(spark, sf):
    changes = _table(spark, sf, "customer").selectExpr(
        "c_custkey % 15 as user_id", "c_custkey * 7 % 50 as job_id", "element_at(array('applied', 'opened', 'delete', 'lost'), cast(c_custkey % 4 + 1 as int)) as action", "c_custkey as seq",
        "timestamp_ntz '2024-03-01 00:00:00' + interval '1' second * c_custkey as ts")
    return tracker.changed_status(tracker.folded_applications(_log(spark, sf)), changes).select("user_id", "job_id", "status", "updated_at")


@query("applications_list", f"select user_id, job_id, title, company, status, applied_at from {_STATE} where user_id = 7")
def applications_list(spark, sf):
    return tracker.listed(tracker.folded_applications(_log(spark, sf)), 7).select("user_id", "job_id", "title", "company", "status", "applied_at")


@query("attachable", f"select seq from {_LOG} l where attach_only and exists (select 1 from {_STATE} s where s.user_id = l.user_id and s.job_id = l.job_id)")
def attachable(spark, sf):
    log = _log(spark, sf)
    return tracker.attachable(log, tracker.folded_applications(log)).select("seq")


@query("applied_count", f"select user_id, count(*) as total, count(*) filter (where resume_was_sent) as sent from {_STATE} group by user_id")
def applied_count(spark, sf):
    return tracker.folded_applications(_log(spark, sf)).groupBy("user_id").agg(F.count("*").alias("total"), F.count_if("resume_was_sent").alias("sent"))


@query("next_job", f"""select id, coalesce(lead_id, lag_id) as next_id from (select id, first_value(case when ok then id end ignore nulls) over (partition by slug order by posted_at desc nulls last, id rows between 1 following and unbounded following) as lead_id,
last_value(case when ok then id end ignore nulls) over (partition by slug order by posted_at desc nulls last, id rows between unbounded preceding and 1 preceding) as lag_id from (select *, not coalesce(closed, false) as ok from {_P}))""")
def next_job(spark, sf):
    return tracker.next_open(P.postings(spark, sf), [F.desc_nulls_last("posted_at"), F.asc("id")], ~F.coalesce("closed", F.lit(False)), "slug").select("id", "next_id")


@query("cache_fresh", "select key, created_at, score from (select props as key, max(ts) as created_at, arg_max(value, ts) as score from events group by props) where created_at > timestamp '2024-02-20' - interval 30 day")
def cache_fresh(spark, sf):
    rows = _table(spark, sf, "events").selectExpr("props as key", "ts as created_at", "value as score")
    return tracker.fresh_cache(rows, "2024-02-20 00:00:00")


@query("resume_save", r"select doc_id, length(resume) as kept from (select doc_id, regexp_replace(text, '^\s+|\s+$', '', 'g') as resume, text from documents) where resume <> '' and length(text) <= 100000")
def resume_save(spark, sf):
    return tracker.saved_resumes(_table(spark, sf, "documents").selectExpr("doc_id", "text as resume")).select("doc_id", F.length("resume").cast("long").alias("kept"))


@query("profile_save", f"""select c_custkey, field, role as "targetRole", degree, array_to_string(list_filter([case when field = '' then 'field' end, case when role = '' then 'targetRole' end, case when degree = '' then 'degree' end], lambda x: x is not null), ',') as missing
from (select *, case when role = '' or guess = 'Other' then '' else guess end as field from (select *, {S.category(CHECK, 'role')} as guess from (select c_custkey, case when c_custkey % 5 = 0 then '' else {CHECK.pick(P.TITLES, f'c_custkey % {len(P.TITLES)} + 1')} end as role,
case when c_custkey % 3 = 0 then '' else 'BSc' end as degree from customer)))""")
def profile_save(spark, sf):
    from .functions.dialect import SPARK

    rows = _table(spark, sf, "customer").select(
        "c_custkey", F.expr(f"if(c_custkey % 5 = 0, '  ', concat(' ', {SPARK.pick(P.TITLES, f'c_custkey % {len(P.TITLES)} + 1')}, ' '))").alias("targetRole"), F.expr("if(c_custkey % 3 = 0, null, 'BSc')").alias("degree"))
    out = tracker.saved_profiles(rows, ["targetRole", "degree"])
    return out.select("c_custkey", "field", "targetRole", "degree", F.array_join("missing", ",").alias("missing"))


# probes, made from the slugs of customers
_STATUS = "(select distinct c_custkey % 97 as k, concat('co', cast(c_custkey % 97 as varchar)) as slug from customer)"
_FIRST = f"(select slug, k, k % 3 = 0 as ok, ([200, 404, 0])[k % 3 + 1] as status from {_STATUS})"
_SECOND = f"(select slug, k % 5 = 0 as ok, case when k % 5 = 0 then 200 when k % 2 = 0 then 404 else 0 end as status from {_FIRST} where not ok)"
_VERDICTS = f"(select f.slug, case when f.ok then 'live' when coalesce(s.ok, false) then 'recovered' when f.status = 404 and s.status = 404 then 'dead' else 'unreachable' end as verdict from {_FIRST} f left join {_SECOND} s on f.slug = s.slug)"


def _verdicts(spark, sf):
    slugs = _table(spark, sf, "customer").selectExpr("c_custkey % 97 as k").distinct().withColumn("slug", F.concat(F.lit("co"), F.col("k").cast("string")))
    first = slugs.selectExpr("slug", "k", "k % 3 = 0 as ok", "element_at(array(200, 404, 0), cast(k % 3 + 1 as int)) as status")
    second = first.filter("not ok").selectExpr("slug", "k % 5 = 0 as ok", "case when k % 5 = 0 then 200 when k % 2 = 0 then 404 else 0 end as status")
    return probes.retry_verdicts(first, second)


@query("retry_verdicts", f"select * from {_VERDICTS}")
def retry_verdicts(spark, sf):
    return _verdicts(spark, sf)


@query("retry_report", f"""select *, case when rate >= 30 then 'throttled' when dead > unreachable then 'dead boards' else 'timeouts' end as cause from (select *, cast(floor(recovered * 100 / retried + 0.5) as bigint) as rate from
(select count(*) as retried, count(*) filter (where verdict = 'recovered') as recovered, count(*) filter (where verdict = 'dead') as dead, count(*) filter (where verdict = 'unreachable') as unreachable from {_VERDICTS} where verdict <> 'live'))""")
def retry_report(spark, sf):
    return probes.retry_report(_verdicts(spark, sf))


@query("slugs_kept", f"select distinct slug from {_P} where slug not in (select slug from {_VERDICTS} where verdict = 'dead')")
def slugs_kept(spark, sf):
    return P.postings(spark, sf).select("slug").distinct().join(_verdicts(spark, sf).filter("verdict = 'dead'"), "slug", "left_anti")


@query("live_check", f"""select id, case when ats = 'ashby' then case when cast(substring(slug, 3) as bigint) % 3 <> 0 then n % 4 = 0 else closed end when n % 7 = 0 then true when n % 7 < 5 then false else closed end as closed
from (select *, cast(substring(id, 5) as bigint) as n from {_P})""")
def live_check(spark, sf):
    """The answers and the boards are tables of their own; each is read once."""
    number = F.col("o_orderkey")
    status = F.when(number % 3 == 1, F.when(number % 4 != 0, 200)).when(number % 7 == 0, 404).when(number % 7 < 5, 200).otherwise(0)
    answers = _table(spark, sf, "orders").select(F.concat(F.lit("job_"), number.cast("string")).alias("id"), status.alias("status")).filter("status is not null")
    boards_ = _table(spark, sf, "customer").selectExpr("c_custkey % 97 as k").distinct().selectExpr("concat('co', k) as slug", "k % 3 <> 0 as ok")
    return probes.rechecked(P.postings(spark, sf), answers, boards_).select("id", "closed")


_ONE = "case when n % 3 = 1 then case when n % 4 <> 0 then 200 end when n % 7 = 0 then 404 when n % 7 < 5 then 200 else 0 end"
_LIVE = "case when n % 10 = 0 then '' when n % 10 = 1 then null else concat('&lt;p&gt;Live ', cast(n as varchar), ' &amp; open&lt;/p&gt;') end"


@query("job_detail", f"""select id, coalesce(case when ats = 'greenhouse' then replace(replace(replace(nullif(live, ''), '&lt;', '<'), '&gt;', '>'), '&amp;', '&') when ats = 'ashby' and not ok then null else nullif(live, '') end, head) as description,
coalesce(case when ats = 'ashby' then case when ok then coalesce(status, 0) <> 200 else closed end when status = 404 then true when status = 200 then false else closed end, false) as closed
from (select id, ats, closed, substring({S.strip_html(CHECK, 'body')}, 1, 500) as head, cast(substring(slug, 3) as bigint) % 3 <> 0 as ok, {_ONE} as status, case when {_ONE} = 200 then {_LIVE} end as live from (select *, cast(substring(id, 5) as bigint) as n from {_P}))""")
def job_detail(spark, sf):
    """Every posting as a reader gets it: stored head or live text, and whether it is closed."""
    rows = P.postings(spark, sf).withColumn("description", F.substring(column(S.strip_html, "body"), 1, 500)).drop("body")
    text = _LIVE.replace("varchar", "string")
    answers = _table(spark, sf, "orders").selectExpr("o_orderkey as n").selectExpr("concat('job_', n) as id", f"{_ONE} as status", f"{text} as live").filter("status is not null")
    boards_ = _table(spark, sf, "customer").selectExpr("c_custkey % 97 as k").distinct().selectExpr("concat('co', k) as slug", "k % 3 <> 0 as ok")
    return probes.job_details(rows, answers, boards_)


_SHAPES = ("boards_api", "boards", "embed", "careers", "job_boards")
_PROBES = f"(select slug, shape, case when (k + i) % 4 = 0 then 200 else 404 end as status from {_STATUS}, (select unnest([{', '.join(repr(s) for s in _SHAPES)}]) as shape, unnest([1, 2, 3, 4, 5]) as i) where (k * i) % 3 <> 1)"


@query("probe_shapes", f"select *, {' or '.join(_SHAPES)} as alive from (select slug, {', '.join(f'''coalesce(bool_or(status = 200) filter (where shape = '{s}'), false) as {s}''' for s in _SHAPES)} from {_PROBES} group by slug)")
def probe_shapes(spark, sf):
    slugs = _table(spark, sf, "customer").selectExpr("c_custkey % 97 as k").distinct()
    shapes = F.explode(F.array(*[F.struct(F.lit(s).alias("shape"), F.lit(i).alias("i")) for i, s in enumerate(_SHAPES, 1)])).alias("s")
    rows = slugs.select("k", shapes).select(F.concat(F.lit("co"), F.col("k").cast("string")).alias("slug"), "s.shape", F.when((F.col("k") + F.col("s.i")) % 4 == 0, 200).otherwise(404).alias("status"), (F.col("k") * F.col("s.i") % 3 != 1).alias("asked"))
    return probes.shapes(rows.filter("asked"), list(_SHAPES))


@query("key_lookup", f"select id, title from {_P} where id = 'job_7'")
def key_lookup(spark, sf):
    return P.postings(spark, sf).filter("id = 'job_7'").select("id", "title")


@query("latest_three", f"select id, fetched_at from {_P} order by fetched_at desc, id limit 3")
def latest_three(spark, sf):
    return P.postings(spark, sf).select("id", "fetched_at").orderBy(F.desc("fetched_at"), "id").limit(3)


@query("hashed_sample", "select item_id from (select item_id, sha256(concat(cast(item_id as varchar), '/seed')) as h from benchmark) order by h, item_id limit 10")
def hashed_sample(spark, sf):
    return _table(spark, sf, "benchmark").select("item_id").orderBy(F.sha2(F.concat(F.col("item_id").cast("string"), F.lit("/seed")), 256), "item_id").limit(10)


@query("merged_slugs", f"select slug, row_number() over (order by slug) - 1 as place from (select distinct slug from {_P} union select slug from {_VERDICTS} where verdict = 'live')")
def merged_slugs(spark, sf):
    """The merged list in alphabetic order, each with its place."""
    slugs = P.postings(spark, sf).select("slug").union(_verdicts(spark, sf).filter("verdict = 'live'").select("slug")).distinct()
    return numbering.numbered(slugs, [F.asc("slug")], "place")


@query("source_gates", f"""select ats, count(*) as n, count(*) filter (where kept) as kept from (select ats, case ats when 'greenhouse' then location = '' or us when 'ashby' then location <> '' and us else us and n % 2 = 0 end as kept
from (select ats, location, cast(substring(id, 5) as bigint) as n, {S.location_kind(CHECK, 'location')} in ('us', 'weak-us', 'ambiguous') as us from {_P})) group by ats""")
def source_gates(spark, sf):
    rows = P.postings(spark, sf).withColumn("country", F.when(F.expr("cast(substring(id, 5) as bigint) % 2 = 0"), "us").otherwise("de"))
    return rows.withColumn("kept", boards.us_gate(F.col("ats"), F.col("location"), F.col("country"), column(S.location_kind, "location"))).groupBy("ats").agg(F.count("*").alias("n"), F.count_if("kept").alias("kept"))


# whole drafts
_OLD = f"(select doc_id, string_agg(line, chr(10) order by line_no) as text from {Q._OLD} group by doc_id)"
_NEW = f"(select doc_id, string_agg(line, chr(10) order by line_no) as text from {Q._NEW_LINES} group by doc_id)"
_MONTH = lambda g: f"cast((instr('jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec', lower(list_extract({g}, i))) + 3) // 4 as int)"
_ALL = lambda i: f"regexp_extract_all(section, '{drafts.DATE_RANGE}', {i})"


def _part(name: str, digits: str, default: str) -> str:
    return f"case when coalesce(list_extract({name}, i), '') <> '' then {_MONTH(name)} when coalesce(list_extract({digits}, i), '') <> '' then cast(list_extract({digits}, i) as int) else {default} end"


@query("experience_months", rf"""with a as (select doc_id, regexp_extract(text, '(?ims)^[\s]*(?:PROFESSIONAL\s+|WORK\s+|RELEVANT\s+)?(?:EXPERIENCE|EMPLOYMENT(?:\s+HISTORY)?|CAREER\s+HISTORY)\s*:?\s*$.*') as after from {_NEW}),
b as (select doc_id, case when regexp_matches(substring(after, 2), '{drafts.WORK_END}') then substring(after, 1, length(regexp_extract(substring(after, 2), '(?ims)^(.*?)(?:^\s*(?:[A-Z][A-Za-z]*\s+)?(?:PROJECTS|EDUCATION|CERTIFICATIONS?|SKILLS|AWARDS|PUBLICATIONS)\s*:?\s*$)', 1)) + 1) else after end as section from a where after <> ''),
c as (select doc_id, {', '.join(f'{_ALL(i)} as g{i}' for i in range(1, 8))} from b),
d as (select doc_id, unnest(list_transform(generate_series(1, len(g3)), lambda i: (case when coalesce(list_extract(g4, i), '') <> '' then 2001 * 12 + 8 else cast(list_extract(g7, i) as int) * 12 + {_part('g5', 'g6', '12')} end) - (cast(list_extract(g3, i) as int) * 12 + {_part('g1', 'g2', '1')}) + 1)) as m from c)
select n.doc_id, t.months from {_NEW} n left join (select doc_id, cast(sum(m) as int) as months from d where m > 0 and m < 600 group by doc_id) t on n.doc_id = t.doc_id""")
def experience_months(spark, sf):
    return drafts.whole(R.lines(spark, sf, 1)).select("doc_id", drafts.experience_months(F.col("text"), 2001, 8).alias("months"))


def _summary(source: str) -> str:
    return rf"""(select doc_id, len(list_filter(list_transform(string_split(regexp_replace(body, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)), lambda s: regexp_replace(s, '^\s+|\s+$', '', 'g')), lambda s: length(s) > 15)) as n
from (select doc_id, regexp_replace(case when regexp_matches(after, '{drafts.TITLE_LINE}') then regexp_extract(after, '(?ms)^(.*?)(?:^[ \t]*[A-Z][A-Z\s&/]{{2,39}}:?[ \t]*$)', 1) else after end, '^\s+|\s+$', '', 'g') as body
from (select doc_id, substring(text, instr(text, title) + length(title)) as after from (select doc_id, text, regexp_extract(text, '{drafts.SUMMARY_LINE}') as title from {source}) where title <> '')) where body <> '')"""


@query("summary_drift", f"select o.doc_id, o.n as before, n.n as after, case when n.n < o.n then 'cut' else 'padded' end as dir from {_summary(_OLD)} o join {_summary(_NEW)} n on o.doc_id = n.doc_id where o.n >= 2 and o.n <> n.n")
def summary_drift(spark, sf):
    out = drafts.summary_drift(_versions(spark, sf))
    return out.withColumns({c: F.col(c).cast("long") for c in ("before", "after")})


def _versions(spark, sf):
    whole = [drafts.whole(R.lines(spark, sf, v)) for v in (0, 1)]
    return whole[0].withColumnRenamed("text", "original").join(whole[1].withColumnRenamed("text", "draft"), "doc_id")


_SAFE = ", ".join(CHECK.text(c) for c in rules.SAFE_CODES)


def _codes(old: str, new: str) -> str:
    return rf"""(select distinct n.doc_id, tok from (select doc_id, unnest(regexp_extract_all(line, '{drafts.CERT_SHAPED}')) as tok from (select *, min(case when regexp_matches(line, '(?i)^[ \t]*CERTIFICATIONS?[ \t]*:?[ \t]*$') then line_no end) over (partition by doc_id) as cut from {new})
where line_no < coalesce(cut, 1000000) and not regexp_matches(line, '^[ \t]*[A-Z][A-Z\s&/]{{2,39}}:?[ \t]*$')) n join {old} o on o.doc_id = n.doc_id
where upper(regexp_replace(tok, '[- ]', '', 'g')) not in ({_SAFE}) and not contains(upper(o.text), upper(regexp_replace(tok, '[- ]', '', 'g'))))"""


# the drafts of these two queries name codes that the original does not have, on one line in five
_CODED = "(select doc_id, line_no, case when line_no % 5 = 1 then concat(line, ', VMCE and DP-', cast(200 + doc_id % 3 as varchar), ' SQL') else line end as line from " + Q._NEW_LINES + ")"


def _coded(spark, sf):
    return R.lines(spark, sf, 1).withColumn("line", F.expr("if(line_no % 5 = 1, concat(line, ', VMCE and DP-', 200 + doc_id % 3, ' SQL'), line)"))


@query("stray_certs", f"select doc_id, string_agg(tok, ',' order by tok) as codes from {_codes(_OLD, _CODED)} group by doc_id")
def stray_certs(spark, sf):
    both = drafts.whole(R.lines(spark, sf, 0)).withColumnRenamed("text", "original").join(drafts.whole(_coded(spark, sf)).withColumnRenamed("text", "draft"), "doc_id")
    return both.select("doc_id", F.array_join(F.array_sort(drafts.stray_certs(F.col("original"), F.col("draft"))), ",").alias("codes")).filter("codes <> ''")


_MENDED = f"({Q.ORACLES['doc_cert_dashes']})"
_GATES = {
    "invented": "doc_invented_bullets", "past_tense": "doc_past_tense", "stray": "doc_stray_prose", "sections": "doc_invented_sections", "environment": "doc_dropped_environment", "merged": "doc_merged_bullets", "lost": "doc_bullet_loss"}


def _fired(name: str, sql: str) -> str:
    return f"select distinct doc_id, '{name}' as gate from ({sql})"


@query("gate_verdict", "with g as (" + " union all ".join([
    *[_fired(n, Q.ORACLES[q].replace(Q._OLD, _MENDED) if n == "past_tense" else Q.ORACLES[q].replace(Q._NEW_LINES, _MENDED) if n != "lost" else Q.ORACLES[q]) for n, q in _GATES.items()],
    _fired("dashes", f"select doc_id from {_MENDED} where regexp_matches(line, '[—–]|--')"),
    _fired("summary", f"select o.doc_id from {_summary(_OLD)} o join {_summary(f'(select doc_id, string_agg(line, chr(10) order by line_no) as text from {_MENDED} group by doc_id)')} n on o.doc_id = n.doc_id where o.n >= 2 and o.n <> n.n"),
    _fired("certs", f"select doc_id from {_codes(_OLD, _MENDED)}"),
]) + f") select d.doc_id, coalesce(string_agg(gate, ',' order by gate), '') as failed, count(gate) = 0 as passed from (select distinct doc_id from {Q._NEW_LINES}) d left join g on d.doc_id = g.doc_id group by d.doc_id")
def gate_verdict(spark, sf):
    return drafts.verdicts(R.lines(spark, sf, 0), R.lines(spark, sf, 1))


_CONFIRMED = ("Freight Prices", "Spark SQL")
_KNOWN = CHECK.array(map(CHECK.text, ("freight", "prices", "spark", "sql")))


@query("doc_invented_bullets_confirmed", f"""with b as (select doc_id, line_no, bullet, unnest(list_filter({S.content_words(CHECK, 'bullet')}, lambda w: not list_contains({_KNOWN}, w))) as word from {Q._BULLETS}), k as (select distinct doc_id, unnest({S.content_words(CHECK, 'line')}) as word from {Q._OLD})
select b.doc_id, line_no, bullet, count(*) as words, count(k.word) as hits from b left join k on b.doc_id = k.doc_id and b.word = k.word group by b.doc_id, line_no, bullet having count(*) >= 4 and count(k.word) < 0.4 * count(*)""")
def doc_invented_bullets_confirmed(spark, sf):
    return gates.invented_bullets(R.lines(spark, sf, 1), R.lines(spark, sf, 0), skills=_CONFIRMED)


# drafts with every fault that can be repaired: a code on one line in five, a section the original lacks on one in eleven
_TAMPERED = "(select doc_id, line_no, case when line_no % 11 = 7 and doc_id % 3 <> 0 then case when line_no % 2 = 0 then 'AWARDS & HONORS' else 'Volunteering' end when line_no % 5 = 1 then concat(line, ', VMCE and DP-', cast(200 + doc_id % 3 as varchar), ' SQL') else line end as line from " + Q._NEW_LINES + ")"


def _tampered(spark, sf):
    return R.lines(spark, sf, 1).withColumn("line", F.expr(
        "case when line_no % 11 = 7 and doc_id % 3 <> 0 then if(line_no % 2 = 0, 'AWARDS & HONORS', 'Volunteering') when line_no % 5 = 1 then concat(line, ', VMCE and DP-', 200 + doc_id % 3, ' SQL') else line end"))


_MENDED_T = f"({Q.ORACLES['doc_cert_dashes'].replace(Q._NEW_LINES, _TAMPERED)})"
_TRIM = lambda x: f"regexp_replace({x}, '{S.ENDS}', '', 'g')"
_CUT = r"""list_reduce(list_prepend(plain, secs), lambda t, h: case when not regexp_matches(t, '(?mi)^[ \t]*' || regexp_escape(h) || '[ \t]*:?[ \t]*$') then t else """ + _TRIM(r"""concat(substring(t, 1, instr(t, regexp_extract(t, '(?mi)^[ \t]*' || regexp_escape(h) || '[ \t]*:?[ \t]*$')) - 1),
case when regexp_matches(substring(t, instr(t, regexp_extract(t, '(?mi)^[ \t]*' || regexp_escape(h) || '[ \t]*:?[ \t]*$')) + length(regexp_extract(t, '(?mi)^[ \t]*' || regexp_escape(h) || '[ \t]*:?[ \t]*$'))), 'TITLE')
then substring(t, instr(t, regexp_extract(t, '(?mi)^[ \t]*' || regexp_escape(h) || '[ \t]*:?[ \t]*$')) + length(regexp_extract(t, '(?mi)^[ \t]*' || regexp_escape(h) || '[ \t]*:?[ \t]*$')) + length(regexp_extract(substring(t, instr(t, regexp_extract(t, '(?mi)^[ \t]*' || regexp_escape(h) || '[ \t]*:?[ \t]*$')) + length(regexp_extract(t, '(?mi)^[ \t]*' || regexp_escape(h) || '[ \t]*:?[ \t]*$'))), '(?s)^(.*?)(?:TITLE)', 1))) else '' end)""").replace("TITLE", drafts.TITLE_LINE) + " end)"


@query("draft_repaired", rf"""with s as (select doc_id, list(line order by line_no) as stray from ({Q.ORACLES['doc_stray_prose'].replace(Q._NEW_LINES, _MENDED_T)}) group by doc_id),
x as (select doc_id, list(distinct section order by section) as secs from ({Q.ORACLES['doc_invented_sections'].replace(Q._NEW_LINES, _MENDED_T)}) group by doc_id), c as (select doc_id, list(tok) as codes from {_codes(_OLD, _MENDED_T)} group by doc_id),
m as (select distinct doc_id from ({Q.ORACLES['doc_merged_bullets'].replace(Q._NEW_LINES, _MENDED_T)})), d as (select doc_id, string_agg(line, chr(10) order by line_no) as text from {_MENDED_T} group by doc_id),
a as (select d.doc_id, list_reduce(list_prepend(text, coalesce(stray, [])), lambda t, p: {_TRIM("case when instr(t, p) > 0 then concat(substring(t, 1, instr(t, p) - 1), substring(t, instr(t, p) + length(p))) else t end")}) as plain, coalesce(secs, []) as secs, coalesce(codes, []) as codes,
stray is not null or secs is not null or codes is not null or m.doc_id is not null as faulty, text from d left join s on d.doc_id = s.doc_id left join x on d.doc_id = x.doc_id left join c on d.doc_id = c.doc_id left join m on d.doc_id = m.doc_id),
b as (select *, {_CUT} as cut from a), e as (select *, list_reduce(list_prepend(regexp_replace(cut, '{drafts.MERGED}', '\1' || chr(10) || '\2', 'g'), codes), lambda t, k: regexp_replace(t, '[,;]?\s*\b' || regexp_escape(k) || '\b', '', 'g')) as bare from b)
select doc_id, case when not faulty then text when len(codes) = 0 then bare else regexp_replace(regexp_replace(regexp_replace(bare, ',\s*,', ',', 'g'), ',\s*\.', '.', 'g'), '\s{{2,}}', ' ', 'g') end as text from e""")
def draft_repaired(spark, sf):
    """One round of repairs, as at the end of a writer's attempts."""
    original, draft = R.lines(spark, sf, 0), _tampered(spark, sf)
    return drafts.repair_round(drafts.facts(original), drafts.whole(draft)).select("doc_id", "text")


@query("draft_repaired_until_passing")
def draft_repaired_until_passing(spark, sf):
    return drafts.repaired_drafts(R.lines(spark, sf, 0), _tampered(spark, sf))


@query("split_bullets", r"select doc_id, regexp_replace(text, '([a-z0-9][.)])\s*([•▪]\s*[A-Z])', '\1' || chr(10) || '\2', 'g') as text from " + _NEW)
def split_bullets(spark, sf):
    return drafts.whole(R.lines(spark, sf, 1)).select("doc_id", drafts.repaired(F.col("text"), F.array().cast("array<string>")).alias("text"))


_SKILLS = ("python", "spark", "terraform", "docker", "kubernetes", "sql")
_LANDED = ("python", "terraform", "docker", "kubernetes", "cobol")


@query("landed_skills", f"""with b as (select n.doc_id, list_filter({CHECK.array(map(CHECK.text, _SKILLS))}, lambda k: contains(lower(o.text), k)) as had, lower(n.text) as said from {_NEW} n join {_OLD} o on n.doc_id = o.doc_id),
c as (select *, list_filter({CHECK.array(map(CHECK.text, _LANDED))}, lambda k: list_contains({CHECK.array(map(CHECK.text, _SKILLS))}, k) and not list_contains(had, k) and contains(said, k)) as landed from b)
select doc_id, array_to_string(landed, ',') as landed, cast(floor(100.0 * len(had) / 6 + 0.5) as bigint) as before, cast(floor(100.0 * (len(had) + len(landed)) / 6 + 0.5) as bigint) as after from c""")
def landed_skills(spark, sf):
    """Confirmed skills that the original lacks and the draft has, and the score before and after."""
    wanted = F.array(*[F.lit(k) for k in _SKILLS])
    both = _versions(spark, sf).select("doc_id", "original", "draft", F.filter(wanted, lambda k: F.contains(F.lower("original"), k)).alias("had"))
    confirmed = F.array_intersect(F.array(*[F.lit(k) for k in _LANDED]), F.array_except(wanted, F.col("had")))
    rows = both.withColumn("landed", F.filter(confirmed, lambda k: F.contains(F.lower("draft"), k)))
    score = lambda n: F.floor(F.lit(100.0) * n / len(_SKILLS) + 0.5).cast("long")
    return rows.select("doc_id", F.array_join("landed", ",").alias("landed"), score(F.size("had")).alias("before"), score(F.size("had") + F.size("landed")).alias("after"))


_WORDS = ", ".join(CHECK.text(w) for w in (*drafts.BANNED, *drafts.TO_THE_READER))


@query("banned_words", f"select doc_id, array_to_string(list_filter([{_WORDS}], lambda w: contains(lower(text), w)), '|') as found from {_NEW}")
def banned_words(spark, sf):
    words = F.array(*[F.lit(w) for w in (*drafts.BANNED, *drafts.TO_THE_READER)])
    return drafts.whole(R.lines(spark, sf, 1)).select("doc_id", F.array_join(F.filter(words, lambda w: F.contains(F.lower("text"), w)), "|").alias("found"))


@query("invented_numbers", rf"select doc_id, n from (select doc_id, unnest(list_distinct(list_transform(regexp_extract_all(text, '{drafts.NUMBER}'), lambda s: regexp_replace(s, '^\s+|\s+$', '', 'g')))) as n from {_NEW}) except select doc_id, n from (select doc_id, unnest(list_transform(regexp_extract_all(text, '{drafts.NUMBER}'), lambda s: regexp_replace(s, '^\s+|\s+$', '', 'g'))) as n from {_OLD})")
def invented_numbers(spark, sf):
    numbers = lambda c: F.array_distinct(F.transform(F.regexp_extract_all(c, F.lit(drafts.NUMBER), F.lit(0)), lambda x: F.regexp_replace(x, r"^\s+|\s+$", "")))
    return _versions(spark, sf).select("doc_id", F.explode(F.array_except(numbers(F.col("draft")), numbers(F.col("original")))).alias("n"))


@query("tidy_text", r"""select doc_id, regexp_replace(regexp_replace(regexp_replace(replace(replace(regexp_replace(raw, '(?m)^\s*--\s*\d+\s+of\s+\d+\s*--\s*$', '', 'g'), chr(13) || chr(10), chr(10)), chr(160), ' '), '[ \t]+\n', chr(10), 'g'), '\n{3,}', chr(10) || chr(10), 'g'), '^\s+|\s+$', '', 'g') as text
from (select doc_id, concat('  ', replace(text, chr(10), concat('  ', chr(13), chr(10), '-- 1 of 3 --', chr(10), chr(10), chr(10), chr(10))), chr(160), ' x ') as raw from documents)""")
def tidy_text(spark, sf):
    raw = F.concat(F.lit("  "), F.replace("text", F.lit("\n"), F.lit("  \r\n-- 1 of 3 --\n\n\n\n")), F.lit("  x "))
    return _table(spark, sf, "documents").select("doc_id", F.when(F.col("text").isNotNull(), drafts.tidied(raw)).otherwise(drafts.tidied(F.lit("    x "))).alias("text"))


@query("detail_over_list", f"select l.id, coalesce(d.title, l.title) as title, d.body as body, l.location from {_P} l left join (select id, upper(title) as title, body from {_P} where ats = 'smartrecruiters') d on l.id = d.id")
def detail_over_list(spark, sf):
    rows = P.postings(spark, sf)
    detail = rows.filter("ats = 'smartrecruiters'").select("id", F.struct(F.upper("title").alias("title"), "body").alias("d"))
    return rows.select("id", "title", "location").join(detail, "id", "left").select("id", F.coalesce("d.title", "title").alias("title"), F.col("d.body").alias("body"), "location")


@query("description_head", f"select page_id, substring({S.strip_html(CHECK, 'html')}, 1, 500) as head from pages")
def description_head(spark, sf):
    return _table(spark, sf, "pages").select("page_id", F.substring(column(S.strip_html, "html"), 1, 500).alias("head"))


@query("keyword_in_context", f"""select id, case when p > 0 then regexp_replace(substring(body, greatest(1, p - 40), p + length(w) + 120 - greatest(1, p - 40)), '\\s+', ' ', 'g') end as context from (select id, body, w, case when w <> '' then instr(body, w) else 0 end as p
from (select id, body, regexp_extract(body, '(?i)contract|temporary|part-time') as w from {_P}))""")
def keyword_in_context(spark, sf):
    trigger = r"(?i)contract|temporary|part-time"
    at, size = F.regexp_instr("body", F.lit(trigger)), F.length(F.regexp_extract("body", trigger, 0))
    begin = F.greatest(F.lit(1), at - 40)
    return P.postings(spark, sf).select("id", F.when(at > 0, F.regexp_replace(F.substr("body", begin, at + size + 120 - begin), r"\s+", " ")).alias("context"))


# audits
@query("employment_breakdown", f"select employment_type, count(*) as n from (select case when regexp_matches(lower(body), '\\bfull[\\s-]?time\\b') then 'Full-time' end as employment_type from {_P}) group by employment_type")
def employment_breakdown(spark, sf):
    return P.postings(spark, sf).select(column(S.employment_type, "body").alias("employment_type")).groupBy("employment_type").agg(F.count("*").alias("n"))


@query("projections", f"""select ats, boards, jobs, jobs / cast(boards as double) as per_board, cast(floor(jobs * 585.0 / boards + 0.5) as bigint) as projected, cast(floor(ms / cast(jobs as double) + 0.5) as bigint) as detail_ms,
cast(floor(ms / 1000.0 * (585.0 / boards) / 60 + 0.5) as bigint) as minutes from (select ats, count(*) as jobs, count(distinct slug) as boards, sum(cast(substring(id, 5) as bigint) * 31 % 700 + 100) as ms from {_P} group by ats)""")
def projections(spark, sf):
    """From the boards sampled to 585 of them: postings, and minutes by the time of one detail call."""
    rows = P.postings(spark, sf).withColumn("ms", F.expr("cast(substring(id, 5) as bigint) * 31 % 700 + 100"))
    out = rows.groupBy("ats").agg(F.count("*").alias("jobs"), F.count_distinct("slug").alias("boards"), F.sum("ms").alias("ms"))
    half_up = lambda x: F.floor(x + F.lit(0.5)).cast("long")
    return out.select(
        "ats", "boards", "jobs", (F.col("jobs") / F.col("boards")).alias("per_board"), half_up(F.col("jobs") * F.lit(585.0) / F.col("boards")).alias("projected"), half_up(F.col("ms") / F.col("jobs")).alias("detail_ms"),
        half_up(F.col("ms") / F.lit(1000.0) * (F.lit(585.0) / F.col("boards")) / 60).alias("minutes"))


@query("disqualifier_context")
def disqualifier_context(spark, sf):
    """The first rule that stops a posting, its pattern, and the text around what it met."""
    said = F.concat_ws(" ", "title", column(S.strip_html, "body"))
    rows = P.postings(spark, sf).select("id", said.alias("said")).select("id", F.expr(audit_rules.disqualifier_hit("said")).alias("hit"))
    return rows.filter("hit is not null").select("id", "hit.*")


# formats and small helpers
@query("score_verdict", "select event_id, case when value >= 80 then 'strong' when value >= 60 then 'fair' else 'weak' end as modal, case when value >= 75 then 'strong' when value >= 50 then 'fair' else 'weak' end as page from events")
def score_verdict(spark, sf):
    graded = lambda high, low: F.when(F.col("value") >= high, "strong").when(F.col("value") >= low, "fair").otherwise("weak")
    return _table(spark, sf, "events").select("event_id", graded(80, 60).alias("modal"), graded(75, 50).alias("page"))


_FONTS = {"calibri": "Calibri", "arial": "Arial", "helvetica": "Arial", "georgia": "Georgia", "times": "Times New Roman", "timesnewroman": "Times New Roman", "timesroman": "Times New Roman"}
_ASKED = ("Times New Roman", "helvetica", "Comic", "GEORGIA", "times-roman")


@query("font_for", f"select c_custkey, coalesce(map {{{', '.join(f'{k!r}: {v!r}' for k, v in _FONTS.items())}}}[regexp_replace(lower({CHECK.pick(_ASKED, f'c_custkey % {len(_ASKED)} + 1')}), '[^a-z]', '', 'g')], 'Calibri') as font from customer")
def font_for(spark, sf):
    known = F.create_map(*[F.lit(x) for pair in _FONTS.items() for x in pair])
    asked = F.element_at(F.array(*[F.lit(a) for a in _ASKED]), (F.col("c_custkey") % len(_ASKED) + 1).cast("int"))
    return _table(spark, sf, "customer").select("c_custkey", F.coalesce(F.try_element_at(known, F.regexp_replace(F.lower(asked), "[^a-z]", "")), F.lit("Calibri")).alias("font"))


@query("file_name", f"select id, regexp_replace(concat(title, ' ', company), '[^A-Za-z0-9]+', '_', 'g') as file from {_P}")
def file_name(spark, sf):
    return P.postings(spark, sf).select("id", F.regexp_replace(F.concat("title", F.lit(" "), "company"), "[^A-Za-z0-9]+", "_").alias("file"))


@query("gradient_for", """select s_suppkey, cast(abs(list_reduce(list_prepend(cast(0 as bigint), list_transform(string_split(s_name, ''), lambda c: cast(ascii(c) as bigint))), lambda h, c: ((h * 31 + c + 2147483648) % 4294967296 + 4294967296) % 4294967296 - 2147483648)) % 5 as bigint) as shade from supplier""")
def gradient_for(spark, sf):
    """A 32-bit string hash, folded over the characters."""
    step = lambda h, c: F.pmod(h * 31 + F.ascii(c) + F.lit(2147483648), F.lit(4294967296)) - F.lit(2147483648)
    return _table(spark, sf, "supplier").select("s_suppkey", (F.abs(F.aggregate(F.split("s_name", ""), F.lit(0).cast("long"), step)) % 5).alias("shade"))


@query("fenced_json", "select event_id, cast(json_extract(props, '$.k') as bigint) as k from events")
def fenced_json(spark, sf):
    said = F.concat(F.lit("```json\n"), "props", F.lit("\n```"))
    bare = F.regexp_replace(said, r"^\s*```(?:json)?\s*|\s*```\s*$", "")
    return _table(spark, sf, "events").select("event_id", F.from_json(bare, "k long")["k"].alias("k"))


@query("clean_values", "select c_custkey, case when c_custkey % 4 in (0, 1) then '' else trim(c_mktsegment) end as said from customer")
def clean_values(spark, sf):
    raw = F.expr("case c_custkey % 4 when 0 then 'null' when 1 then null when 2 then concat(' ', c_mktsegment, ' ') else c_mktsegment end")
    bare = F.trim(F.coalesce(raw, F.lit("")))
    return _table(spark, sf, "customer").select("c_custkey", F.when(F.lower(bare) == "null", "").otherwise(bare).alias("said"))


@query("skills_longest_first", "select item_id, array_to_string(list_transform(list_sort(list_transform(list_distinct(list_filter(string_split(text, ' '), lambda w: w <> '')), lambda w: {'n': -length(w), 'w': w})), lambda x: x.w), ' ') as words from benchmark")
def skills_longest_first(spark, sf):
    words = F.array_distinct(F.filter(F.split("text", " "), lambda w: w != ""))
    ordered = F.transform(F.array_sort(F.transform(words, lambda w: F.struct((-F.length(w)).alias("n"), w.alias("w")))), lambda x: x["w"])
    return _table(spark, sf, "benchmark").select("item_id", F.array_join(ordered, " ").alias("words"))
