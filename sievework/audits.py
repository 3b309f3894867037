"""Audit queries, each with SQL written by hand: chains of the lists themselves."""
from __future__ import annotations

from pyspark.sql import functions as F

from . import queries as Q
from .functions import column, rules
from .functions import scalars as S
from .functions.dialect import CHECK
from .operators import audits
from .plans import landing, postings as P

query = Q.query
_P = Q._POSTINGS
_FLAT = f"({landing.flat_sql(CHECK)})"


def _in(values) -> str:
    return "[" + ", ".join(CHECK.text(v) for v in values) + "]"


_HELD = "list_filter({0}, lambda w: contains({1}, w))"
_TITLES = "(select 'job' as kind, id, title from {0} union all select 'part', cast(p_partkey as varchar), concat(p_name, ' ', p_type) from part union all select 'text', cast(doc_id as varchar), text from documents)"
_TAXONOMY = " ".join(f"when len({_HELD.format(_in(words), 't')}) > 0 then '{name}'" for name, words in rules.TITLE_KEYWORDS)
_TERM = f"{_HELD.format(_in(w for _, words in rules.TITLE_KEYWORDS for w in words), 't')}[1]"


@query("title_taxonomy", f"select kind, id, case {_TAXONOMY} else 'Uncategorised' end as category, {_TERM} as term, instr(t, {_TERM}) as at from (select *, concat(' ', lower(coalesce(title, '')), ' ') as t from {_TITLES.format(_P)})")
def title_taxonomy(spark, sf):
    """Titles of postings, names of parts and whole documents, so that the lists meet many texts."""
    read = lambda t: spark.read.parquet(f"{sf}/{t}.parquet")
    rows = P.postings(spark, sf).selectExpr("'job' as kind", "id", "title").unionByName(
        read("part").selectExpr("'part' as kind", "cast(p_partkey as string) as id", "concat(p_name, ' ', p_type) as title")).unionByName(read("documents").selectExpr("'text' as kind", "cast(doc_id as string) as id", "text as title"))
    return rows.select("kind", "id", audits.title_taxonomy(F.col("title")).alias("t")).select("kind", "id", F.col("t.label").alias("category"), "t.term", F.col("t.at").cast("long").alias("at"))


@query("uncategorised_titles", f"select title, count(*) as n from (select title, concat(' ', lower(title), ' ') as t from {_P}) where len({_HELD.format(_in(w for _, words in rules.TITLE_KEYWORDS for w in words), 't')}) = 0 group by title order by n desc, title limit 150")
def uncategorised_titles(spark, sf):
    rows = P.postings(spark, sf).filter(audits.title_taxonomy(F.col("title"))["term"].isNull())
    return rows.groupBy("title").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "title").limit(150)


def _industry_sql(text: str) -> str:
    chain = " ".join(rf"when regexp_matches(t, '\b({'|'.join(words)})\b') then '{name}'" for name, words in rules.INDUSTRY_KEYWORDS)
    first = " ".join(rf"when regexp_matches(t, '\b({'|'.join(words)})\b') then regexp_extract(t, '\b({'|'.join(words)})\b')" for _, words in rules.INDUSTRY_KEYWORDS)
    before = " ".join(rf"when regexp_matches(t, '\b({'|'.join(words)})\b') then length(regexp_extract(t, '(?s)^(.*?)\b(?:{'|'.join(words)})\b', 1))" for _, words in rules.INDUSTRY_KEYWORDS)
    return f"select id, label, term, substring(said, greatest(1, p - 39), p + 41 - greatest(1, p - 39)) as context from (select id, said, case {chain} end as label, case {first} end as term, case {before} end as p from (select *, lower(said) as t from {text}))"


_SAID = f"(select cast(n as varchar) as id, {S.strip_html(CHECK, 'body')} as said from {_FLAT})"


@query("legacy_industry", _industry_sql(f"(select * from {_SAID} union all select concat('item_', cast(item_id as varchar)), coalesce(text, '') from benchmark union all select concat('conv_', cast(conv_id as varchar), '_', cast(turn as varchar)), coalesce(text, '') from conversations)"))
def legacy_industry(spark, sf):
    """Texts of postings (with the documents in them), of benchmark items and of conversations."""
    read = lambda t: spark.read.parquet(f"{sf}/{t}.parquet")
    rows = landing.flat(spark, sf).select(F.col("n").cast("string").alias("id"), column(S.strip_html, "body").alias("said"))
    rows = rows.unionByName(read("benchmark").selectExpr("concat('item_', item_id) as id", "text as said")).unionByName(read("conversations").selectExpr("concat('conv_', conv_id, '_', turn) as id", "text as said"))
    return rows.select("id", audits.industry(F.col("said")).alias("i")).select("id", "i.label", "i.term", "i.context")


_T = "lower(concat(title, ' ', said))"


def _near(pattern: str, reach: int) -> str:
    before = f"length(regexp_extract({_T}, '(?s)^(.*?)(?:{pattern})', 1))"
    return f"substring({_T}, greatest(1, {before} + 1 - {reach}), {before} + 1 + length(regexp_extract({_T}, '{pattern}')) + {reach} - greatest(1, {before} + 1 - {reach}))"


@query("legacy_contract", f"""select id, case when regexp_matches(title, '{rules.OLD_CONTRACT_TITLE}') then 'title parenthetical' when regexp_matches({_T}, '{rules.OLD_PART_TIME}') and not regexp_matches({_near(rules.OLD_PART_TIME, 25)}, '{rules.OLD_FULL_TIME}') then 'part-time'
when {CHECK.any_match(_T, rules.CONTRACT_EXCEPTIONS)} then null when regexp_matches({_T}, '{rules.OLD_TEMPORARY}') then case when regexp_matches({_near(rules.OLD_TEMPORARY, 50)}, '{rules.OLD_PERMANENT}') then null else 'contractor/temp' end
when regexp_matches({_T}, '{rules.OLD_CONTRACT_ROLE}') then 'contract position (adjacent)' end as reason from (select cast(n as varchar) as id, title, {S.strip_html(CHECK, 'body')} as said from {_FLAT})""")
def legacy_contract(spark, sf):
    rows = landing.flat(spark, sf).select(F.col("n").cast("string").alias("id"), "title", column(S.strip_html, "body").alias("said"))
    return rows.select("id", audits.contract_reason(F.col("said"), F.col("title")).alias("reason"))


# a dotted capital I becomes two characters in lower case
_LOW = "lower(replace(coalesce(location, ''), 'İ', 'i' || chr(775)))"


_HINTS = f"(select location, case when regexp_matches({_LOW}, {CHECK.text(rules.REMOTE_ABROAD)}) then 'remote-foreign' else list_filter({_in(rules.FOREIGN_HINTS)}, lambda w: regexp_matches({_LOW}, concat('\\b', w, '\\b')))[1] end as hint from (select distinct location from {_P}))"


@query("foreign_hints", f"select id, hint from {_P} p join {_HINTS} h on p.location is not distinct from h.location")
def foreign_hints(spark, sf):
    return P.postings(spark, sf).select("id", audits.foreign_hint(F.col("location")).alias("hint"))


@query("foreign_slips", f"select p.location, hint, n from (select location, count(*) as n from {_P} group by location) p join {_HINTS} h on p.location is not distinct from h.location where hint is not null and {S.location_kind(CHECK, 'p.location')} in ('us', 'weak-us', 'ambiguous')")
def foreign_slips(spark, sf):
    """Places that pass as domestic but hint at another country."""
    rows = P.postings(spark, sf).groupBy("location").agg(F.count("*").alias("n")).withColumn("hint", audits.foreign_hint(F.col("location")))
    return rows.filter(F.col("hint").isNotNull() & column(S.location_kind, "location").isin("us", "weak-us", "ambiguous")).select("location", "hint", "n")
