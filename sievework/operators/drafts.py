"""Whole-text checks of a draft against its original: months of work, the summary, credential codes, the joint verdict."""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import rules
from . import documents, gates, staging
from .documents import stripped

#: Fixed values.  Months and a range of dates.
_MONTHS = "jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec"
DATE_RANGE = rf"(?i)\b(?:({_MONTHS})[a-z]*\.?\s+|(\d{{1,2}})[/-])?((?:19|20)\d{{2}})\s*[–—-]{{1,2}}\s*(?:(present|current|now)|(?:({_MONTHS})[a-z]*\.?\s+|(\d{{1,2}})[/-])?((?:19|20)\d{{2}}))"
#: Fixed values.  Where the work history begins and ends, the summary, any title, the certificates.
WORK_START = r"(?im)^\s*(?:PROFESSIONAL\s+|WORK\s+|RELEVANT\s+)?(?:EXPERIENCE|EMPLOYMENT(?:\s+HISTORY)?|CAREER\s+HISTORY)\s*:?\s*$"
WORK_END = r"(?im)^\s*(?:[A-Z][A-Za-z]*\s+)?(PROJECTS|EDUCATION|CERTIFICATIONS?|SKILLS|AWARDS|PUBLICATIONS)\s*:?\s*$"
SUMMARY_LINE = r"(?im)^[ \t]*(?:PROFESSIONAL\s+|EXECUTIVE\s+|CAREER\s+)?(?:SUMMARY|PROFILE|OBJECTIVE)[ \t]*:?[ \t]*$"
TITLE_LINE = r"(?m)^[ \t]*[A-Z][A-Z\s&/]{2,39}:?[ \t]*$"
CERT_LINE = r"(?im)^[ \t]*CERTIFICATIONS?[ \t]*:?[ \t]*$"
#: Fixed values.  A credential code, two bullets in one line, a page mark, words that a draft must not have, a number.
CERT_SHAPED = r"\b(?:[A-Z]{2,3}CE|[A-Z]{4,6}|(?:AWS|AZ|GCP|MS|CCNA|CCNP|PMP|CISSP|CISA|CSM|SAA|DP|AI|DVA)[- ]?\d{2,3})\b"
MERGED = r"([a-z0-9][.)])\s*([•▪]\s*[A-Z])"
PAGE_MARKER = r"(?m)^\s*--\s*\d+\s+of\s+\d+\s*--\s*$"
BANNED = ("spearhead", "leverag", "synerg", "robust", "seamless", "cutting-edge", "innovative", "passionate", "dynamic", "results-driven", "proven track record", "myriad", "delve", "tapestry", "—")
TO_THE_READER = (" your ", " you ", " you're ", " we ")
NUMBER = r"\b\d+(?:\.\d+)?\s*(?:TB|GB|PB|MB|k|K|M|%|x|×)?\b"


def whole(lines: DataFrame) -> DataFrame:
    """(doc_id, line_no, line) rows to doc_id, text."""
    return lines.groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "line"))), lambda x: x["line"]), "\n").alias("text"))


def experience_months(text: Column, year: int, month: int) -> Column:
    """The months of all date ranges in the experience section, both ends included; null without a section or a range."""
    start = F.regexp_instr(text, F.lit(WORK_START))
    after = F.substr(text, start)
    end = F.regexp_instr(F.substr(after, F.lit(2)), F.lit(WORK_END))
    section = F.when(end == 0, after).otherwise(F.substr(after, F.lit(1), end))
    group = lambda i: F.regexp_extract_all(section, F.lit(DATE_RANGE), F.lit(i))
    number = lambda x: F.try_to_number(x, F.lit("9999")).cast("int")
    named = lambda x: F.floor((F.position(F.lower(x), F.lit(_MONTHS)) + 3) / 4).cast("int")
    of = lambda name, digits, default: F.when(name != "", named(name)).when(digits != "", number(digits)).otherwise(default)
    ranges = F.arrays_zip(*[group(i).alias(f"g{i}") for i in range(1, 8)])

    def months(r: Column) -> Column:
        g = lambda i: r[f"g{i}"]
        begin = number(g(3)) * 12 + of(g(1), g(2), F.lit(1))
        last = F.when(g(4) != "", F.lit(year * 12 + month)).otherwise(number(g(7)) * 12 + of(g(5), g(6), F.lit(12)))
        return last - begin + 1

    kept = F.filter(F.transform(ranges, months), lambda m: (m > 0) & (m < 600))
    return F.when((start > 0) & (F.size(kept) > 0), F.aggregate(kept, F.lit(0), lambda a, m: a + m))


def summary_sentences(text: Column) -> Column:
    """The sentences of more than 15 characters below the summary's title; null without one or without text there."""
    title = F.regexp_extract(text, SUMMARY_LINE, 0)
    has = F.regexp_instr(text, F.lit(SUMMARY_LINE)) > 0
    after = F.substr(text, F.position(title, text) + F.length(title))
    end = F.regexp_instr(after, F.lit(TITLE_LINE))
    body = stripped(F.when(end == 0, after).otherwise(F.substr(after, F.lit(1), end - 1)))
    sentences = F.filter(F.transform(F.split(body, r"(?<=[.!?])\s+"), stripped), lambda s: F.length(s) > 15)
    return F.when(has & (body != ""), sentences)


def summary_drift(both: DataFrame) -> DataFrame:
    """both: doc_id, original, draft.  Documents whose summary of two sentences or more lost or gained some."""
    n = both.select("doc_id", F.size(summary_sentences(F.col("original"))).alias("before"), F.size(summary_sentences(F.col("draft"))).alias("after"))
    return n.filter("before >= 2 and after >= 0 and before <> after").withColumn("dir", F.when(F.col("after") < F.col("before"), "cut").otherwise("padded"))


def stray_certs(original: Column, draft: Column) -> Column:
    """Credential codes of the draft outside its certificates that the original does not have."""
    cut = F.regexp_instr(draft, F.lit(CERT_LINE))
    body = F.when(cut == 0, draft).otherwise(F.substr(draft, F.lit(1), cut - 1))
    lines = F.array_join(F.filter(F.split(body, "\n"), lambda x: ~x.rlike(TITLE_LINE)), "\n")
    bare = lambda t: F.regexp_replace(F.upper(t), "[- ]", "")
    return F.filter(F.array_distinct(F.regexp_extract_all(lines, F.lit(CERT_SHAPED), F.lit(0))), lambda t: ~bare(t).isin(*rules.SAFE_CODES) & ~F.contains(F.upper(original), bare(t)))


def repaired(text: Column, codes: Column) -> Column:
    """Merged bullets get their line break, and the given codes go with the comma before them."""
    split = F.regexp_replace(text, MERGED, "$1\n$2")
    bare = F.aggregate(codes, split, lambda t, c: F.regexp_replace(t, F.concat(F.lit(r"[,;]?\s*\b\Q"), c, F.lit(r"\E\b")), F.lit("")))
    tidied = F.regexp_replace(F.regexp_replace(F.regexp_replace(bare, r",\s*,", ","), r",\s*\.", "."), r"\s{2,}", " ")
    return F.when(F.size(codes) > 0, tidied).otherwise(split)


def facts(lines: DataFrame, mend: bool = False, skills: Sequence[str] = ()) -> DataFrame:
    """One row a document with all that the gates ask of one version: (doc_id, line_no, line) are dealt by document once, and
    one window over a document's lines carries sections and roles down.  ``mend`` puts hyphens into certificate lines first.

    text, dashes, past, merged (counts), stray, sections, environment, words (arrays), bullets (line_no, words), points (bullet count).
    """
    down = Window.partitionBy("doc_id").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    t, head, short = stripped(F.col("line")), gates.header_of(F.col("line")), gates.header_of(F.col("line"), 30)
    bare = F.regexp_replace(t, r"[:：]\s*$", "")
    rows = lines.select("doc_id", "line_no", "line", t.alias("t"), head.alias("head"), short.alias("short"), bare.alias("bare"), t.rlike(gates.ROLE).alias("is_role"))
    # a role line of a section; no line is both a title and a role
    rows = rows.withColumn("part", F.sum(F.col("head").cast("int")).over(down)).withColumns({
        "section": F.last(F.when(F.col("head"), F.col("t")), True).over(down), "small": F.last(F.when(F.col("short"), F.col("t")), True).over(down),
        "last_role": F.last(F.when(F.col("is_role"), F.struct("part", "t")), True).over(down), "seen": F.sum((F.col("bare") != "").cast("int")).over(down),
        "last": F.max(F.when(F.col("t").rlike(rules.RESUME_SECTION), F.col("line_no"))).over(Window.partitionBy("doc_id"))})
    if mend:
        rows = rows.withColumn("line", gates.mended(F.col("line"), F.col("head"), F.col("section"))).withColumn("t", stripped(F.col("line")))
    role = F.when(F.col("last_role.part") == F.col("part"), F.col("last_role.t"))
    t, line, head = F.col("t"), F.col("line"), F.col("head")
    past = ~head & F.col("section").contains("EXPERIENCE") & role.rlike(r"(?i)\bpresent\b") & ~t.rlike(gates.ROLE) & t.rlike(r"^[•–-]\s+") & gates.opens_past(t)
    stray = (F.col("line_no") > F.col("last")) & gates.reads_as_prose(t)
    titled = (F.col("bare") != "") & (F.col("seen") > 3) & gates.titled(F.col("bare"))
    bullet = ~F.col("short") & F.col("small").contains("EXPERIENCE") & t.rlike(r"^-\s+")
    words = gates.work_words(line, skills)
    point = documents.is_point(line)
    each = lambda test, value: F.collect_list(F.when(test, value))
    return rows.groupBy("doc_id").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "line"))), lambda x: x["line"]), "\n").alias("text"), F.count_if(line.rlike("[—–]|--")).alias("dashes"), F.count_if(past).alias("past"),
        F.count_if(line.rlike(gates.MERGED)).alias("merged"), F.array_sort(each(stray, F.struct("line_no", "t"))).alias("stray"), F.collect_set(F.when(titled, gates.canonical(F.col("bare")))).alias("sections"),
        F.array_sort(each(t.rlike(gates.ENVIRONMENT), F.struct("line_no", "t"))).alias("environment"), F.array_distinct(F.flatten(F.collect_list(words))).alias("words"),
        each(bullet, F.struct("line_no", gates.work_words(F.regexp_replace(t, r"^-\s+", ""), skills).alias("words"))).alias("bullets"), F.count_if(point).alias("points"))


def _gates(share: float = 0.4, least: int = 4) -> dict[str, Column]:
    """The gates by name, on the columns of a draft's facts and of its original's (o_...)."""
    a, b = F.col("o_told"), F.col("told")
    known = lambda w: F.size(F.filter(w, lambda x: F.array_contains("o_words", x)))
    return {
        "invented": F.exists("bullets", lambda x: (F.size(x["words"]) >= least) & (known(x["words"]) < share * F.size(x["words"]))), "dashes": F.col("dashes") > 0, "past_tense": F.col("past") > 0, "stray": F.size("stray") > 0,
        "sections": F.size("added") > 0, "lost": (F.col("o_points") >= 8) & (F.col("points") < F.col("o_points") * 0.75), "summary": (a >= 2) & (b >= 0) & (a != b),
        "environment": F.exists("o_environment", lambda e: ~F.contains("low", F.lower(F.substring(e["t"], 1, 40)))), "certs": F.size("codes") > 0, "merged": F.col("merged") > 0}


#: What the gates ask of an original.
COMPARED = ("text", "sections", "environment", "words", "points")


def _judged(of_original: DataFrame, draft: DataFrame, skills: Sequence[str]) -> DataFrame:
    """A draft's facts, its original's (o_...), the sections and codes it added, the summaries' sentences and failed (an array of
    names).  A draft without an original fails no gate that compares.  What several gates and repairs ask is a column, found once.

    Originals are never broadcast: their lines are alike, so a written table of them is many times smaller than its rows in
    memory, and Spark would go by the size of its files."""
    theirs = of_original.select("doc_id", *[F.col(c).alias(f"o_{c}") for c in COMPARED]).hint("merge")
    both = facts(draft, True, skills).join(theirs, "doc_id", "left")
    both = both.withColumns({
        "added": F.array_sort(F.array_except("sections", "o_sections")), "codes": stray_certs(F.col("o_text"), F.col("text")), "low": F.lower("text"),
        "told": F.size(summary_sentences(F.col("text"))), "o_told": F.size(summary_sentences(F.col("o_text")))})
    named = F.array(*[F.when(F.coalesce(test, F.lit(False)), F.lit(name)) for name, test in sorted(_gates().items())])
    return both.withColumn("failed", F.filter(named, lambda x: x.isNotNull()))


def verdicts(original: DataFrame, draft: DataFrame, skills: Sequence[str] = ()) -> DataFrame:
    """doc_id, failed (the names of the gates that fire, in order) and passed, for every draft.

    original, draft: (doc_id, line_no, line); skills: what the candidate confirmed.  Each version is read and dealt by document
    once, and the two meet by document.
    """
    return _judged(facts(original, False, skills), draft, skills).select("doc_id", F.array_join("failed", ",").alias("failed"), (F.size("failed") == 0).alias("passed"))


def _without(text: Column, part: Column) -> Column:
    """text without the first occurrence of a part, and without white space at its ends."""
    at = F.position(part, text)
    return stripped(F.when(at > 0, F.concat(F.substr(text, F.lit(1), at - 1), F.substr(text, at + F.length(part)))).otherwise(text))


def _without_section(text: Column, title: Column) -> Column:
    """text without the interval from a section's title to the next title, or to the end."""
    own = F.regexp_substr(text, F.concat(F.lit(r"(?mi)^[ \t]*\Q"), title, F.lit(r"\E[ \t]*:?[ \t]*$")))
    at = F.position(own, text)
    rest = F.substr(text, at + F.length(own))
    following = F.regexp_instr(rest, F.lit(TITLE_LINE))
    return F.when(own.isNull(), text).otherwise(stripped(F.concat(F.substr(text, F.lit(1), at - 1), F.when(following > 0, F.substr(rest, following)).otherwise(F.lit("")))))


def _repair() -> Column:
    """A judged draft's text after the repairs that need no writer: prose behind the last section and invented sections go,
    merged bullets part, credential codes that the original lacks go."""
    plain = F.aggregate(F.transform("stray", lambda x: x["t"]), F.col("text"), _without)
    cut = F.aggregate(F.coalesce("added", F.array().cast("array<string>")), plain, _without_section)
    return repaired(cut, F.coalesce("codes", F.array().cast("array<string>")))


#: The gates whose faults a repair can mend.
REPAIRABLE = ("certs", "merged", "sections", "stray")


def repair_round(of_original: DataFrame, drafts: DataFrame, skills: Sequence[str] = ()) -> DataFrame:
    """drafts: doc_id, text.  doc_id, text (after the repairs), before (as judged, hyphens in certificate lines) and failed (what was judged)."""
    lines = drafts.select("doc_id", F.posexplode(F.split("text", "\n")).alias("line_no", "line"))
    judged = _judged(of_original, lines, skills)
    mend = F.arrays_overlap("failed", F.array(*[F.lit(x) for x in REPAIRABLE]))
    return judged.select("doc_id", F.when(mend, _repair()).otherwise(F.col("text")).alias("text"), F.col("text").alias("before"), "failed")


def repaired_drafts(original: DataFrame, draft: DataFrame, rounds: int = 4, skills: Sequence[str] = ()) -> DataFrame:
    """doc_id, text, rounds (that changed it) and failed (what the last judgement still found, joined), for every draft.

    A round judges the drafts that the one before changed and repairs them; it ends when none changes, or after ``rounds``.
    The state is written to the shared folder after each round, so plans do not grow and a lost executor costs one round.
    Writers' faults (invented work, tense, lost bullets) stay and are named.
    """
    of_original = staging.written(facts(original, False, skills).select("doc_id", *COMPARED))
    open_ = draft.groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "line"))), lambda x: x["line"]), "\n").alias("text"))
    done = None
    for n in range(1, rounds + 2):
        judged = staging.written(repair_round(of_original, open_, skills).withColumn("changed", F.lit(n <= rounds) & (F.col("text") != F.col("before"))))
        closed = judged.filter("not changed").select("doc_id", F.col("before").alias("text"), F.lit(n - 1).alias("rounds"), F.array_join("failed", ",").alias("failed"))
        done = closed if done is None else done.unionByName(closed)
        open_ = judged.filter("changed").select("doc_id", "text")
        if n > rounds or open_.isEmpty():
            break
    return done


def keyword_match(words: Column, text: Column) -> tuple[Column, Column, Column]:
    """matched, total and score: how many keywords a text holds, in percent rounded half up; 0 without keywords."""
    matched, total = F.size(F.filter(words, lambda w: F.contains(F.lower(text), F.lower(w)))), F.size(words)
    return matched.alias("matched"), total.alias("total"), F.when(total == 0, 0).otherwise(F.floor(F.lit(100.0) * matched / total + 0.5)).cast("long").alias("score")


def tidied(text: Column) -> Column:
    """Text of a binary document without page marks, odd spaces and runs of blank lines."""
    out = F.regexp_replace(F.coalesce(text, F.lit("")), PAGE_MARKER, "")
    for pattern, by in (("\r\n", "\n"), (" ", " "), (r"[ \t]+\n", "\n"), (r"\n{3,}", "\n\n")):
        out = F.regexp_replace(out, pattern, by)
    return stripped(out)
