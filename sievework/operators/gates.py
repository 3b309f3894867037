"""Checks that hold a draft against its original, on (doc_id, line_no, line) tables.

Section state is carried down each document by one window over its lines; comparisons are semi and anti joins on the
document, so documents never meet each other.
"""
from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import rules
from .documents import header_of, stripped

#: Fixed values.  (pattern, canonical title) of sections.
SECTION_ALIASES = (
    (r"^(?:PROFESSIONAL |EXECUTIVE |CAREER )?(?:SUMMARY|PROFILE|OBJECTIVE)$", "SUMMARY"),
    (r"^(?:TECHNICAL |CORE |KEY )?(?:SKILLS|PROFICIENCY|COMPETENCIES|EXPERTISE)$", "SKILLS"),
    (r"^(?:PROFESSIONAL |WORK |RELEVANT )?(?:EXPERIENCE|EMPLOYMENT|EMPLOYMENT HISTORY|CAREER HISTORY)$", "EXPERIENCE"),
    (r"^(?:STRATEGIC |KEY |SELECTED |ACADEMIC )?PROJECTS?$", "PROJECTS"),
    (r"^(?:EDUCATION|ACADEMIC BACKGROUND|EDUCATION TRAINING)$", "EDUCATION"),
    (r"^(?:CERTIFICATIONS?|LICENSES?|CERTIFICATIONS LICENSES)$", "CERTIFICATIONS"),
)
#: Fixed values.  Words of a certificate, and its levels.
CERT_WORD = r"(?i)\b(?:certified|certificate|certification|credential|aws|azure|gcp|google\s+cloud|databricks|comptia|cissp|pmp|scrum|snowflake|kubernetes|terraform|oracle|salesforce|tableau)\b"
CERT_LEVEL = r"(?i)\b(?:associate|professional|expert|specialty|foundational|practitioner|fundamentals|advanced|architect|master)\b"
#: Fixed values.  A role line, a line of tools, two bullets in one line.
ROLE = r"\s\|\s[^|]*\|\s"
ENVIRONMENT = r"(?i)^Environment\s*:"
MERGED = r"[a-z0-9][.)]\s*[•▪]\s*[A-Z]"

def _down():
    return Window.partitionBy("doc_id").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)


def _trimmed() -> Column:
    return stripped(F.col("line"))


def carried(lines: DataFrame, most: int = 40) -> DataFrame:
    """section, the last title (of ``most`` characters after its first) at or above; role, the last role line at or above
    within it."""
    head = header_of(F.col("line"), most)
    out = lines.withColumn("is_header", head).withColumn("section", F.last(F.when(head, _trimmed()), True).over(_down())).withColumn("part", F.sum(head.cast("int")).over(_down()))
    in_part = Window.partitionBy("doc_id", "part").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    return out.withColumn("role", F.last(F.when(_trimmed().rlike(ROLE), _trimmed()), True).over(in_part))


def opens_past(bullet: Column) -> Column:
    word = F.regexp_replace(F.lower(F.element_at(F.split(F.regexp_replace(stripped(bullet), r"^[•–-]\s*", ""), r"\s+"), 1)), "[^a-z]", "")
    return (word != "") & ~word.isin(*rules.PAST_IDENTICAL) & (word.isin(*rules.IRREGULAR_PAST) | word.endswith("ed"))


def past_tense_in_current_role(lines: DataFrame) -> DataFrame:
    t = _trimmed()
    return carried(lines).filter(
        ~F.col("is_header") & F.col("section").contains("EXPERIENCE") & F.col("role").rlike(r"(?i)\bpresent\b") & ~t.rlike(ROLE) & t.rlike(r"^[•–-]\s+") & opens_past(t)
    ).select("doc_id", "line_no", t.alias("line"))


def experience_bullets(lines: DataFrame) -> DataFrame:
    t = _trimmed()
    return carried(lines, 30).filter(~F.col("is_header") & F.col("section").contains("EXPERIENCE") & t.rlike(r"^-\s+")).select("doc_id", "line_no", F.regexp_replace(t, r"^-\s+", "").alias("bullet"))


def mended(line: Column, head: Column, section: Column) -> Column:
    """The line, with hyphens for dashes where it names a certificate."""
    cert = F.coalesce(section.contains("CERTIF"), F.lit(False)) | (line.rlike(CERT_WORD) & line.rlike(CERT_LEVEL))
    return F.when(~head & line.rlike("[—–]|--") & cert, F.regexp_replace(line, r"\s*(?:[—–]|--)\s*", " - ")).otherwise(line)


def cert_dashes(lines: DataFrame) -> DataFrame:
    """Dashes in certificate lines become hyphens; every other line stays."""
    return carried(lines).select("doc_id", "line_no", mended(F.col("line"), F.col("is_header"), F.col("section")).alias("line"))


def titled(bare: Column) -> Column:
    """Whether a stripped line without its colon is a section's title."""
    return (F.length(bare) <= 40) & bare.rlike(r"^[A-Z][A-Z\s&/]*$") & (F.size(F.split(bare, r"\s+")) <= 4)


def canonical(bare: Column) -> Column:
    """The canonical title of a section, or its own in single spaces."""
    name = F.regexp_replace(bare, r"\s+", " ")
    chain = None
    for pattern, title in SECTION_ALIASES:
        chain = F.when(name.rlike(pattern), title) if chain is None else chain.when(name.rlike(pattern), title)
    return chain.otherwise(name)


def reads_as_prose(t: Column) -> Column:
    """A long line that reads as a note or in the first person."""
    return (F.length(t) >= 120) & ~t.rlike(r"^[-•*]") & (t.rlike(r"(?i)^note\s*:") | t.rlike(r"\b(?:I|I'm|I've|my|me)\b"))


def work_words(text: Column, skills: Sequence[str] = ()) -> Column:
    """The content words of a text without those of the confirmed skills: they are expected to be new."""
    words = F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), "[^a-z0-9+#]+"), lambda w: (F.length(w) > 2) & ~w.isin(*rules.STOPWORDS))
    known = sorted({w for s in skills for w in re.split("[^a-z0-9+#]+", s.lower()) if w})
    return F.filter(words, lambda w: ~w.isin(*known)) if known else words


def section_headers(lines: DataFrame) -> DataFrame:
    """Short lines of capitals after the third line with text, by their canonical titles."""
    rows = lines.withColumn("t", F.regexp_replace(_trimmed(), r"[:：]\s*$", "")).withColumn("seen", F.sum((F.col("t") != "").cast("int")).over(_down()))
    return rows.filter((F.col("t") != "") & (F.col("seen") > 3) & titled(F.col("t"))).select("doc_id", "line_no", canonical(F.col("t")).alias("section"))


def invented_sections(draft: DataFrame, original: DataFrame) -> DataFrame:
    return section_headers(draft).select("doc_id", "section").distinct().join(section_headers(original).select("doc_id", "section"), ["doc_id", "section"], "left_anti")


def stray_prose(lines: DataFrame) -> DataFrame:
    """Long lines after the last section that read as a note or in the first person."""
    t = _trimmed()
    last = F.max(F.when(t.rlike(rules.RESUME_SECTION), F.col("line_no"))).over(Window.partitionBy("doc_id"))
    return lines.withColumn("last", last).filter(
        (F.col("line_no") > F.col("last")) & reads_as_prose(t)).select("doc_id", "line_no", t.alias("line"))


def dropped_environment(draft: DataFrame, original: DataFrame) -> DataFrame:
    """Environment lines of the original whose first 40 characters no line of the draft holds."""
    had = original.filter(_trimmed().rlike(ENVIRONMENT)).select("doc_id", "line_no", _trimmed().alias("line"))
    now = draft.select("doc_id", F.lower("line").alias("draft_line"))
    return had.join(now, (had["doc_id"] == now["doc_id"]) & F.contains(now["draft_line"], F.lower(F.substring(had["line"], 1, 40))), "left_anti")


def merged_bullets(lines: DataFrame) -> DataFrame:
    return lines.filter(F.col("line").rlike(MERGED)).select("doc_id", "line_no", F.substring(_trimmed(), 1, 140).alias("line"))


def invented_bullets(draft: DataFrame, original: DataFrame, share: float = 0.4, least: int = 4, skills: Sequence[str] = ()) -> DataFrame:
    """Bullets of the draft with few content words of the original; words of confirmed skills count on neither side."""
    known = original.select("doc_id", F.explode(work_words(F.col("line"), skills)).alias("word")).distinct().withColumn("known", F.lit(1))
    words = experience_bullets(draft).select("doc_id", "line_no", "bullet", F.explode(work_words(F.col("bullet"), skills)).alias("word"))
    counts = words.join(known, ["doc_id", "word"], "left").groupBy("doc_id", "line_no", "bullet").agg(F.count("*").alias("words"), F.count("known").alias("hits"))
    return counts.filter((F.col("words") >= least) & (F.col("hits") < share * F.col("words")))
