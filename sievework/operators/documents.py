"""Line-structured documents: carried sections, look-ahead, section and bullet comparison."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import rules, scalars


def stripped(x: Column) -> Column:
    """x without white space of any kind at its ends."""
    return F.regexp_replace(x, scalars.ENDS, "")


def lines(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, line_no (from 0), line."""
    return docs.select(F.col(key), F.posexplode(F.split(text, "\n")).alias("line_no", "line"))


def header_of(line: Column, most: int = 40) -> Column:
    """A short line of capitals is a section's title."""
    t = stripped(line)
    return t.rlike(rf"^[A-Z][A-Z &/]{{2,{most}}}$") & (F.size(F.split(t, " ")) <= 4)


def with_section(rows: DataFrame, key: str = "doc_id") -> DataFrame:
    """Each line with the last section title at or above it."""
    carried = Window.partitionBy(key).orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("section", F.last(F.when(header_of(F.col("line")), stripped(F.col("line"))), ignorenulls=True).over(carried))


def dashed(rows: DataFrame) -> DataFrame:
    return rows.filter(F.col("line").rlike("[—–]|--")).withColumn("line", stripped(F.col("line")))


def kinds(rows: DataFrame, key: str = "doc_id") -> DataFrame:
    """header (before the first section, never by the first line), section, bullet, role, skill, title (a plain line right
    above a role) or text, for each line of a resume."""
    t = stripped(F.col("line"))
    words = lambda x: F.size(F.split(x, r"\s+"))
    dated = F.contains(t, F.lit("Present")) | t.rlike(r"\b(Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec)\b|\b(19|20)\d{2}\b")
    piped = F.contains(t, F.lit(" | "))
    label = stripped(F.substring_index(t, ":", 1))
    skill = t.rlike(r"^[A-Za-z][A-Za-z /&+-]{1,48}:\s+.+$") & ~piped & ~t.rlike(r"https?:|www\.|@") & (words(label) <= 6)
    plain = (t != "") & (F.length(t) <= 32) & ~t.rlike(r"[.,;:|]") & (words(t) <= 4) & (t == F.upper(t)) & t.rlike("[A-Z]")
    own = F.when(t.rlike(rules.RESUME_SECTION), "section").when(t.rlike("^[•–-]"), "bullet").when(piped & dated, "role").when(skill, "skill").when(plain, "section").otherwise("text")
    whole = Window.partitionBy(key)
    out = rows.withColumn("own", own).withColumns({
        "following": F.lead("own").over(whole.orderBy("line_no")), "body": F.min(F.when((F.col("own") == "section") & (F.col("line_no") > 0), F.col("line_no"))).over(whole)})
    title = (F.col("own") == "text") & (t != "") & (F.col("following") == "role")
    kind = F.when(F.col("body").isNull() | (F.col("line_no") < F.col("body")), "header").when(title, "title").otherwise(F.col("own"))
    return out.withColumn("kind", kind).drop("own", "following", "body")


def is_point(line: Column) -> Column:
    """Whether a line is long enough to be a real point, and no title or environment line."""
    x = F.regexp_replace(stripped(line), r"^[•*▪-]\s*", "")
    return (F.length(x) >= 40) & ~x.rlike(r"^[A-Z][A-Z\s&/:]*$") & ~x.rlike(r"(?i)^Environment\s*:") & x.rlike(r"\s")


def bullet_counts(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """How many lines of each document are real points."""
    return docs.select(key, F.size(F.filter(F.split(text, "\n"), is_point)).alias("bullets"))


def lifted(docs: DataFrame, sources: DataFrame, size: int = 4, key: str = "doc_id", text: str = "text", source_text: str = "text") -> DataFrame:
    """How many distinct runs of ``size`` words each document shares with any source."""
    def runs(df: DataFrame, names: list[str], column: str) -> DataFrame:
        w = F.filter(F.split(F.lower(column), r"[^a-z0-9]+"), lambda x: x != "")
        all_runs = F.when(F.size("w") >= size, F.transform(F.sequence(F.lit(1), F.size("w") - size + 1), lambda i: F.array_join(F.slice("w", i, size), " ")))
        return df.select(*names, w.alias("w")).select(*names, F.explode(F.array_distinct(all_runs)).alias("run"))

    known = runs(sources, [], source_text).distinct()
    return runs(docs, [key], text).join(known, "run", "left_semi").groupBy(key).agg(F.count("*").alias("lifted"))
