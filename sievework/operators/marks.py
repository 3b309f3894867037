"""What a reader's page adds to a text: marks on skills and headings; and the parts of a draft that are counted by eye."""
from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from .documents import stripped

#: Fixed values.  The block of skills and its end, a grouped line, where a role begins, a bullet, a tracking tag.
SKILLS_BLOCK = r"(?i)SKILLS\s*\n([\s\S]*?)(?:\n\s*\n|\nEDUCATION|$)"
GROUPED = r"(?m)^\s*[A-Za-z][\w\s&/-]*:"
ROLE_START = r"\n(?=[A-Z][^\n]*\(\d{4})"
BULLET = r"(?m)^\s*-\s"
TRACKING = r"^#LI-[A-Za-z0-9-]+$"
#: A heading's element, and a paragraph or block that holds no other block.
HEADING = r"(?is)<(h[1-6])\b[^>]*>(.*?)</\1\s*>"
LEAF = r"(?is)<(p|div)\b[^>]*>((?:(?!</?(?:p|div|ul|ol|li|table)\b).)*)</\1\s*>"
BOLD = r"(?is)<(strong|b)\b[^>]*>(.*?)</\1\s*>"
LONGEST_HEADING = 120


def claimed(text: Column, terms: Sequence[str]) -> Column:
    """term (as it stands) and at (from 1) of the first place of each term, in the order of the text.

    The text is read from the left; at each place the longest term is taken and its characters are used up, also where the term
    has been seen before, so that ranges never overlap."""
    ordered = sorted(dict.fromkeys(t for t in terms if t), key=lambda t: (-len(t), terms.index(t)))
    if not ordered:
        return F.array().cast("array<struct<term:string,at:int>>")
    pattern = "(?i)" + "|".join(re.escape(t) for t in ordered)
    hits, rests = F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.split(text, pattern, -1)
    # the place of a hit: all texts between the hits ahead of it, and those hits
    walk = F.aggregate(
        F.zip_with(rests, hits, lambda r, h: F.struct(F.length(F.coalesce(r, F.lit(""))).alias("gap"), h.alias("hit"))),
        F.struct(F.lit(1).alias("next"), F.array().cast("array<struct<term:string,at:int>>").alias("out")),
        lambda s, x: F.struct(
            (s["next"] + x["gap"] + F.coalesce(F.length(x["hit"]), F.lit(0))).alias("next"),
            F.when(x["hit"].isNull() | F.exists(s["out"], lambda o: F.lower(o["term"]) == F.lower(x["hit"])), s["out"]).otherwise(
                F.concat(s["out"], F.array(F.struct(x["hit"].alias("term"), (s["next"] + x["gap"]).alias("at"))))).alias("out")))
    return F.when(text.isNotNull(), walk["out"])


def marked(text: Column, places: Column, before: str = "<mark>", behind: str = "</mark>") -> Column:
    """text with marks around the claimed places."""
    walk = F.aggregate(
        places, F.struct(F.lit(1).alias("next"), F.lit("").alias("out")),
        lambda s, p: F.struct((p["at"] + F.length(p["term"])).alias("next"), F.concat(s["out"], F.substr(text, s["next"], p["at"] - s["next"]), F.lit(before), p["term"], F.lit(behind)).alias("out")))
    return F.concat(walk["out"], F.substr(text, walk["next"], F.length(text) - walk["next"] + 1))


def _visible(html: Column) -> Column:
    bare = F.regexp_replace(html, "<[^>]*>", "")
    for entity, by in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        bare = F.replace(bare, F.lit(entity), F.lit(by))
    return stripped(bare)


def headings(html: Column) -> Column:
    """The texts of a page's headings: elements h1 to h6, and short paragraphs or blocks without blocks in them of which every
    visible character is bold.  First the elements, then the blocks, each in page order."""
    element = F.transform(F.regexp_extract_all(html, F.lit(HEADING), F.lit(2)), _visible)
    blocks = F.regexp_extract_all(html, F.lit(LEAF), F.lit(2))
    dense = lambda x: F.regexp_replace(x, r"[\s\x{a0}]+", "")
    bold = lambda b: dense(F.array_join(F.transform(F.regexp_extract_all(b, F.lit(BOLD), F.lit(2)), _visible), ""))
    heads = F.filter(blocks, lambda b: (F.length(_visible(b)).between(1, LONGEST_HEADING)) & (bold(b) != "") & (bold(b) == dense(_visible(b))))
    return F.concat(F.coalesce(element, F.array().cast("array<string>")), F.coalesce(F.transform(heads, _visible), F.array().cast("array<string>")))


def untracked(html: Column) -> Column:
    """html without the paragraphs, blocks and spans that hold nothing but a tracking tag."""
    return F.regexp_replace(html, r"(?is)<(p|div|span)\b[^>]*>\s*#LI-[A-Za-z0-9-]+\s*</\1\s*>", "")


def skills_block(text: Column) -> Column:
    """block (the lines below the title of skills, to a blank line or the education), grouped (whether a line names a group)."""
    block = F.regexp_extract(text, SKILLS_BLOCK, 1)
    return F.struct(stripped(block).alias("block"), block.rlike(GROUPED).alias("grouped"), F.size(F.regexp_extract_all(block, F.lit(GROUPED), F.lit(0))).alias("groups"))


def role_bullets(text: Column) -> Column:
    """title (its first line) and bullets of each role: a run that begins at a line of a capital and a year in brackets."""
    parts = F.split(text, ROLE_START, -1)
    roles = F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(0)))
    return F.transform(roles, lambda r: F.struct(stripped(F.substring_index(r, "\n", 1)).alias("title"), F.size(F.regexp_extract_all(r, F.lit(BULLET), F.lit(0))).alias("bullets")))
