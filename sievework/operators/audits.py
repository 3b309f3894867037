"""Audits by keyword lists: older taxonomies of titles and texts, an older contract filter, hints of foreign places.

Each says what it found and where, so that a wrong rule can be read off the result.
"""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import rules, scalars
from ..functions.dialect import SPARK
from ..functions.keywords import first_hit

CONTEXT = 40


def _labelled(text: Column, lists: Sequence[tuple[str, Sequence[str]]], whole: bool, ordered: bool, default: str | None) -> Column:
    """label, term and at of the first list of which the text holds a term: its first term in list order, or its leftmost."""
    terms = [t for _, some in lists for t in some]
    group = [i for i, (_, some) in enumerate(lists) for _ in some]
    if len(set(terms)) < len(terms):
        raise ValueError("a keyword stands in two lists")
    hit = first_hit(text, terms, None if ordered else group, whole)
    labels = F.array(*[F.lit(lists[g][0]) for g in group])
    label = F.get(labels, F.array_position(F.array(*[F.lit(t) for t in terms]), hit["term"]).cast("int") - 1)
    return F.struct(F.coalesce(label, F.lit(default)).alias("label"), hit["term"].alias("term"), hit["at"].alias("at"))


def title_taxonomy(title: Column) -> Column:
    """The first category of which the padded title holds a keyword, with that keyword and its place; else Uncategorised."""
    return _labelled(F.concat(F.lit(" "), F.lower(F.coalesce(title, F.lit(""))), F.lit(" ")), rules.TITLE_KEYWORDS, False, True, "Uncategorised")


def industry(text: Column) -> Column:
    """The first industry of which the text holds a whole word, its leftmost one, and 40 characters to both sides of its start."""
    safe = F.coalesce(text, F.lit(""))
    found = _labelled(F.lower(safe), rules.INDUSTRY_KEYWORDS, True, False, None)
    begin = F.greatest(F.lit(1), found["at"] - CONTEXT)
    return F.when(found["term"].isNotNull(), F.struct(found["label"].alias("label"), found["term"].alias("term"), F.substr(safe, begin, found["at"] + CONTEXT - begin).alias("context")))


def contract_reason(text: Column, title: Column) -> Column:
    """Why the older filter hides a posting; null where it keeps it."""
    safe_title = F.coalesce(title, F.lit(""))
    t = F.lower(F.concat(safe_title, F.lit(" "), F.coalesce(text, F.lit(""))))

    def around(pattern: str, reach: int) -> Column:
        at, size = F.regexp_instr(t, F.lit(pattern)), F.length(F.regexp_extract(t, pattern, 0))
        begin = F.greatest(F.lit(1), at - reach)
        return F.substr(t, begin, at + size + reach - begin)

    excused = t.rlike("|".join(f"(?:{p})" for p in rules.CONTRACT_EXCEPTIONS))
    temporary = F.when(~around(rules.OLD_TEMPORARY, 50).rlike(rules.OLD_PERMANENT), "contractor/temp")
    return (
        F.when(safe_title.rlike(rules.OLD_CONTRACT_TITLE), "title parenthetical")
        .when(t.rlike(rules.OLD_PART_TIME) & ~around(rules.OLD_PART_TIME, 25).rlike(rules.OLD_FULL_TIME), "part-time")
        .when(excused, F.lit(None)).when(t.rlike(rules.OLD_TEMPORARY), temporary).when(t.rlike(rules.OLD_CONTRACT_ROLE), "contract position (adjacent)"))


def foreign_hint(place: Column) -> Column:
    """remote-foreign, or the first hint in list order that stands in the place as a whole word; null without one."""
    low = F.lower(F.coalesce(place, F.lit("")))
    return F.when(low.rlike(rules.REMOTE_ABROAD), "remote-foreign").otherwise(first_hit(low, rules.FOREIGN_HINTS, whole=True)["term"])


def disqualifier_hit(name: str) -> str:
    """SQL of rule (from 1), pattern and context (in the normalised text) of the first rule that holds on a column; null where none does."""
    d, listed = SPARK, SPARK.array(map(SPARK.text, rules.DISQUALIFIERS))
    found = d.let("regexp_instr(n, p)", "at", f"named_struct('rule', r, 'pattern', p, 'context', {scalars.snippet(d, 'n', 'at', 'length(regexp_substr(n, p))')})")
    ruled = d.let(scalars.disqualifier(d, "n"), "r", f"if(r = 0, null, {d.let(f'element_at({listed}, greatest(r, 1))', 'p', found)})")
    return d.let(scalars.normalised(d, name), "n", ruled)
