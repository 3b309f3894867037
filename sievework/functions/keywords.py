"""Many keywords in one pass: a trie of all terms, written as a regular expression that is tried once at each place.

Branches share their beginnings, so a place costs as many steps as characters match and not as many as there are terms.
A look-ahead takes no text, so overlapping terms are all found.  At one place an expression reports one term; terms
that begin with another one are therefore dealt into layers, one expression each, where no term begins another.
"""
from __future__ import annotations

import re
from collections.abc import Sequence
from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F


def _written(node: dict) -> str:
    """The expression of a trie's node; single children are run together."""
    parts = []
    for char, below in sorted(node.items()):
        run = re.escape(char).replace("\\ ", " ").replace("\\-", "-")
        parts.append(run + (_written(below) if below else ""))
    return parts[0] if len(parts) == 1 else f"(?:{'|'.join(parts)})"


@lru_cache(maxsize=64)
def layers(terms: tuple[str, ...]) -> tuple[str, ...]:
    """Expressions that together match exactly the terms, each with no term that begins another."""
    dealt: list[list[str]] = []
    for term in sorted(set(terms)):
        own = next((group for group in dealt if not any(term.startswith(t) for t in group)), None)
        if own is None:
            dealt.append(own := [])
        own.append(term)
    out = []
    for group in dealt:
        root: dict = {}
        for term in group:
            node = root
            for char in term:
                node = node.setdefault(char, {})
        out.append(_written(root))
    return tuple(out)


def first_hit(text: Column, terms: Sequence[str], groups: Sequence[int] | None = None, whole: bool = False) -> Column:
    """term and at (its first place, from 1) of the first term in list order that the text holds; null without one.

    With ``groups`` (a rising number for each term) the first group decides, and in it the leftmost place; terms of one group
    at one place go by list order.  With ``whole``, terms count only between word boundaries.
    """
    edge = r"\b" if whole else ""
    hits = []
    for expression in layers(tuple(terms)):
        pattern = f"(?={edge}({expression}){edge})"
        hits.append(F.regexp_extract_all(text, F.lit(pattern), F.lit(1)))
    # rank by list order: a handful of hits meet the list, never the text
    listed = F.array(*[F.lit(t) for t in terms])
    of = F.array(*[F.lit(g) for g in (groups or range(len(terms)))])
    rows = F.transform(F.array_distinct(F.concat(*hits)), lambda h: F.struct(F.get(of, F.array_position(listed, h).cast("int") - 1).alias("group"), _place(text, h, edge).alias("at"), F.array_position(listed, h).alias("rank"), h.alias("term")))
    best = F.array_min(rows)
    return F.when(F.size(rows) > 0, F.struct(best["term"].alias("term"), best["at"].alias("at")))


def _place(text: Column, term: Column, edge: str) -> Column:
    return F.regexp_instr(text, F.concat(F.lit(edge + r"\Q"), term, F.lit(r"\E" + edge))) if edge else F.position(term, text)
