"""Expressions that read alike in Spark SQL and in the SQL that checks them."""
from __future__ import annotations

import re
from collections.abc import Iterable

from .literals import required


class Dialect:
    """Writes the few things that differ: literals, regular expressions, arrays."""

    def __init__(self, spark: bool):
        self.spark = spark

    def text(self, value: str) -> str:
        if self.spark:
            return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"
        return "'" + value.replace("'", "''") + "'"

    def match(self, x: str, pattern: str) -> str:
        if self.spark:
            return f"({x} rlike {self.text(pattern)})"
        if "(?!" in pattern:  # the checking engine has no look-ahead: all matches, less those that what must not follow does follow
            barred, free = [re.sub(r"\(\?!([^()]*(?:\([^()]*\)[^()]*)*)\)", by, pattern) for by in (r"(?:\1)", "")]
            return f"(regexp_matches({x}, {self.text(free)}) and not regexp_matches({x}, {self.text(barred)}))"
        return f"regexp_matches({x}, {self.text(pattern)})"

    def any_match(self, x: str, patterns: Iterable[str]) -> str:
        """One alternation instead of a chain of tests.  A long list is split by the literals its patterns cannot match
        without: only those whose literals stand in the text are tried."""
        patterns = list(patterns)
        if self.spark and len(patterns) > 8 and not any("(?i" in p for p in patterns):
            groups: dict = {}
            for p in patterns:
                groups.setdefault(required(p), []).append(p)
            tests = [self.gated("gated", needs, "|".join(f"(?:{p})" for p in some)) for needs, some in groups.items()]
            return self.let(x, "gated", "(" + " or ".join(tests) + ")")
        plain, ahead = [p for p in patterns if self.spark or "(?!" not in p], [p for p in patterns if not self.spark and "(?!" in p]
        return "(" + " or ".join([self.match(x, "|".join(f"(?:{p})" for p in plain)), *[self.match(x, p) for p in ahead]]) + ")"

    def gated(self, x: str, needs: Iterable[str] | None, pattern: str) -> str:
        """A match that is tried only where one of the literals it needs stands."""
        tried = self.match(x, pattern)
        return tried if needs is None or not self.spark else f"(({' or '.join(f'contains({x}, {self.text(n)})' for n in sorted(needs))}) and {tried})"

    def sub(self, x: str, pattern: str, by: str) -> str:
        return f"regexp_replace({x}, {self.text(pattern)}, {self.text(by)}" + (")" if self.spark else ", 'g')")

    def group(self, x: str, pattern: str, n: int = 1) -> str:
        """'' where nothing matches."""
        return f"regexp_extract({x}, {self.text(pattern)}, {n})"

    def groups(self, x: str, pattern: str, n: int = 0) -> str:
        return f"regexp_extract_all({x}, {self.text(pattern)}, {n})"

    def at(self, x: str, pattern: str) -> str:
        """The place of the first match from 1 on, 0 if there is none."""
        if self.spark:
            return f"regexp_instr({x}, {self.text(pattern)})"
        return f"(case when {self.match(x, pattern)} then length({self.group(x, '(?s)^(.*?)(?:' + pattern + ')')}) + 1 else 0 end)"

    def array(self, values: Iterable[str]) -> str:
        inner = ", ".join(values)
        return f"array({inner})" if self.spark else f"[{inner}]"

    def pick(self, values: Iterable[str], at: str) -> str:
        return (f"element_at({self.array(map(self.text, values))}, cast({at} as int))") if self.spark else f"list_extract({self.array(map(self.text, values))}, {at})"

    def filtered(self, x: str, var: str, test: str) -> str:
        return f"filter({x}, {var} -> {test})" if self.spark else f"list_filter({x}, lambda {var}: {test})"

    def let(self, x: str, name: str, body: str) -> str:
        """body with x, evaluated once, under a name."""
        return f"get(transform(array({x}), {name} -> {body}), 0)" if self.spark else f"list_extract(list_transform([{x}], lambda {name}: {body}), 1)"

    def first(self, x: str) -> str:
        """The first element, null if there is none."""
        return f"get({x}, 0)" if self.spark else f"list_extract({x}, 1)"

    def mapped(self, x: str, var: str, made: str) -> str:
        return f"transform({x}, {var} -> {made})" if self.spark else f"list_transform({x}, lambda {var}: {made})"

    def size(self, x: str) -> str:
        return f"size({x})" if self.spark else f"len({x})"

    def distinct(self, x: str) -> str:
        return f"array_distinct({x})" if self.spark else f"list_distinct({x})"

    def has(self, x: str, y: str) -> str:
        return f"array_contains({x}, {y})" if self.spark else f"list_contains({x}, {y})"

    def joined(self, x: str, by: str) -> str:
        return f"array_join({x}, {self.text(by)})" if self.spark else f"array_to_string({x}, {self.text(by)})"

    def split(self, x: str, by: str) -> str:
        """By a regular expression."""
        return f"split({x}, {self.text(by)})" if self.spark else f"string_split_regex({x}, {self.text(by)})"

    def time(self, value: str) -> str:
        return f"timestamp_ntz '{value}'" if self.spark else f"timestamp '{value}'"

    def days(self, n: str | int) -> str:
        return f"(interval '1' day * ({n}))"

    def string(self, x: str) -> str:
        return f"cast({x} as {'string' if self.spark else 'varchar'})"

    def seconds(self, then: str, now: str) -> str:
        """From one time to another."""
        return f"timestampdiff(second, {then}, {now})" if self.spark else f"date_diff('second', {then}, {now})"

    def number_of(self, digits: str, base: int) -> str:
        if self.spark:
            return f"cast(conv({digits}, {base}, 10) as bigint)"
        return f"cast(concat('0x', {digits}) as bigint)" if base == 16 else f"cast({digits} as bigint)"

    def pieces(self, x: str, pattern: str) -> str:
        """The place (from 1) and size of every match, from the texts between them."""
        hits = self.groups(x, pattern)
        if self.spark:
            rests = f"split({x}, {self.text(pattern)}, -1)"
            before = f"aggregate(slice({rests}, 1, i + 1), 0, (n, r) -> n + length(r)) + aggregate(slice({hits}, 1, i), 0, (n, r) -> n + length(r))"
            return f"transform({hits}, (h, i) -> named_struct('pos', 1 + {before}, 'wide', length(h)))"
        rests = f"string_split_regex({x}, {self.text(pattern)})"
        before = f"coalesce(list_sum(list_transform(list_slice({rests}, 1, i), lambda r: length(r))), 0) + coalesce(list_sum(list_transform(list_slice({hits}, 1, i - 1), lambda r: length(r))), 0)"
        return f"list_transform({hits}, lambda h, i: {{'pos': 1 + {before}, 'wide': length(h)}})"

    def code_point(self, number: str, base: int) -> str:
        """The character of a number written in base 10 or 16."""
        if self.spark:
            as_hex = number if base == 16 else f"hex(cast({number} as bigint))"
            return f"decode(unhex(lpad({as_hex}, 8, '0')), 'UTF-32')"
        return f"chr(cast({chr(39)}0x{chr(39)} || {number} as integer))" if base == 16 else f"chr(cast({number} as integer))"

    def folded(self, items: str, start: str, acc: str, var: str, made: str) -> str:
        if self.spark:
            return f"aggregate({items}, {start}, ({acc}, {var}) -> {made})"
        return f"list_reduce(list_prepend({start}, {items}), lambda {acc}, {var}: {made})"


SPARK, CHECK = Dialect(True), Dialect(False)
