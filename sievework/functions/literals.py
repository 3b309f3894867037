"""What a regular expression cannot match without: literals to look for before it is tried."""
from __future__ import annotations

try:  # the parser has no public name; without it no literals are known, and every pattern is tried on every text
    from re import _constants as kind
    from re import _parser as parser
except ImportError:
    kind = parser = None


def required(pattern: str) -> frozenset[str] | None:
    """Literals of which every match holds one; None where there are none of three characters or more."""
    if parser is None:
        return None
    best = _of(parser.parse(pattern))
    return best if best and all(len(x) >= 3 for x in best) else None


def _of(items) -> frozenset[str] | None:
    """The best set among those that the items of a sequence require: the one whose shortest literal is longest."""
    found: list[frozenset[str]] = []
    run = ""
    for op, arg in [*items, (None, None)]:
        if op is kind.LITERAL:
            run += chr(arg)
            continue
        if run:
            found.append(frozenset((run,)))
            run = ""
        inner = None
        if op is kind.SUBPATTERN:
            inner = _of(arg[3])
        elif op is kind.BRANCH:
            inner = _union([_of(x) for x in arg[1]])
        elif op in (kind.MAX_REPEAT, kind.MIN_REPEAT) and arg[0] > 0:
            inner = _of(arg[2])
        if inner:
            found.append(inner)
    return max(found, key=lambda s: (min(map(len, s)), -len(s)), default=None)


def _union(parts: list[frozenset[str] | None]) -> frozenset[str] | None:
    return None if any(p is None for p in parts) else frozenset().union(*parts)


def gate(patterns) -> list[str] | None:
    """Literals without which none of the patterns matches, none of them inside another; None where a pattern has none."""
    every = _union([required(p) for p in patterns])
    return None if every is None else sorted(x for x in every if not any(y != x and y in x for y in every))
