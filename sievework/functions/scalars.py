"""Scalar functions as SQL expressions over SQL expressions; ``d`` is the dialect.

``sievework.functions.column`` makes Spark columns of them.  Null text behaves as the empty text.
"""
from __future__ import annotations

import re
import sys
import unicodedata

from . import keywords, rules
from .dialect import Dialect
from .literals import required

SPACE_RE = "[\\s   ]+"
DASHES = "-–—"
#: White space of any kind at the ends of a text.
_WHITE = r"[\s\x0b\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}\x{feff}]+"
ENDS = f"^{_WHITE}|{_WHITE}$"
MARKS = "[\u0300-\u036f]+"


def _plain_letters() -> tuple[str, str]:
    """Every character whose canonical decomposition, without marks, is one other character; and that character."""
    pairs = []
    for code in range(0xC0, sys.maxunicode + 1):
        parts = unicodedata.normalize("NFD", chr(code))
        if parts != chr(code) and len(bare := re.sub(MARKS, "", parts)) == 1:
            pairs.append((chr(code), bare))
    return "".join(a for a, _ in pairs), "".join(b for _, b in pairs)


ACCENTED, PLAIN = _plain_letters()


def or_empty(x: str) -> str:
    return f"coalesce({x}, '')"


def strip_html(d: Dialect, x: str, numeric: bool = True) -> str:
    """Entities to characters, tags to spaces, white space to single spaces.  A number that is no code point stays as it is."""
    out = or_empty(x)
    if numeric:
        for pattern, base in (("&#[xX]([0-9a-fA-F]{1,6});", 16), ("&#([0-9]{1,7});", 10)):
            head = 3 if base == 16 else 2
            digits = f"substring(e, {head + 1}, length(e) - {head + 1})"
            number = d.number_of(digits, base)
            known = f"{number} <= 1114111 and not {number} between 55296 and 57343"
            out = d.folded(d.distinct(d.groups(out, pattern)), out, "a", "e", f"case when {known} then replace(a, e, {d.code_point(digits, base)}) else a end")
    for entity, by in (("&lt;", "<"), ("&gt;", ">"), ("&amp;", "&"), ("&nbsp;", " "), ("&quot;", '"'), ("&#39;", "'")):
        out = f"replace({out}, {d.text(entity)}, {d.text(by)})"
    return f"trim({d.sub(d.sub(out, '<[^>]*>', ' '), SPACE_RE, ' ')})"


def decode_entities(d: Dialect, x: str) -> str:
    out = or_empty(x)
    for entity, by in (("&lt;", "<"), ("&gt;", ">"), ("&amp;", "&"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " ")):
        out = f"replace({out}, {d.text(entity)}, {d.text(by)})"
    return out


def escape_html(d: Dialect, x: str) -> str:
    out = or_empty(x)
    for mark, by in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        out = f"replace({out}, {d.text(mark)}, {d.text(by)})"
    return out


def normalised(d: Dialect, x: str) -> str:
    """Lower case, the dotted forms of US as "us", single spaces."""
    out = f"replace(replace(lower({or_empty(x)}), 'u.s.a.', 'us'), 'u.s.', 'us')"
    return d.sub(d.sub(out, r"u\.s\b", "us"), r"\s+", " ")


def disqualified(d: Dialect, x: str) -> str:
    return d.any_match(normalised(d, x), rules.DISQUALIFIERS)


def disqualifier(d: Dialect, norm: str) -> str:
    """The number (from 1) of the first rule that holds on normalised text, else 0."""
    return d.let(norm, "norm", "case " + " ".join(f"when {d.gated('norm', required(p), p)} then {i}" for i, p in enumerate(rules.DISQUALIFIERS, 1)) + " else 0 end")


def window(x: str, at: str, length: str, before: int, after: int) -> str:
    """What stands around a match, from ``before`` characters ahead of it to ``after`` behind it."""
    start = f"greatest(1, {at} - {before})"
    return f"substring({x}, cast({start} as int), cast({at} + {length} + {after} - {start} as int))"


def contract(d: Dialect, text: str, title: str) -> str:
    """Contract, temporary or part-time work."""
    t = f"lower(concat({or_empty(title)}, ' ', {or_empty(text)}))"
    part, temp = rules.PART_TIME, rules.TEMPORARY
    around_part = window(t, d.at(t, part), f"length({d.group(t, part, 0)})", 25, 30)
    around_temp = window(t, d.at(t, temp), f"length({d.group(t, temp, 0)})", 60, 60)
    return (
        f"case when {d.match(or_empty(title), rules.CONTRACT_TITLE)} then true "
        f"when {d.match(t, part)} and not {d.match(around_part, rules.PART_TIME_EXCUSES)} then true "
        f"when {d.any_match(t, rules.CONTRACT_STATED)} then true "
        f"when {d.any_match(t, rules.CONTRACT_EXCEPTIONS)} then false "
        f"when {d.match(t, temp)} then not {d.match(around_temp, rules.TEMPORARY_EXCUSES)} "
        f"else {d.match(t, rules.CONTRACT_ROLE)} end")


def padded_title(d: Dialect, x: str) -> str:
    return f"concat(' ', trim({d.sub(d.sub(f'lower({or_empty(x)})', '[/(),.–—|:;&+-]', ' '), SPACE_RE, ' ')}), ' ')"


def category(d: Dialect, title: str) -> str:
    chain = " ".join(f"when {d.match('padded', p)} then {d.text(c)}" for p, c in rules.CATEGORY_RULES)
    return d.let(padded_title(d, title), "padded", f"case when {or_empty(title)} = '' then 'Other' {chain} else 'Other' end")


def licence(d: Dialect, title: str) -> str:
    """Whether a title needs a licence; a commercial role about a licensed trade does not."""
    raw = or_empty(title)
    cut = d.at(raw, f"[{DASHES[1:]}(,|:/-]")
    head = padded_title(d, f"case when {cut} = 0 then {raw} else substring({raw}, 1, cast({cut} - 1 as int)) end")
    rest = padded_title(d, f"case when {cut} = 0 then '' else substring({raw}, cast({cut} + 1 as int)) end")
    return (
        f"case when {raw} = '' then false when {d.match(f'trim({head})', rules.UNLICENSED_ROLE)} then false "
        f"when trim({rest}) <> '' and {d.match(head, rules.COMMERCIAL)} and not {d.any_match(head, rules.LICENSED)} then false "
        f"else {d.any_match(padded_title(d, title), rules.LICENSED)} end")


def experience_level(d: Dialect, title: str) -> str:
    t = f"lower({or_empty(title)})"
    return "case " + " ".join(f"when {d.match(t, p)} then '{v}'" for p, v in rules.LEVELS) + " else 'Mid' end"


def work_type(d: Dialect, location: str, text: str) -> str:
    hybrid = f"{d.match(f'lower({or_empty(location)})', r'\bhybrid\b')} or {d.match(f'substring(lower({or_empty(text)}), 1, 600)', r'\bhybrid\b')}"
    return f"case when {hybrid} then 'Hybrid' when lower({or_empty(location)}) like '%remote%' then 'Remote US' else 'Onsite' end"


def _words_in(d: Dialect, x: str, terms) -> str:
    """The terms that x has as whole words, in the order given.  A term with punctuation may stand anywhere; of any other
    only its first place counts."""
    inner = f"length(regexp_replace(t, '[a-z0-9 ]+', ''" + (")" if d.spark else ", 'g')") + ") > 0"
    near = lambda place: d.match(f"substring({x}, {place}, 1)", "[a-z0-9]")
    at = f"instr({x}, t)"
    whole = f"not ({at} > 1 and {near(f'{at} - 1')}) and not {near(f'{at} + length(t)')}"
    listed = d.array(map(d.text, terms))
    if not d.spark:
        return d.filtered(listed, "t", f"{at} > 0 and ({inner} or ({whole}))")
    # one pass over the text finds the few terms that stand in it; only those are looked at
    hits = ", ".join(f"regexp_extract_all({x}, {d.text(f'(?=({p}))')}, 1)" for p in keywords.layers(tuple(terms)))
    return f"filter(array_distinct(concat({hits})), t -> {inner} or ({whole}))"


def _loosely(d: Dialect, x: str, terms) -> str:
    """One pass rules most texts out before the terms are tried."""
    if d.spark:
        return "(" + " or ".join(d.match(x, p) for p in keywords.layers(tuple(terms))) + ")"
    return d.match(x, "|".join(re.escape(t).replace("\\ ", " ").replace("\\-", "-") for t in terms))


def has_any_word(d: Dialect, x: str, terms) -> str:
    return f"({_loosely(d, x, terms)} and {d.size(_words_in(d, x, terms))} > 0)"


def first_word(d: Dialect, x: str, terms) -> str:
    """The first term in list order that x has as a whole word; null without one."""
    words = _words_in(d, x, terms)
    if d.spark:
        listed = d.array(map(d.text, terms))
        words = f"array_sort({words}, (a, b) -> int(array_position({listed}, a) - array_position({listed}, b)))"
    return f"case when {_loosely(d, x, terms)} then {d.first(words)} end"


def state_of(d: Dialect, location: str) -> str:
    names = " ".join(f"when {d.match('place', rf'\b{name.lower()}\b')} then '{name}'" for name, _ in rules.STATES)
    codes = " ".join(f"when {d.match('place', rf'(^|,\s*|\s){code}(\s*,|\s*$)')} then '{name}'" for name, code in sorted(rules.STATES, key=lambda s: (s[1] == 'dc', s[0])))
    return d.let(f"lower({or_empty(location)})", "place", f"case {names} {codes} end")


def unaccented(d: Dialect, x: str) -> str:
    """Letters without their marks, whether these are part of the letter or follow it.  Characters that come apart into
    several (Hangul syllables) stay whole."""
    return d.sub(f"translate({x}, {d.text(ACCENTED)}, {d.text(PLAIN)})", MARKS, "")


def stripped(d: Dialect, x: str) -> str:
    """x without white space of any kind at its ends."""
    return d.sub(or_empty(x), ENDS, "")


def location_kind(d: Dialect, location: str, us_places=rules.US_PLACES, foreign_places=rules.FOREIGN_PLACES) -> str:
    """us, weak-us, foreign, ambiguous or unknown, by the first sign that holds."""
    low = "low"
    bare_us = d.match(low, r"(^|[^a-z])u\.?s\.?a?([^a-z]|$)")
    zone = f"{d.match(low, r'\b(?:est|edt|cst|cdt|mst|mdt|pst|pdt|eastern|central|mountain|pacific)\s*(?:time|timezone|tz)?\b')} and {d.match(low, r'\b(?:remote|home|anywhere|wfh)\b')}"
    east = "latin\\s+america|middle\\s+east|"
    regions = "eu|uk|apac|emea|latam|anz|europe|asia|africa|india|brazil|canada|mexico|ireland|germany|france|spain|italy|poland|ukraine|australia|singapore|japan|china|philippines|united\\s+kingdom"
    separate = ", ".join(d.text(x) for x in rules.SHARED_CITY_NAMES)
    codes = "|".join(code for _, code in rules.STATES)
    vague = r"^(?:\s|remote|hybrid|on-?site|in-?office|flexible|anywhere|various|multiple|locations?|office|offices|home|based|work|from|field|travel|tbd|n/?a|other|and|or|the|any|all|several|different|[0-9]+|[" + "–—,;:.()/|+&-])+$"
    city = first_word(d, low, foreign_places)
    names = "|".join(rf"\b{name.lower()}\b" for name, _ in rules.STATES) + rf"|(?:^|,\s*|\s)(?:{codes})(?:\s*,|\s*$)"
    kind = (
        f"case when {or_empty(location)} = '' then 'unknown' "
        f"when {d.match(low, r'\b[kw][a-z]{2,3}[-\s]?(?:tv|am|fm|dt)\b')} or {has_any_word(d, low, rules.US_TERMS)} or {bare_us} then 'us' "
        f"when {has_any_word(d, low, rules.FOREIGN_COUNTRIES)} then 'foreign' "
        f"when {has_any_word(d, low, us_places)} or ({zone}) then 'us' "
        f"when coalesce(city, '') <> '' and not (city in ({separate})) then 'foreign' "
        f"when {d.match(f'lower({or_empty(location)})', names)} then 'weak-us' "
        f"when {d.match(low, rf',\s*(?:{codes})([\s,;|]|$)')} then 'weak-us' "
        f"when not {d.match(low, r'\bparish\b')} and ({d.match(low, rf'\bremote\b[\s{DASHES[1:]},()/|-]*\b(?:{east}{regions})\b')} or {d.match(low, rf'\b(?:{regions})\b[\s,/|()-]*remote\b')} or city is not null) then 'foreign' "
        f"when {d.match(low, r'(^|[^0-9])[0-9]{5}(-[0-9]{4})?([^0-9]|$)')} and {d.match(low, '[a-z]')} then 'us' "
        f"when {d.match(low, vague)} then 'ambiguous' else 'unknown' end")
    return d.let(unaccented(d, f"lower({or_empty(location)})"), "low", d.let(city, "city", kind))


def _number(x: str) -> str:
    return f"cast(nullif(replace({x}, ',', ''), '') as bigint)"


def salary(d: Dialect, text: str, which: int) -> str:
    """The low (1) or high (2) end of the first pay range that passes its checks."""
    x = or_empty(text)
    parts = []
    for i, shape in enumerate(rules.PAY_SHAPES):
        around = window(x, d.at(x, shape), f"length({d.group(x, shape, 0)})", 80, 80)
        times = 1000 if i == 2 else 1
        low, high = (f"({_number(d.group(x, shape, g))} * {times})" for g in (1, 2))
        ok = f"{d.match(x, shape)} and not ({d.match(around, rules.MONEY_WORDS)} and not {d.match(around, rules.PAY_WORDS)}) and {low} >= 20000 and {high} <= 1000000 and {low} <= {high}"
        parts.append(f"when {ok} then {(low, high)[which - 1]}")
    return f"case {' '.join(parts)} end"


def years(d: Dialect, text: str, which: int) -> str:
    """The least (1) or most (2) years asked for; the most is null unless a range is given."""
    x = or_empty(text)
    parts = []
    for shape, ranged in rules.YEAR_SHAPES:
        around = window(x, d.at(x, shape), f"length({d.group(x, shape, 0)})", 60, 60)
        low = f"cast(nullif({d.group(x, shape, 1)}, '') as int)"
        high = f"cast(nullif({d.group(x, shape, 2)}, '') as int)" if ranged else low
        ok = f"{d.match(x, shape)} and not ({d.match(around, rules.AGE_WORDS)} and not {d.match(around, rules.YEAR_WORDS)}) and {low} <= 15 and {high} <= 15"
        parts.append(f"when {ok} then {low if which == 1 else high if ranged else 'cast(null as int)'}")
    return f"case {' '.join(parts)} end"


def employment_type(d: Dialect, text: str) -> str:
    return f"case when {d.match(f'lower({or_empty(text)})', r'\bfull[\s-]?time\b')} then 'Full-time' end"


def snippet(d: Dialect, x: str, at: str, length: str, pad: int = 55) -> str:
    """The text around a match in single spaces, with an ellipsis where it is clipped."""
    inner = f"trim({d.sub(window(x, at, length, pad, pad), r'\s+', ' ')})"
    return f"concat(case when {at} - {pad} > 1 then '…' else '' end, {inner}, case when {at} + {length} + {pad} - 1 < length({x}) then '…' else '' end)"


def _free_mentions(d: Dialect, low: str, pattern: str, label: str) -> str:
    """The places (from 1) of the mentions of a flag that stand in no equal-opportunity sentence and no ordinary phrase."""
    inner = d.mapped(d.pieces(low, pattern), "m", "m")
    before = f"substring({low}, cast(greatest(1, m.pos - 400) as int), cast(m.pos - greatest(1, m.pos - 400) as int))"
    after = f"substring({low}, cast(m.pos + m.wide as int), 400)"
    sentence = f"concat({d.sub(before, '(?s)^.*[.;•' + chr(10) + ']', '')}, substring({low}, cast(m.pos as int), cast(m.wide as int)), {d.sub(after, '(?s)[.;•' + chr(10) + '].*$', '')})"
    has = lambda where, phrases: "(" + " or ".join(f"contains({where}, {d.text(p)})" for p in phrases) + ")"
    around = f"substring({low}, cast(greatest(1, m.pos - 60) as int), cast(m.pos + m.wide + 60 - greatest(1, m.pos - 60) as int))"
    tests = [f"not {has('s', rules.EEO_PHRASES)}"]
    if label in rules.BENIGN_PHRASES:
        tests.append(f"not {has(around, rules.BENIGN_PHRASES[label])}")
    return d.filtered(inner, "m", d.let(sentence, "s", " and ".join(tests)))


def red_flags(d: Dialect, text: str) -> str:
    """The labels of the first three audit flags, in rule order; those that boilerplate raises as well need one mention
    outside of it."""
    low = f"lower({or_empty(text)})"
    tests = []
    for label, p in rules.RED_FLAGS:
        hit = d.match(low, p)
        if label in rules.EEO_PRONE or label in rules.BENIGN_PHRASES:
            hit += f" and {d.size(_free_mentions(d, low, p, label))} > 0"
        tests.append(f"case when {hit} then {d.text(label)} end")
    found = d.filtered(d.array(tests), "f", "f is not null")
    return f"slice({found}, 1, 3)" if d.spark else f"list_slice({found}, 1, 3)"


def resume_signs(d: Dialect, text: str) -> str:
    """How many of e-mail, phone, section word and date range a text has."""
    x = or_empty(text)
    return "(" + " + ".join(f"case when {d.match(x, p)} then 1 else 0 end" for p in rules.RESUME_SIGNS) + ")"


def extraction_status(d: Dialect, text: str, least: int = 200) -> str:
    x = stripped(d, text)
    return f"case when length({x}) = 0 then 'empty' when length({x}) < {least} then 'short' when {resume_signs(d, text)} < 2 then 'not_resume' else 'ok' end"


def words_of(query: str) -> tuple[list[str], list[str]]:
    """A search query's words (six at most) and those that tell roles apart."""
    words = query.split()[:6]
    return words, [w for w in words if w.lower() not in rules.GENERIC_WORDS] or words


def _whole(d: Dialect, title: str, word: str) -> str:
    return d.match(f"lower({title})", rf"(^|[^a-z]){re.escape(word.lower()).replace(chr(92) + ' ', ' ')}([^a-z]|$)")


def tier(d: Dialect, title: str, query: str) -> str:
    """4 the phrase alone, 3 the phrase, 2 all its words, 1 all as parts of words, else 0."""
    _, core = words_of(query)
    low = f"lower({title})"
    return (
        f"case when trim({low}) = {d.text(query.lower())} then 4 when {_whole(d, title, query)} then 3 "
        f"when {' and '.join(_whole(d, title, w) for w in core)} then 2 when {' and '.join(f'contains({low}, {d.text(w.lower())})' for w in core)} then 1 else 0 end")


def score(d: Dialect, title: str, query: str) -> str:
    words, _ = words_of(query)
    low, q = f"lower({title})", d.text(query.lower())
    parts = [(f"{low} = {q}", 400), (" and ".join(_whole(d, title, w) for w in words), 250), (" and ".join(f"contains({low}, {d.text(w.lower())})" for w in words), 200), (f"contains({low}, {q})", 100), (f"starts_with({low}, {q})" if not d.spark else f"startswith({low}, {q})", 60)]
    parts += [(f"contains({low}, {d.text(w.lower())})", 10) for w in words]
    return "(" + " + ".join(f"case when {test} then {n} else 0 end" for test, n in parts) + ")"


def found_by(d: Dialect, query: str, *columns: str) -> str:
    """Any word of the query in any of the columns."""
    return "(" + " or ".join(f"contains(lower({or_empty(c)}), {d.text(w.lower())})" for w in words_of(query)[0] for c in columns) + ")"


def salary_label(d: Dialect, low: str, high: str) -> str:
    k = lambda x: f"concat('$', cast(cast(floor({x} / 1000.0 + 0.5) as bigint) as string), 'K')" if d.spark else f"concat('$', cast(cast(floor({x} / 1000.0 + 0.5) as bigint) as varchar), 'K')"
    return f"case when coalesce({low}, 0) <> 0 and coalesce({high}, 0) <> 0 then concat({k(low)}, '–', {k(high)}) end"


def years_label(d: Dialect, low: str, high: str) -> str:
    return f"case when {low} is null then null when coalesce({high}, 0) <> 0 then concat({d.string(low)}, '–', {d.string(high)}, ' yrs exp') else concat({d.string(low)}, '+ yrs exp') end"


def age_label(d: Dialect, then: str, now: str) -> str:
    """By whole days that have passed, not by dates."""
    days = f"cast(floor({d.seconds(then, now)} / 86400.0) as bigint)"
    parts = lambda n: d.string(f"cast(floor({days} / {n}.0) as bigint)")
    return (
        f"case when {then} is null then '' when {days} <= 0 then 'Today' when {days} = 1 then 'Yesterday' when {days} < 7 then concat({d.string(days)}, 'd ago') "
        f"when {days} < 30 then concat({parts(7)}, 'w ago') else concat({parts(30)}, 'mo ago') end")


def age_bucket(d: Dialect, then: str, now: str) -> str:
    """By the exact time that has passed."""
    days = f"({d.seconds(then, now)} / 86400.0)"
    return f"case when {then} is null then 'no date' when {days} <= 7 then '0-7d' when {days} <= 30 then '8-30d' when {days} <= 90 then '31-90d' when {days} <= 365 then '91-365d' else 'over 1y' end"


def short_location(d: Dialect, x: str) -> str:
    """The first of several places and how many more there are; commas are followed by a space."""
    spaced = d.sub(or_empty(x), r",(\S)", ", $1" if d.spark else r", \1")
    parts = d.filtered(d.mapped(d.split("spaced", ";"), "p", "trim(p)"), "p", "p <> ''")
    label = f"case when {d.size('parts')} <= 1 then spaced else concat({d.first('parts')}, ' +', {d.string(f'{d.size('parts')} - 1')}, ' more') end"
    return f"case when {or_empty(x)} = '' then 'United States' else {d.let(spaced, 'spaced', d.let(parts, 'parts', label))} end"


def title_stem(d: Dialect, x: str) -> str:
    out = d.sub(f"lower({or_empty(x)})", r"\(.*?\)", " ")
    out = d.sub(out, r"[#-]\s*[0-9]+.*$", " ")
    out = d.sub(out, rules.STEM_WORDS, " ")
    return f"trim({d.sub(d.sub(out, '[^a-z& ]', ' '), r'\s+', ' ')})"


def sponsor_phrase(d: Dialect, x: str) -> str:
    """The normalised text around the first sponsor word: from 50 characters before it to 35 after its start."""
    norm = normalised(d, x)
    around = "case when p = 0 then substring(n, 1, 34) else substring(n, cast(greatest(1, p - 50) as int), cast(p + 35 - greatest(1, p - 50) as int)) end"
    return d.let(norm, "n", d.let("instr(n, 'sponsor')", "p", f"trim({around})"))


def phrase_signature(d: Dialect, x: str) -> str:
    return f"substring(trim({d.sub(d.sub(sponsor_phrase(d, x), '[^a-z ]', ''), r'\s+', ' ')}), 1, 55)"


def refuses_sponsor(d: Dialect, x: str) -> str:
    return d.any_match(f"lower({or_empty(x)})", rules.NEGATIVE_SPONSOR)


def cache_key(d: Dialect, a: str, b: str) -> str:
    return f"sha2(concat({or_empty(a)}, decode(unhex('00'), 'UTF-8'), {or_empty(b)}), 256)" if d.spark else f"sha256(concat({or_empty(a)}, chr(0), {or_empty(b)}))"


def keep_skill(d: Dialect, x: str) -> str:
    """False for credentials; products and plain skills stay."""
    s = stripped(d, x)
    bare = f"upper({d.sub(s, r'[-\s]', '')})"
    safe = ", ".join(d.text(c) for c in rules.SAFE_CODES)
    return (
        f"case when {s} = '' then false when {d.match(s, rules.CREDENTIAL_WORDS)} then false "
        f"when {d.match(s, rules.CREDENTIAL_CODE)} then false when {d.match(bare, f'^(?:{rules.EXAMS})$')} then false when {bare} in ({safe}) then true "
        f"when not {d.match(s, r'\s')} and {d.match(s, rules.CODE_SHAPED)} and {s} = upper({s}) then false else true end")


def content_words(d: Dialect, x: str) -> str:
    stop = d.array(d.text(w) for w in rules.STOPWORDS)
    return d.filtered(d.split(f"lower({or_empty(x)})", "[^a-z0-9+#]+"), "w", f"length(w) > 2 and not {d.has(stop, 'w')}")
