"""Line-first quality rules in SQL expressions only.

Every line is judged by punctuation, navigation and boilerplate rules; failing lines go, and a document that
loses too much of its text goes as well.  A repetition and length base comes before the line rules.

Null text counts as empty: no words, every count 0, base_failed true, kept false.  Repeated rows each get their
own equal verdict.  Other columns are left alone; names that clash with the results must be renamed by the caller
of ``verdicts`` (``clean`` keeps the input's columns and needs no renaming).
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WHITE

MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
#: A document must keep this percentage of the code points of its non-blank lines.
MIN_KEPT_PERCENT = 50
#: A line of fewer words needs a closing mark.
FRAGMENT_WORDS = 10

#: Three runs of decoration, each closing a word, within three words: "word### word!! word$$$ ".
DECORATED = r"(?:[*#$%&|<>!]{2,}[.,]?\s\S{0,60}){2}[*#$%&|<>!]{2,}"
#: Three separators of menu entries close together.
MENU = r"(?:[|»›•·]|\s[>/]\s)(?:[^|»›•·]{0,40}(?:[|»›•·]|\s[>/]\s)){2}"
#: A closed line ends in one of these.
CLOSING = ".!?…:;\"”’»)]"
SENTENCE = r"(?:\S{1,200}\s+){9}\S"
#: Lower-case phrases, looked for as they stand.
BOILERPLATE = (
    "enable javascript", "use of cookies", "cookie policy", "privacy policy", "terms of use", "terms of service", "all rights reserved",
    "subscribe to our", "newsletter", "click here", "read more", "follow us", "powered by", "lorem ipsum",
)


def _any(text: Column, parts: tuple[str, ...]) -> Column:
    hit = F.lit(False)
    for part in parts:
        hit = hit | text.contains(part)
    return hit


#: A text without any of these has no menu line.
SEPARATOR = r"[|»›•·]|\s[>/]\s"


def line_fails(line: Column, decorated: Column, menu: Column, boilerplate: Column) -> Column:
    """True for a lower-case line that a rule removes; the three flags say whether the whole text can have such lines."""
    last = F.right(F.rtrim(line), F.lit(1))
    closed = (last != "") & (F.instr(F.lit(CLOSING), last) > 0)
    return (
        (decorated & line.rlike(DECORATED)) | (menu & line.rlike(MENU)) | (boilerplate & _any(line, BOILERPLATE)) | (~closed & ~line.rlike(SENTENCE))
    )


def _spaced(text: Column) -> Column:
    for mark in WHITE[1:]:
        text = F.replace(text, F.lit(mark), F.lit(" "))
    return text


#: Words in 3-word windows that occur twice or more.  Windows of different hash all differ, so most texts end there.
#: Otherwise a window is one long: 40 bits of its hash, then 24 bits of its place, so that one primitive sort brings
#: equal windows together.  Equal hashes are compared word by word; a hash that two different windows share, or a text
#: beyond 2^24 words, sends that row to the exact sort of strings.
_HASHES = "transform(sequence(0, size(_sw_ids) - 3), i -> xxhash64(_sw_ids[i], _sw_ids[i + 1], _sw_ids[i + 2]))"
_PACKED = "sort_array(transform(_sw_hashes, (h, i) -> shiftleft(h, 24) | i))"
_TWINS = "filter(sequence(1, size(_sw_keys) - 1), j -> shiftright(_sw_keys[j], 24) = shiftright(_sw_keys[j - 1], 24))"
_PLACE = "cast(_sw_keys[{j}] & 16777215 as int)"
_SAME = " and ".join(f"_sw_words[{_PLACE.format(j='j')} + {k}] = _sw_words[{_PLACE.format(j='j - 1')} + {k}]" for k in range(3))
_COVER = "size(array_distinct(flatten(transform(_sw_twins, j -> array(" + ", ".join(f"{_PLACE.format(j=j)} + {k}" for j in ("j", "j - 1") for k in range(3)) + ")))))"
_STRINGS = "array_sort(transform(sequence(0, size(_sw_words) - 3), i -> struct(concat_ws(' ', slice(_sw_words, i + 1, 3)) as g, i as i)))"
_EXACT = (
    "size(array_distinct(flatten(flatten(transform(array({strings}), s -> transform(filter(sequence(1, size(s) - 1), j -> s[j].g = s[j - 1].g), "
    "j -> array(s[j].i, s[j].i + 1, s[j].i + 2, s[j - 1].i, s[j - 1].i + 1, s[j - 1].i + 2)))))))"
).format(strings=_STRINGS)


def measured(df: DataFrame, text: str = "text", whole_path: bool = False) -> DataFrame:
    """df with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, line_chars, kept_chars, kept_text and kept.

    ``whole_path`` sends every row to the exact sort of strings; the results are the same.
    """
    total = lambda lines: F.aggregate(lines, F.lit(0).cast("long"), lambda a, x: a + F.length(x))
    out = df.withColumn("_sw_t", F.coalesce(F.col(text), F.lit("")))
    out = out.withColumns({"_sw_low": F.lower("_sw_t"), "_sw_spaced": _spaced(F.col("_sw_t"))})
    out = out.withColumns({
        "_sw_words": F.array_remove(F.split("_sw_spaced", " "), ""),
        "_sw_lines": F.split("_sw_t", "\n"),
        "_sw_low_lines": F.split("_sw_low", "\n"),
        "_sw_decorated": F.col("_sw_low").rlike(r"[*#$%&|<>!]{2}"),
        "_sw_menu": F.col("_sw_low").rlike(SEPARATOR),
        "_sw_boiler": _any(F.col("_sw_low"), BOILERPLATE),
    })
    none = "cast(array() as array<{}>)"
    out = out.withColumn("_sw_ids", F.transform("_sw_words", lambda w: F.xxhash64(w)))
    out = out.withColumn("_sw_hashes", F.expr(f"case when size(_sw_ids) >= 4 then {_HASHES} else {none.format('bigint')} end"))
    repeats = "size(_sw_words) < 16777216 and size(array_distinct(_sw_hashes)) < size(_sw_hashes)" if not whole_path else "false"
    out = out.withColumn("_sw_keys", F.expr(f"case when {repeats} then {_PACKED} else {none.format('bigint')} end"))
    out = out.withColumn("_sw_twins", F.expr(f"case when size(_sw_keys) >= 2 then {_TWINS} else {none.format('int')} end"))
    solid = lambda x: x.rlike(r"[^\x20\x09-\x0D]")
    out = out.withColumns({
        "_sw_solid": F.filter("_sw_lines", solid),
        "_sw_good": F.filter("_sw_lines", lambda x, i: solid(x) & ~line_fails(F.get("_sw_low_lines", i), F.col("_sw_decorated"), F.col("_sw_menu"), F.col("_sw_boiler"))),
    })
    beyond = "size(_sw_words) >= 16777216" if not whole_path else "size(_sw_words) >= 4"
    out = out.withColumns({
        "n_words": F.size("_sw_words").cast("long"),
        "word_chars": F.length(F.replace("_sw_spaced", F.lit(" "), F.lit(""))).cast("long"),
        "n_symbols": F.length(F.regexp_replace("_sw_t", r"[^#*$%&|<>]+", "")).cast("long"),
        "n_dup_lines": (F.size("_sw_solid") - F.size(F.array_distinct("_sw_solid"))).cast("long"),
        "n_repeat_words": F.expr(
            f"cast(case when {beyond} or exists(_sw_twins, j -> not ({_SAME})) then {_EXACT} when size(_sw_twins) = 0 then 0 else {_COVER} end as bigint)"),
        "line_chars": total(F.col("_sw_solid")),
        "kept_chars": total(F.col("_sw_good")),
        "kept_text": F.array_join("_sw_good", "\n"),
    })
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    return out.withColumn("base_failed", failed).withColumn(
        "kept", ~failed & (100 * F.col("kept_chars") >= MIN_KEPT_PERCENT * F.col("line_chars"))
    ).drop(*[c for c in out.columns if c.startswith("_sw_") and c not in df.columns])


def verdicts(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per input row: the key, the base measures and the verdict."""
    own = df.select(F.col(key), F.col(text).alias("_sw_text"))
    return measured(own, "_sw_text").select(
        key, "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "kept_chars", "line_chars")


def clean(df: DataFrame, text: str = "text", chars: str = "n_chars") -> DataFrame:
    """The kept documents with their failing lines removed, in the columns of df.

    A kept document always has text, so the cleaned text is never null.  Where df has the column named by ``chars``,
    it becomes the cleaned text's number of code points.
    """
    names = df.columns
    held = df.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("_sw_row"), F.col(f"`{text}`").alias("_sw_text"))
    # the generator keeps the optimizer from copying the measures' expressions into the filter, once for each use
    judged = measured(held, "_sw_text").select("_sw_row", F.explode(F.array(F.struct("kept", "kept_text"))).alias("_sw_v"))
    kept = judged.filter("_sw_v.kept")
    made = {text: F.col("_sw_v.kept_text"), chars: F.length("_sw_v.kept_text").cast("long")}
    return kept.select(*[made.get(c, F.col("_sw_row").getField(c)).alias(c) for c in names])
