"""Substring removal by sliding spans of consecutive sentences.

A sentence ends at a closing mark or at the end of a line.  Spans slide over the sentences of a text; so that a passage
of two or three long sentences holds whole spans as well, a sentence of more than PART words is read in parts, cut after
any word whose hash is the least (of equal ones the last) of some PART words in a row inside it.  A part has PART words
at most, and depends on its sentence or on the PART - 1 words around its ends alone.  A span is the shortest run of
parts from one on with SPAN_PARTS parts and SPAN_WORDS words: short sentences are one part each, so it is a run of
three sentences or more there; the shortest run that ends a text is a span too.  The first part that is sure in a passage begins within its first 15 words, a span ends
within 24 more, and parts are sure up to its last 8: every passage of 47 words holds a whole span wherever it stands.

Spans are hashed (88 bits of two independent sums over their lower-cased (A-Z) words) and joined over all documents.
A span is repeated where it occurred before: in a document of a smaller id, or earlier in the same document.  What
goes is whole sentences: those that repeated spans cover from end to end.  Two cases have no such sentence and lose
the covered parts themselves: sentences of more than LONGEST words, which no prose has, and a repeated run that covers
no sentence whole.

Null and empty texts have no spans and stay as they are; a text of fewer parts than a span is one span if it has
SPAN_WORDS words, and none otherwise.  Rows of equal id are one document to each other: neither removes from the
other.  Rows of null id keep all but their inner repeats and take nothing from others.  Ids may be of any type with an
order.  All columns of the input stay in place; one named like the count of removals is replaced by it.
"""
from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from .common import fresh, materialise

SPAN_PARTS = 3
SPAN_WORDS = 16
#: A sentence of more words is read in parts; among so many words in a row of it a part ends.
PART = 8
#: A sentence of more words goes by its parts.
LONGEST = 60
_BASES = (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93)
_WORD = re.compile(r"[^\x20\x09-\x0D]+")


class _Words(dict):
    """word: its hash, whose lowest bit says whether a sentence ends after it.  Forgets all beyond a bound."""

    def __missing__(self, word: bytes) -> int:
        ends = word.rstrip(b"\"')]")[-1:] in (b".", b"!", b"?")
        if len(self) > 100_000:
            self.clear()
        self[word] = h = (xxhash.xxh3_64_intdigest(word) & ~1) | ends
        return h


_words = _Words()
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _power(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd base and of its inverse modulo 2^64."""
    if base not in _powers or len(_powers[base][0]) < n:
        both = []
        for b in (base, pow(base, -1, 1 << 64)):
            steps = np.full(2 * n, b, np.uint64)
            steps[0] = 1
            both.append(np.multiply.accumulate(steps))
        _powers[base] = (both[0], both[1])
    up, down = _powers[base]
    return up[:n], down[:n]


def _least(h: np.ndarray) -> np.ndarray:
    """For each run of PART words: the place of the least hash in it, of equal ones the last."""
    low = np.uint64((1 << 24) - 1)
    at = np.arange(len(h), dtype=np.uint64)
    best = (h | low) - (at & low)
    for step in (1, 2, 4):  # PART is 8
        best = np.minimum(best[:-step], best[step:])
    first = at[: len(best)]
    return (first + ((low - (best & low) - first) & low)).astype(np.int64)


def parts(text: str | None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The hashes of the text's words, the first word and the end of each part, and the number of its sentence."""
    lines = [line.split() for line in (text or "").encode("utf-8", "surrogatepass").lower().split(b"\n")]
    flat = [w for line in lines for w in line]
    h = np.fromiter(map(_words.__getitem__, flat), np.uint64, len(flat))
    if not len(h):
        none = np.empty(0, np.int64)
        return h, none, none, none
    closes = (h & np.uint64(1)).astype(bool)
    closes[np.cumsum([len(x) for x in lines if x]) - 1] = True
    sentence = np.cumsum(closes) - closes
    ends = closes.copy()
    if len(h) > PART:
        long = np.bincount(sentence) > PART
        begin = sentence[: 1 - PART]
        inside = (begin == sentence[PART - 1 :]) & long[begin]
        if inside.any():
            ends[_least(h)[inside]] = True
    ends = np.flatnonzero(ends) + 1
    return h, np.concatenate(([0], ends[:-1])), ends, sentence[ends - 1]


def spans(h: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For each span of a text's parts: its hash, a second one, its first part and the part after its last."""
    if len(ends) < SPAN_PARTS:
        at, to = (np.zeros(1, np.int64), np.array([len(ends) - 1])) if len(h) >= SPAN_WORDS else (np.empty(0, np.int64),) * 2
    else:
        to = np.maximum(np.arange(len(starts)) + SPAN_PARTS - 1, np.searchsorted(ends, starts + SPAN_WORDS))
        at = np.flatnonzero(to < len(ends))
        to = to[at]
        if len(h) >= SPAN_WORDS and to[-1:] != len(ends) - 1:
            last = min(len(ends) - SPAN_PARTS, int(np.searchsorted(starts, len(h) - SPAN_WORDS, "right")) - 1)
            at, to = np.append(at, last), np.append(to, len(ends) - 1)
    first, end = starts[at], ends[to]
    codes = []
    for base in _BASES:
        up, down = _power(base, len(h) + 1)
        sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(h * down[: len(h)])))
        code = (sums[end] - sums[first]) * up[first] + (end - first).astype(np.uint64)
        code = (code ^ (code >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
        codes.append(code ^ (code >> np.uint64(29)))
    return codes[0].view(np.int64), (codes[1] >> np.uint64(40)).astype(np.int32), at, to + 1


def _occurrences(df: DataFrame, key: str, text: str) -> DataFrame:
    """span, proof, key: the different spans of each row, and one row of null span where some occur more than once."""
    own = df.select(F.col(f"`{key}`").alias("key"), F.col(f"`{text}`").alias("t")).dropna()
    kind = own.schema["key"].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            codes, proofs, owners, size = [], [], [], 0

            def listed() -> pa.RecordBatch:
                owner = np.concatenate(owners)
                null = owner < 0
                out = pa.record_batch(
                    [pa.array(np.concatenate(codes), pa.int64(), mask=null), pa.array(np.concatenate(proofs).astype(np.int32), mask=null), batch.column(0).take(pa.array(np.where(null, -1 - owner, owner)))],
                    names=["span", "proof", "key"])
                for x in (codes, proofs, owners):
                    x.clear()
                return out

            for i, t in enumerate(batch.column(1)):
                h, starts, ends, _ = parts(t.as_py())
                code, proof, _, _ = spans(h, starts, ends)
                known, once = np.unique(code, return_index=True)
                repeats = len(known) < len(code)
                codes.append(np.append(known, 0) if repeats else known)
                proofs.append(np.append(proof[once], 0) if repeats else proof[once])
                owners.append(np.append(np.full(len(known), i), -1 - i) if repeats else np.full(len(known), i))
                size += len(known)
                if size > 500_000:
                    yield listed()
                    size = 0
            if codes:
                yield listed()

    return own.mapInArrow(run, f"span long, proof int, key {kind.simpleString()}")


def repeated(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, spans: the spans of each document that occur in one of a smaller id, none where only its own repeat.

    The occurrences are made once.  Whether a span repeats comes from partial counts; only then do the occurrences meet the
    repeated spans, in a join that Spark can split at a hot span, and the few that are left meet the first id of theirs.
    """
    found = materialise(_occurrences(df, key, text))
    same = ["span", "proof"]
    times = found.filter("span is not null").groupBy(*same).agg(F.count("*").alias("times")).filter("times > 1").select(*same)
    again = materialise(found.join(times, same))
    first = again.groupBy(*same).agg(F.min("key").alias("first"))
    later = again.join(first, same).filter("key > first").select("key", "span")
    return later.unionByName(found.filter("span is null").select("key", "span")).groupBy("key").agg(F.collect_set("span").alias("spans"))


def removal(text: str | None, known: list[int] | None = None) -> tuple[np.ndarray, int]:
    """Which parts go, given the spans repeated from other documents; and how many sentences or lone parts that is."""
    h, starts, ends, sentence = parts(text)
    code, _, at, to = spans(h, starts, ends)
    again = np.ones(len(code), bool)
    again[np.unique(code, return_index=True)[1]] = False
    if known:
        again |= np.isin(code, known)
    depth = np.zeros(len(starts) + 1, np.int64)
    np.add.at(depth, at[again], 1)
    np.add.at(depth, to[again], -1)
    covered = np.cumsum(depth)[:-1] > 0
    if not covered.any():
        return covered, 0
    whole = np.bincount(sentence, ~covered) == 0
    whole &= np.bincount(sentence) > 0
    gone = whole[sentence]
    lone = covered & (np.bincount(sentence, ends - starts)[sentence] > LONGEST) & ~gone
    run = np.cumsum(np.concatenate(([True], covered[1:] != covered[:-1]))) - 1
    lone |= covered & (np.bincount(run, gone | lone)[run] == 0)
    return gone | lone, int(whole.sum() + lone.sum())


def without(text: str, gone: np.ndarray) -> str:
    """The text without those parts and the white space after each."""
    if not gone.any():
        return text
    _, starts, ends, _ = parts(text)
    begin = [m.start() for m in _WORD.finditer(text)] + [len(text)]
    return (text[: begin[0]] + "".join([text[begin[a] : begin[b]] for a, b, g in zip(starts.tolist(), ends.tolist(), gone.tolist(), strict=True) if not g])).rstrip()


def strip_repeats(df: DataFrame, key: str = "doc_id", text: str = "text", chars: str = "n_chars", removed: str = "n_removed") -> DataFrame:
    """df without repeated sentences, and ``removed``, the number of sentences (or lone parts) each row lost.  ``chars``,
    where df has it, is counted anew for the rows that lost text."""
    df = df.drop(removed)
    names = df.columns
    its_key, its_spans = fresh(df, "key"), fresh(df, "spans")
    marks = materialise(repeated(df, key, text)).select(F.col("key").alias(its_key), F.col("spans").alias(its_spans))
    joined = df.join(marks, F.col(f"`{key}`") == F.col(its_key), "left").drop(its_key)
    at_key, at_text, at_chars = names.index(key), names.index(text), names.index(chars) if chars in names else -1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns, lost = batch.columns[:-1], np.zeros(batch.num_rows, np.int64)
            new: dict[int, str] = {}
            marked = pa.compute.or_(batch.column(len(names)).is_valid(), batch.column(at_key).is_null())
            for i in np.flatnonzero(marked.to_numpy(zero_copy_only=False)).tolist():
                t = batch.column(at_text)[i].as_py()
                gone, lost[i] = removal(t, batch.column(len(names))[i].as_py())
                if lost[i]:
                    new[i] = without(t, gone)
            if new:
                changed = pa.array(lost > 0)
                columns[at_text] = pa.compute.replace_with_mask(columns[at_text], changed, pa.array(new.values(), columns[at_text].type))
                if at_chars >= 0:
                    columns[at_chars] = pa.compute.replace_with_mask(columns[at_chars], changed, pa.array([len(t) for t in new.values()], columns[at_chars].type))
            yield pa.record_batch([*columns, pa.array(lost)], names=[*names, removed])

    return joined.mapInArrow(run, StructType([*df.schema.fields, StructField(removed, LongType())]))
