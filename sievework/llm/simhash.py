"""Near-duplicate groups from 64-bit fingerprints, by pigeonring filtering.

A text's four-word shingles, repeats included, are hashed; a bit of the fingerprint is set where it is set in over half
of the hashes.  Documents of one fingerprint form a class, and the smallest id stands for it.

The 64 bits are cut into a ring of five segments.  Two fingerprints of at most 4 differing bits have, by the pigeonring
principle, a start on the ring from which every chain of consecutive segments stays within its proportional budget: the
first j segments together differ in at most floor(4 j / 5) bits.  So for some start the first segment is equal and the
second differs in one bit at most.  For each of the five starts, a class is *at home* under the value of its first two
segments (26 bits) and a *guest* under those values that have one more bit of the second segment set.  Candidates meet
where a guest or another resident finds a resident; the longer chains prune them; what is left gets the full check.

All rows of one meeting place are compared inside a task, which gives back a forest that joins its members, at most one
link a row, and never the pairs.  A place of more than CROWD residents or guests is cut into blocks that meet two by
two, each pair of blocks in a task of its own, so no task depends on the size of a group.

Null text and text without words: fingerprint zero, linked like any other.  Fewer than four words are one shingle.
Repeated rows of one id of equal text are one document, and of different texts they link their classes; each row gets
its own fingerprint.  Rows of null id link with nothing and have a null component.  Keys are whole numbers; others raise
a TypeError.  An empty table gives an empty result.  Only the key and the text are read.
"""
from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import long_key, materialise
from .components import components

WIDTH = 4
SEED = 42
BITS = 4
#: The ring: where each segment begins, and the end.
CUTS = (0, 13, 26, 39, 52, 64)
SEGMENTS = len(CUTS) - 1
#: Residents or guests of one place that a task takes whole.
CROWD = 8192
#: Fingerprints of more than one in HOT of all rows; there are fewer than HOT of them.
HOT = 4096
#: Pairs that are compared at once, and bytes of text that are cut into words at once.
PAIRS, PIECE = 1 << 21, 1 << 20
_SPACE = re.compile(rb"[\x20\x09-\x0d]")


def _pieces(data: bytes) -> Iterator[list[bytes]]:
    """The words of a text, some at a time, cut where there is white space."""
    at = 0
    while at < len(data):
        end = at + PIECE
        if end < len(data):
            found = _SPACE.search(data, end)
            end = found.start() if found else len(data)
        yield data[at:end].split()
        at = end


def _ones(hashes: list[int]) -> np.ndarray:
    """How many of the hashes have each bit; the highest bit first."""
    return np.unpackbits(np.array(hashes, ">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int64)


def fingerprint(text: str | None, width: int = WIDTH) -> int:
    """The fingerprint of a text, as a signed long."""
    data = (text or "").encode("utf-8", "surrogatepass").lower()
    total, ones, held, some = 0, np.zeros(64, np.int64), [], False
    for fresh in _pieces(data):
        words = held + fresh
        if len(words) >= width:
            grams = map(b" ".join, zip(*(words[i:] for i in range(width))))
            hashes = [xxhash.xxh64_intdigest(g, SEED) for g in grams]
            total, ones, some = total + len(hashes), ones + _ones(hashes), True
            held = words[len(words) - width + 1 :]
        else:
            held = words
    if not some:
        return int(np.uint64(xxhash.xxh64_intdigest(b" ".join(held), SEED)).astype(np.int64)) if held else 0
    return int(np.packbits(2 * ones > total).view(">i8")[0])


def fingerprints(df: DataFrame, key: str = "doc_id", text: str = "text", width: int = WIDTH) -> DataFrame:
    """key, print of every row."""

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.record_batch([batch.column(0), pa.array([fingerprint(t.as_py(), width) for t in batch.column(1)], pa.int64())], names=["key", "print"])

    return df.select(long_key(df, key).alias("key"), F.col(f"`{text}`").alias("text")).mapInArrow(hashed, "key long, print long")


def _home(start: int) -> tuple[str, int]:
    """SQL of the place where a class is at home for a start of the ring, and the bits of the second segment from there."""
    width = [CUTS[i + 1] - CUTS[i] for i in range(SEGMENTS)]
    second, at = width[(start + 1) % SEGMENTS], CUTS[start]
    turned = f"(shiftleft(print, {at}) | shiftrightunsigned(print, {64 - at}))" if at else "print"
    return f"(shiftleft({start}L, 40) | shiftrightunsigned({turned}, {64 - width[start] - second}))", second


def _homes(classes: DataFrame) -> DataFrame:
    """One row of each class for each start: home, second (bits)."""
    each = ", ".join(f"named_struct('home', {place}, 'second', {second})" for place, second in map(_home, range(SEGMENTS)))
    return classes.select("*", F.expr(f"inline(array({each}))"))


#: The places that have one more bit of the second segment set.
_VISITED = "transform(filter(sequence(0, second - 1), b -> (shiftright(home, b) & 1) = 0), b -> home | shiftleft(1L, b))"


def _crowded(classes: DataFrame, crowd: int) -> DataFrame:
    """place, residents, guests (in blocks) of the places that are too large for one task.

    The guests of a place come from the 13 homes that lack one of its bits, so the homes of fewer classes than a 14th of
    ``crowd`` bring less than one block together; only larger ones are added up.
    """
    large = _homes(classes).groupBy("home", "second").agg(F.count("*").alias("n")).filter(F.col("n") > crowd // 14)
    none = F.lit(0).cast("long")
    both = large.select(F.col("home").alias("place"), F.col("n").alias("residents"), none.alias("guests")).unionByName(
        large.select(F.expr(f"explode({_VISITED})").alias("place"), none.alias("residents"), F.col("n").alias("guests")))
    summed = both.groupBy("place").agg(F.sum("residents").alias("residents"), F.sum("guests").alias("guests")).filter(f"residents > {crowd} or guests > {crowd}")
    return summed.select("place", F.ceil((F.col("residents") + 1) / crowd).cast("int").alias("residents"), F.ceil((F.col("guests") + crowd) / crowd).cast("int").alias("guests"))


def _dealt(classes: DataFrame, crowded: DataFrame | None) -> DataFrame:
    """place, i, j (blocks), role (0: compared with what came before, 1: with rows of role 0), print, rep."""
    rows = _homes(classes).select("print", "rep", F.expr(f"posexplode(concat(array(home), {_VISITED}))").alias("role", "place"))
    rows = rows.withColumn("role", F.least("role", F.lit(1)))
    zero = F.lit(0)
    if crowded is None:
        return rows.select("place", zero.alias("i"), zero.alias("j"), "role", "print", "rep")
    rows = rows.join(crowded, "place", "left").withColumn("hash", F.pmod(F.xxhash64("print"), F.lit(1 << 30)).cast("int"))
    block = F.expr("if(role = 0, hash % residents, residents + hash % guests)")
    first = "transform(sequence(block, residents + guests - 1), x -> named_struct('i', block, 'j', x, 'role', 0))"
    second = "transform(if(least(block, residents) = 0, array(), sequence(0, least(block, residents) - 1)), x -> named_struct('i', x, 'j', block, 'role', 1))"
    alone = "array(named_struct('i', 0, 'j', 0, 'role', role))"
    cells = F.expr(f"inline(if(residents is null, {alone}, if(role = 0, concat({first}, {second}), {second})))")
    return rows.withColumn("block", block).select("place", "print", "rep", cells).select("place", "i", "j", "role", "print", "rep")


def _chains() -> np.ndarray:
    """The bits of the first j segments from each start."""
    ring = [sum(1 << (63 - b) for b in range(CUTS[i], CUTS[i + 1])) for i in range(SEGMENTS)]
    return np.array([[sum(ring[(start + k) % SEGMENTS] for k in range(j)) for j in range(SEGMENTS + 1)] for start in range(SEGMENTS)], np.uint64)


def _joined(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Lets the rows of each link, and all that they were joined with, have one label: the smallest row."""
    while len(a):
        la, lb = label[a], label[b]
        least = np.minimum(la, lb)
        np.minimum.at(label, la, least)
        np.minimum.at(label, lb, least)
        while not np.array_equal(up := label[label], label):
            label[:] = up
        apart = label[a] != label[b]
        a, b = a[apart], b[apart]


def links(place: np.ndarray, i: np.ndarray, j: np.ndarray, role: np.ndarray, prints: np.ndarray) -> np.ndarray:
    """The label of each row (the smallest row it is joined with) over the sorted rows of whole cells."""
    n, budget, chains = len(place), [BITS * k // SEGMENTS for k in range(SEGMENTS + 1)], _chains()
    begins = np.concatenate([[True], (place[1:] != place[:-1]) | (i[1:] != i[:-1]) | (j[1:] != j[:-1])])
    cell = np.cumsum(begins) - 1
    start = np.flatnonzero(begins)[cell]
    residents = np.bincount(cell, weights=role == 0).astype(np.int64)[cell]
    pairs = np.where(role == 1, residents, np.where(i == j, np.arange(n) - start, 0))
    ends, label, prints, ring = np.cumsum(pairs), np.arange(n), prints.view(np.uint64), place >> 40
    at = 0
    while at < n:
        base = ends[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(ends, base + PAIRS, "right")))
        many = pairs[at:to]
        left = np.repeat(np.arange(at, to), many)
        right = start[left] + np.arange(len(left)) - np.repeat(ends[at:to] - many - base, many)
        for k in range(3, SEGMENTS + 1):  # the first two segments met
            near = np.bitwise_count((prints[left] ^ prints[right]) & chains[ring[left], k]) <= budget[k]
            left, right = left[near], right[near]
        _joined(label, left, right)
        at = to
    return label


def _met(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted rows of cells in, forests of links out; a cell that goes on in the next batch waits for it."""
    held = None

    def joined(cols: list[np.ndarray]) -> pa.RecordBatch:
        label = links(*cols[:5])
        found = np.flatnonzero((label != np.arange(len(label))) & (cols[5] != cols[5][label]))
        return pa.record_batch([pa.array(cols[5][found]), pa.array(cols[5][label[found]])], names=["a", "b"])

    for batch in batches:
        cols = [c.to_numpy() for c in batch.columns]
        if held is not None:
            cols = [np.concatenate(x) for x in zip(held, cols, strict=True)]
        if not len(cols[0]):
            continue
        last = np.flatnonzero((cols[0] != cols[0][-1]) | (cols[1] != cols[1][-1]) | (cols[2] != cols[2][-1]))
        cut = last[-1] + 1 if len(last) else 0
        if cut:
            yield joined([c[:cut] for c in cols])
        held = [c[cut:] for c in cols]
    if held is not None and len(held[0]):
        yield joined(held)


def near_duplicates(df: DataFrame, key: str = "doc_id", text: str = "text", width: int = WIDTH, crowd: int = CROWD) -> DataFrame:
    """One row per input row: the key, fingerprint (16 hex digits) and component_id (the smallest key reachable)."""
    prints = materialise(fingerprints(df, key, text, width))
    total = prints.count()
    classes = materialise(prints.filter("key is not null").groupBy("print").agg(F.min("key").alias("rep"), F.count("*").alias("n")))
    crowded = materialise(_crowded(classes, crowd))
    places = crowded.count()
    rows = _dealt(classes, None if not places else F.broadcast(crowded) if places <= 100_000 else crowded)
    met = rows.repartition("place", "i", "j").sortWithinPartitions("place", "i", "j", "role", "print").mapInArrow(_met, "a long, b long")
    # an id of several texts links their classes
    several = prints.filter("key is not null").groupBy("key").agg(F.min("print").alias("x"), F.max("print").alias("y")).filter("x <> y").select("key")
    shared = prints.join(several, "key", "left_semi").join(classes, "print").select(F.col("key").alias("a"), F.col("rep").alias("b"))
    found = components(met.unionByName(shared))
    known = classes.join(found, F.col("rep") == F.col("node"), "left").select("print", "n", F.coalesce("component", "rep").alias("component"))
    known = materialise(known)
    # fingerprints of very many rows are fewer than HOT, so they can go to all tasks; no other one is large
    hot = F.col("n") > total // HOT
    with_hot = prints.join(F.broadcast(known.filter(hot)), "print", "left")
    rest = with_hot.filter("n is null").drop("n", "component").join(known.filter(~hot), "print", "left")
    out = with_hot.filter("n is not null").unionByName(rest)
    return out.select(F.col("key").alias(key), F.lower(F.lpad(F.hex("print"), 16, "0")).alias("fingerprint"), F.when(F.col("key").isNotNull(), F.col("component")).alias("component_id"))
