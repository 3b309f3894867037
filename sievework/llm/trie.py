"""A prefix trie of conversations, built as a Patricia trie over sorted paths.

A conversation is the path of its turns; a node of depth d stands for a sequence of first d turns.  Paths are chains of
digests, so that two paths share their first d turns exactly when their d-th digests are equal.  Equal paths become one
with a weight, the paths are sorted by ranges, and each task goes through its range once with a stack of open points:
where neighbours branch, where a path ends, and leaves.  The turns between two points are a compressed edge.  Members,
children, leaves and saved bytes are added up on points alone; when a point closes, the unary nodes of its edge are
written out from the edge's suffix sums.

What two ranges may share are the nodes of a range's first and last path.  They are written as parts and added up by
their digest, with the length that the last path of a range shares with the first of the next: two paths a range.  All
other nodes are complete where they are made.  The ids that end at a node are hashed in order from joined pieces, so a
sequence that very many conversations share is neither gathered nor sorted as rows by one task.

Turns go by number, null first; those of equal number go by role, then by the digest of role and text.  Null role or text
is empty.  Repeated rows are repeated turns.  Rows of null conv_id belong to no conversation and are left out.  A conversation's
digests (24 bytes a turn) are one row.  Ids are whole numbers; others raise a TypeError.  An empty table gives no
nodes, not even the root.  Only the four columns are read.
"""
from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import long_key, materialise

#: A rebuilt conversation takes up to HEADS - 1 turns from the conversation before it that GROUP divides.
GROUP, HEADS = 5, 9
#: Characters of joined ids, about, that are hashed as one piece.
PIECE = 1 << 16
#: Nodes that are written out together.
ROWS = 10_000
ROOT = bytes(16)
NONE = hashlib.sha256(b"").hexdigest()


def rebuilt(df: DataFrame, key: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """conv_id, turns (digest, n_bytes) of every conversation, its first turns replaced by those of its group's first one."""
    who, said = F.coalesce(F.col(f"`{role}`").cast("string"), F.lit("")), F.coalesce(F.col(f"`{text}`"), F.lit(""))
    digest = F.unhex(F.md5(F.concat(F.octet_length(who).cast("string"), F.lit(":"), who, said)))
    rows = df.select(long_key(df, key).alias("conv_id"), F.struct(F.col(f"`{turn}`").alias("turn"), who.alias("role"), digest.alias("digest"), F.octet_length(said).cast("long").alias("n_bytes")).alias("t"))
    own = rows.filter("conv_id is not null").groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("t"))
    own = materialise(own.select("conv_id", F.transform("t", lambda t: F.struct(t["digest"].alias("digest"), t["n_bytes"].alias("n_bytes"))).alias("t")))
    heads = own.filter(F.col("conv_id") % GROUP == 0).select(F.col("conv_id").alias("base"), F.slice("t", 1, HEADS - 1).alias("head"))
    own = own.withColumns({"base": F.col("conv_id") - F.col("conv_id") % GROUP, "h": (F.crc32(F.col("conv_id").cast("string").cast("binary")) % HEADS).cast("int")})
    both = own.join(heads, "base", "left")
    return both.select("conv_id", F.expr("concat(slice(coalesce(head, slice(t, 1, 0)), 1, h), slice(t, h + 1, greatest(size(t) - h, 0)))").alias("turns"))


def paths(conversations: DataFrame) -> DataFrame:
    """conv_id, path (digest of each prefix), sums (bytes of each prefix) and last (the whole path's digest)."""

    def chained(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            chains, sums = [], []
            for turns in batch.column(1).to_pylist():
                at, total, chain, bytes_ = ROOT, 0, [], []
                for t in turns:
                    at, total = hashlib.blake2b(at + t["digest"], digest_size=16).digest(), total + t["n_bytes"]
                    chain.append(at)
                    bytes_.append(total)
                chains.append(chain)
                sums.append(bytes_)
            yield pa.record_batch(
                [batch.column(0), pa.array(chains, pa.list_(pa.binary())), pa.array(sums, pa.list_(pa.int64())), pa.array([c[-1] if c else ROOT for c in chains], pa.binary())],
                names=["conv_id", "path", "sums", "last"])

    return conversations.mapInArrow(chained, "conv_id long, path array<binary>, sums array<long>, last binary")


def endings(members: DataFrame, piece: int = PIECE) -> DataFrame:
    """members: last, conv_id.  last, conv_id (the smallest), n and the hash of the ids in order, of each path."""

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, last, ids, size = [], None, [], 0
        for batch in batches:
            for at, i in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if ids and (at != last or size >= piece):
                    out.append((last, ids[0], len(ids), ",".join(map(str, ids))))
                    ids, size = [], 0
                last = at
                ids.append(i)
                size += 20
            if out:
                yield _batch(out, ("last", "conv_id", "n", "ids"), (pa.binary(), pa.int64(), pa.int64(), pa.string()))
                out = []
        if ids:
            yield _batch([(last, ids[0], len(ids), ",".join(map(str, ids)))], ("last", "conv_id", "n", "ids"), (pa.binary(), pa.int64(), pa.int64(), pa.string()))

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, kinds = ("last", "conv_id", "n", "ends"), (pa.binary(), pa.int64(), pa.int64(), pa.string())
        last, least, n, state = None, None, 0, None
        for batch in batches:
            out = []
            for at, first, some, ids in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if at != last:
                    if last is not None:
                        out.append((last, least, n, state.hexdigest()))
                    last, least, n, state = at, first, some, hashlib.sha256(ids.encode())
                else:
                    n += some
                    state.update(b"," + ids.encode())
            if out:
                yield _batch(out, names, kinds)
        if last is not None:
            yield _batch([(last, least, n, state.hexdigest())], names, kinds)

    ordered = members.select("last", "conv_id").repartitionByRange("last", "conv_id").sortWithinPartitions("last", "conv_id")
    joined = ordered.mapInArrow(pieces, "last binary, conv_id long, n long, ids string")
    return joined.repartition("last").sortWithinPartitions("last", "conv_id").mapInArrow(hashed, "last binary, conv_id long, n long, ends string")


def _batch(rows: list[tuple], names: tuple, kinds: tuple) -> pa.RecordBatch:
    return pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=list(names))


class _Point:
    """An open point: where it lies, and what its subtree has so far.

    ``kept`` is the bytes of all members' paths less those of the nodes of the subtree, counted from the root: less
    (n - 1) times the bytes above a node of its edge, that is what the node's subtree saves.
    """

    __slots__ = ("depth", "path", "sums", "n", "conv", "kept", "kids", "leaves", "ends", "shared", "tops")

    def __init__(self, depth: int, path: list, sums: list, shared: bool = False):
        self.depth, self.path, self.sums, self.shared = depth, path, sums, shared
        self.n, self.conv, self.kept, self.kids, self.leaves, self.ends, self.tops = 0, None, 0, 0, 0, None, []

    def upto(self, depth: int) -> int:
        return self.sums[depth - 1] if depth else 0

    def add(self, n: int, conv: int, kept: int) -> None:
        """Members of one more branch; all branches but the first have the point's own path once more."""
        self.kept += kept + (self.upto(self.depth) if self.n else 0)
        self.n += n
        self.conv = conv if self.conv is None else min(self.conv, conv)

    def take(self, child: _Point) -> None:
        self.add(child.n, child.conv, child.kept)
        self.kids += 1
        self.leaves += child.leaves


_OUT = (
    ("part", pa.int32()), ("id", pa.binary()), ("parent", pa.binary()), ("depth", pa.int64()), ("conv_id", pa.int64()), ("parent_conv_id", pa.int64()), ("n_convs", pa.int64()), ("n_children", pa.int64()),
    ("n_leaves", pa.int64()), ("saved", pa.int64()), ("above", pa.int64()), ("within", pa.int64()), ("of_first", pa.bool_()), ("of_last", pa.bool_()), ("ends", pa.string()))
_OUT_DDL = (
    "part int, id binary, parent binary, depth long, conv_id long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved long, above long, within long, of_first boolean, of_last boolean, ends string")


def _id(path: list, depth: int) -> bytes:
    return path[depth - 1] if depth else ROOT


def _patricia(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted paths in; complete nodes out (part null), and parts of the nodes of the first and the last path."""
    part = TaskContext.get().partitionId()
    stack: list[_Point] = []
    out: list[tuple] = []

    def close(point: _Point, top: int, last: bool = False) -> None:
        """Writes the nodes of the point's edge, those deeper than ``top``; the topmost of a complete edge waits for its parent."""
        if not point.kids:
            point.leaves = 1
        if point.shared or last:
            for depth in range(point.depth, top, -1):
                end = depth == point.depth
                out.append((
                    part, _id(point.path, depth), _id(point.path, depth - 1) if depth else None, depth, point.conv, None, point.n, point.kids if end else 1, point.leaves, point.kept, point.upto(max(depth - 1, 0)),
                    point.upto(depth), point.shared, last, point.ends if end else None))
            out.extend((None, None, _id(point.path, point.depth), *t) for t in point.tops)
        else:
            out.extend((None, None, None, t[0], t[1], point.conv, *t[3:]) for t in point.tops)
            for depth in range(point.depth, top, -1):
                end = depth == point.depth
                saved = point.kept - (point.n - 1) * point.upto(depth - 1)
                row = (depth, point.conv, point.conv, point.n, point.kids if end else 1, point.leaves, saved, None, None, None, None, (point.ends if end else None) or NONE)
                if depth > top + 1:
                    out.append((None, None, None, *row))
                else:
                    stack[-1].tops.append((*row[:2], None, *row[3:]))

    def flush() -> pa.RecordBatch:
        nonlocal out
        rows, out = out, []
        return _batch(rows, *zip(*_OUT, strict=True))

    path: list[bytes] = []
    for batch in batches:
        for chain, sums, n, conv, ends in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if not stack:
                stack.extend(_Point(d, chain, sums, True) for d in range(len(chain) + 1))
            else:
                same, most = 0, min(len(path), len(chain))
                while same < most and path[same] == chain[same]:
                    same += 1
                while stack[-1].depth > same:
                    point = stack.pop()
                    if stack[-1].depth < same:
                        stack.append(_Point(same, point.path, point.sums))
                    close(point, stack[-1].depth)
                    stack[-1].take(point)
                if len(chain) > same:
                    stack.append(_Point(len(chain), chain, sums))
            point = stack[-1]
            point.ends = ends
            point.add(n, conv, (n - 1) * point.upto(point.depth))
            path = chain
        if len(out) >= ROWS:
            yield flush()
    while stack:
        point = stack.pop()
        close(point, stack[-1].depth if stack else -1, True)
        if stack:
            stack[-1].take(point)
        if len(out) >= ROWS:
            yield flush()
    if out:
        yield flush()


def _merged(parts: DataFrame) -> DataFrame:
    """The nodes that ranges may share, from their parts."""
    spark = parts.sparkSession
    numbers = sorted(r.part for r in parts.select("part").distinct().collect())  # one for each task
    follows = spark.createDataFrame(list(zip(numbers, numbers[1:])), "before int, part int")
    last = parts.filter("of_last").select(F.col("part").alias("before"), "id")
    met = parts.filter("of_first").join(F.broadcast(follows), "part").join(last, ["before", "id"]).groupBy("part", "before").agg(F.max(F.struct("depth", "within")).alias("m"))
    met = materialise(met.select("part", "before", F.col("m.depth").alias("same"), F.col("m.within").alias("bytes")))
    starts = met.select("part", "same", "bytes")
    ends = met.select(F.col("before").alias("part"), F.col("same").alias("next_same"))
    tip = parts.filter("of_last").groupBy("part").agg(F.max("depth").alias("tip"))
    known = parts.join(F.broadcast(starts), "part", "left").join(F.broadcast(ends), "part", "left").join(F.broadcast(tip), "part", "left")
    goes_on = F.coalesce(F.col("of_first") & (F.col("depth") <= F.col("same")), F.lit(False))
    no_leaf = F.coalesce(F.col("of_last") & (F.col("next_same") == F.col("tip")), F.lit(False))
    summed = known.groupBy("id").agg(
        F.first("parent").alias("parent"), F.first("depth").alias("depth"), F.min("conv_id").alias("conv_id"), F.sum("n_convs").alias("n_convs"),
        F.sum(F.col("n_children") - F.when(goes_on & (F.col("depth") < F.col("same")), 1).otherwise(0)).alias("n_children"),
        F.sum(F.col("n_leaves") - no_leaf.cast("int")).alias("n_leaves"), F.sum(F.col("saved") + F.when(goes_on, F.col("bytes")).otherwise(0)).alias("kept"), F.first("above").alias("above"), F.max("ends").alias("ends"))
    return summed.withColumn("saved", F.col("kept") - (F.col("n_convs") - 1) * F.col("above")).withColumn("ends", F.coalesce("ends", F.lit(NONE))).drop("kept", "above")


def trie(conversations: DataFrame, piece: int = PIECE) -> DataFrame:
    """conversations: conv_id, turns (digest, n_bytes).  One row per node of the trie of all of them."""
    chained = materialise(paths(conversations))
    distinct = endings(chained, piece).join(chained.select("conv_id", "path", "sums"), "conv_id")
    ordered = distinct.repartitionByRange("path").sortWithinPartitions("path").select("path", "sums", "n", "conv_id", "ends")
    made = materialise(ordered.mapInArrow(_patricia, _OUT_DDL))
    own = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", F.col("saved").alias("saved_tokens"), F.col("ends").alias("ends_sha256")]
    done = made.filter("part is null and parent is null").select(*own)
    shared = materialise(_merged(made.filter("part is not null")))
    parents = shared.select(F.col("id").alias("parent"), F.col("conv_id").alias("parent_conv_id"))
    # two paths a task; broadcast while they are few
    parents = F.broadcast(parents) if shared.count() <= 500_000 else parents
    below = made.filter("part is null and parent is not null").drop("parent_conv_id").join(parents, "parent").select(*own)
    top = shared.join(parents, "parent", "left").select(*own)
    return done.unionByName(below).unionByName(top)


def prefix_trie(df: DataFrame, key: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", piece: int = PIECE) -> DataFrame:
    """The trie of the rebuilt conversations of a table of turns."""
    return trie(rebuilt(df, key, turn, role, text), piece)
