"""Near-duplicate groups from bottom-k sketches of one hash function.

A document's set holds the hashes of its distinct five-word shingles; its sketch is the INDEX smallest.  Documents of
equal sets form one class, and its smallest id stands for it.  Each retained value has an inverted list of classes:

* Lists of up to LIST classes pair their members.  The union sketch of a pair is estimated on both whole sketches, the
  values of longer lists among them; pairs far below the threshold go, the others are verified on the full sets.
* A class is *crowded* when its values in longer lists alone could reach the estimate.  Crowded classes of a long list
  are dealt over blocks of bounded size, in each of which a few members of the list stand as pivots: a task takes a block
  with its full sets, counts every intersection exactly, and gives back the links that join its members, never all pairs.
  Members still outside the largest component of their list then meet its smallest set, and the others only where they
  share a value outside that set which a prefix filter leaves (``_stray_links``): a crowd around one passage or one text
  whose members do not link shares none.  Where one class of a pair is not crowded, a pair that reaches the estimate
  shares more values than that class has in long lists, so one in a short list.

Links are those with 100 * intersection >= percent * union.  A pair just at the threshold shares none of the ten
smallest values of its union with a probability of about 0.25^10, and its estimate falls short with one of about 1e-5;
both are less above.  Every reported link is verified.  Components are the smallest ids reachable over links.

Null text and text without words: an empty set, linked with nothing, kept.  Fewer than five words are one shingle.
Repeated rows of one id are one document; each row gets its result.  Rows of null id link with nothing: they are kept,
and their component is null.  Keys are whole numbers; others raise a TypeError.  Only the key and the text are read.
"""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import long_key, materialise
from .components import components

WIDTH = 5
PERCENT = 75
INDEX = 32
LIST = 32
#: Values of a crowded class whose long lists it enters.
ENTERED = 10
BLOCK_DOCS, BLOCK_SHINGLES = 512, 400_000
#: Members of a long list, about, that stand in all its blocks.
PIVOTS = 16
#: Members of a cluster, about, that show which values are frequent in it.
SHOWN = 64
#: Texts that a task turns into sets at once.
PIECE = 256
#: The union-sketch estimate that a pair must reach to be verified.
ESTIMATE = 0.4
_BASE = np.uint64(0x9E3779B97F4A7C15)


class _Words(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) > 100_000:
            self.clear()
        self[word] = h = xxhash.xxh3_64_intdigest(word)
        return h


_words = _Words()


def shingles(text: str | None, width: int = WIDTH) -> np.ndarray:
    """The sorted distinct hashes of a text's shingles, as signed longs."""
    flat = (text or "").encode("utf-8", "surrogatepass").lower().split()
    h = np.fromiter(map(_words.__getitem__, flat), np.uint64, len(flat))
    size = min(width, len(h))
    if not size:
        return np.empty(0, np.int64)
    code = np.full(len(h) - size + 1, size, np.uint64)
    for i in range(size):
        code = (code ^ (code >> np.uint64(29))) * _BASE + h[i : len(h) - size + 1 + i]
    code = (code ^ (code >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return np.unique((code ^ (code >> np.uint64(32))).view(np.int64))


def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The batches in pieces of PIECE rows at most: what a task makes of a piece is small beside the batch."""
    for batch in batches:
        for at in range(0, batch.num_rows, PIECE):
            yield batch.slice(at, PIECE)


def _lists(arrays: list[np.ndarray]) -> pa.ListArray:
    ends = np.cumsum([0, *map(len, arrays)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([np.empty(0, np.int64), *arrays]), pa.int64()))


def signatures(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, n_shingles, print (128 bits of the whole set, null if empty) and sketch, one row per input row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            sizes, prints, sketches = [], [], []
            for text in batch.column(1):
                own = shingles(text.as_py())
                sizes.append(len(own))
                prints.append(xxhash.xxh3_128_digest(own.tobytes()) if len(own) else None)
                sketches.append(own[:INDEX].copy())  # a view would hold the whole set
            yield pa.record_batch([batch.column(0), pa.array(sizes, pa.int64()), pa.array(prints, pa.binary()), _lists(sketches)], names=["key", "n_shingles", "print", "sketch"])

    own = df.select(long_key(df, key).alias("key"), F.col(f"`{text}`").alias("t"))
    return own.mapInArrow(run, "key long, n_shingles long, print binary, sketch array<long>")


def full_sets(df: DataFrame, wanted: DataFrame, key: str, text: str) -> DataFrame:
    """rep, shingles (the full set) for the wanted ids (one column, rep)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            yield pa.record_batch([batch.column(0), _lists([shingles(t.as_py()) for t in batch.column(1)])], names=["rep", "shingles"])

    own = df.select(long_key(df, key).alias("rep"), F.col(f"`{text}`").alias("t"))
    return own.join(wanted, "rep", "left_semi").mapInArrow(run, "rep long, shingles array<long>").dropDuplicates(["rep"])


def _verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) that link on their full sets; a pair at a time, so no batch of sets is held."""
    left = pairs.join(sets.select(F.col("rep").alias("a"), F.col("shingles").alias("x")), "a")
    full = left.join(sets.select(F.col("rep").alias("b"), F.col("shingles").alias("y")), "b")
    both = F.size(F.array_intersect("x", "y"))
    return full.filter(100 * both >= percent * (F.size("x") + F.size("y") - both)).select("a", "b")


def forest(ids: np.ndarray, sets: list[np.ndarray], percent: int, groups: np.ndarray | None = None) -> list[tuple[int, int]]:
    """Links that connect what the links among these sets connect, at most one fewer than the sets; all counts are exact.
    With groups, only links between different groups count."""
    lengths = np.array([len(s) for s in sets])
    owner = np.repeat(np.arange(len(sets)), lengths)
    _, code, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = times[code] > 1
    owner, code = owner[shared], np.unique(code[shared], return_inverse=True)[1]
    both = np.zeros((len(sets), len(sets)), np.float32)
    columns = int(code.max()) + 1 if len(code) else 0
    step = max(1, 8_000_000 // len(sets))
    for low in range(0, columns, step):
        part = (code >= low) & (code < low + step)
        has = np.zeros((len(sets), min(step, columns - low)), np.float32)
        has[owner[part], code[part] - low] = 1
        both += has @ has.T
    union = lengths[:, None] + lengths[None, :] - both
    linked = 100 * both >= percent * union
    if groups is not None:
        linked &= groups[:, None] != groups[None, :]
    free, out = np.ones(len(sets), bool), []
    for root in range(len(sets)):
        if not free[root]:
            continue
        free[root] = False
        queue = [root]
        while queue:
            i = queue.pop()
            near = np.flatnonzero(linked[i] & free)
            free[near] = False
            out += [(int(ids[i]), int(ids[j])) for j in near]
            queue += near.tolist()
    return out


def _blocks(members: Column, weight: Column) -> Column:
    """How many blocks hold so many members of so many shingles in all."""
    return F.greatest(F.ceil(members / BLOCK_DOCS), F.ceil(weight / BLOCK_SHINGLES)).cast("int")


def _dealt(crowded: DataFrame) -> DataFrame:
    """rep, n, value, blocks, block, pivot: the long lists that crowded classes (rep, n, values) enter, each dealt over bounded blocks."""
    entered = crowded.select("rep", "n", F.explode(F.slice("values", 1, ENTERED)).alias("value"))
    sizes = entered.groupBy("value").agg(F.count("*").alias("members"), _blocks(F.count("*"), F.sum("n")).alias("blocks")).filter("members > 1")
    pivot = F.pmod(F.xxhash64("rep", F.lit(7)), F.col("members")) < PIVOTS
    return entered.join(sizes, "value").select("rep", "n", "value", "blocks", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int").alias("block"), pivot.alias("pivot"))


def _forests(met: DataFrame, sets: DataFrame, percent: int, by: list[str]) -> DataFrame:
    """The links within each group of met (rep, component, the columns of by), between different components where they are not null."""

    def task(group: pa.Table) -> pa.Table:
        found = group.column("component")
        groups = None if found.null_count else found.to_numpy()
        links = forest(group.column("rep").to_numpy(), [s.values.to_numpy() for s in group.column("shingles")], percent, groups)
        return pa.table([pa.array([x[k] for x in links], pa.int64()) for k in (0, 1)], names=["a", "b"])

    return met.join(sets, "rep").groupBy(*by).applyInArrow(task, "a long, b long").distinct()


def _crowded_links(dealt: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links within every block, where the pivots of a list stand in all its blocks: a row a member, and few for the pivots."""
    blocks = F.expr("explode(if(pivot, sequence(0, blocks - 1), array(block)))").alias("block")
    return _forests(dealt.select("rep", "value", F.lit(None).cast("long").alias("component"), blocks), sets, percent, ["value", "block"])


def _apart(percent: int):
    """For a bounded part of a cluster's members and the cluster's base: the members' links with the base, and the keys of the rest."""

    def task(members: pa.Table, bases: pa.Table) -> pa.Table:
        (home,), (base,) = bases.column("cluster").to_pylist(), bases.column("base").to_pylist()
        held, often, times = (bases.column(c)[0].values.to_numpy() for c in ("held", "often", "times"))
        linked, rows, keys = [], [], []
        for rep, component, s in zip(members.column("rep").to_pylist(), members.column("component").to_pylist(), members.column("shingles")):
            own = s.values.to_numpy()
            n, rest = len(own), own[~np.isin(own, held)]
            both = n - len(rest)
            if rep != base and 100 * both >= percent * (n + len(held) - both):
                linked.append((rep, n, base))
            # what a linked set of the cluster must share at least: it is no smaller than the base
            need = -(-percent * (n + max(-(-percent * n // 100), len(held))) // (100 + percent))
            at = np.searchsorted(often, rest)
            known = np.append(often, 0)[at] == rest
            rank = np.where(known & (at < len(often)), np.append(times, 0)[at], 0)
            keys.append(rest[np.lexsort((rest, rank))[: n - need + 1]])
            rows.append((rep, n, component, len(keys[-1])))
        of = np.array(rows, np.int64)
        of = np.concatenate([np.array(linked, np.int64).reshape(-1, 3), np.repeat(of[:, :3], of[:, 3], 0)])
        value = pa.array(np.concatenate([np.zeros(len(linked), np.int64), *keys]), pa.int64(), mask=np.arange(len(of)) < len(linked))
        return pa.table([pa.array(np.full(len(of), home)), *map(pa.array, of.T.copy()), value], names=["home", "rep", "n", "component", "value"])

    return task


def _stray_links(dealt: DataFrame, found: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The links that blocks and pivots may have missed: members of a list in different components and blocks.

    The largest component of a list is its home, and the lists of one home are a cluster.  The smallest set of a cluster
    is its base.  If two members link, then both link with the base, or they share a value outside it: else their
    intersection would be within the base's with either, and their union no smaller.  So each member meets the base, and
    the others only by its keys, the values outside the base that a prefix filter leaves: all but as many as a linked pair
    shares, less one, in one order for the cluster.  Values that a few members show to be frequent come last in it; any
    order finds all pairs.  Lists of one block or of one component, so far as links are known, are done.
    """
    where = dealt.filter("blocks > 1").join(found.withColumnRenamed("node", "rep"), "rep", "left").withColumn("component", F.coalesce("component", "rep"))
    sizes = where.groupBy("value", "component").agg(F.count("*").alias("members"))
    lists = sizes.groupBy("value").agg(F.max_by("component", F.struct("members", "component")).alias("home"), (F.sum("members") - F.max("members")).alias("strays"))
    members = materialise(where.join(lists.filter("strays > 0").select("value", "home"), "value").select("home", "rep", "n", "component").distinct())
    heads = members.groupBy("home").agg(F.min(F.struct("n", "rep"))["rep"].alias("base"), F.count("*").alias("members"), _blocks(F.count("*"), F.sum("n")).alias("parts"))
    some = members.join(heads, "home").filter(F.pmod(F.xxhash64("rep", F.lit(13)), F.col("members")) < SHOWN).select("home", "rep")
    often = some.join(sets, "rep").select("home", F.explode("shingles").alias("value")).groupBy("home", "value").agg(F.count("*").alias("times")).filter("times > 1")
    often = often.groupBy("home").agg(F.sort_array(F.collect_list(F.struct("value", "times"))).alias("often"))
    bases = heads.join(sets.select(F.col("rep").alias("base"), F.col("shingles").alias("held")), "base").join(often, "home", "left")
    bases = bases.select(F.col("home").alias("cluster"), "base", "held", F.expr("coalesce(often.value, array())").alias("often"), F.expr("coalesce(often.times, array())").alias("times"), F.expr("explode(sequence(0, parts - 1))").alias("slot"))
    parted = members.join(heads.select("home", "parts"), "home").select(F.col("home").alias("home"), F.pmod(F.xxhash64("rep", F.lit(17)), F.col("parts")).cast("int").alias("part"), "rep", "component")
    keyed = parted.join(sets, "rep").groupBy("home", "part").cogroup(bases.groupBy("cluster", "slot")).applyInArrow(_apart(percent), "home long, rep long, n long, component long, value long")
    keyed = materialise(keyed)

    # members that share a key: those of the home need not meet each other
    own = keyed.filter("value is not null")
    shared = own.groupBy("home", "value").agg(F.count("*").alias("all"), F.count_if(F.col("component") != F.col("home")).alias("strays"), (F.min("component") < F.max("component")).alias("apart"), _blocks(F.count("*"), F.sum("n")).alias("blocks"))
    # as many blocks of strays as their share of the members
    folds = F.greatest(F.lit(1), F.ceil(F.col("strays") * F.col("blocks") / F.col("all"))).cast("int")
    met = own.join(shared.filter("apart").select("home", "value", "blocks", folds.alias("folds")), ["home", "value"])
    met = met.withColumn("block", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int"))
    met = met.withColumn("fold", F.when(F.col("component") != F.col("home"), F.pmod(F.xxhash64("rep", F.lit(11)), F.col("folds")).cast("int")))
    pairs = F.expr("""case when blocks = 1 then array(struct(0 as f, 0 as other)) when fold is null then transform(sequence(0, folds - 1), f -> struct(f as f, block as other))
        else concat(transform(sequence(0, blocks - 1), o -> struct(fold as f, o as other)), transform(sequence(0, folds - 1), o -> struct(least(fold, o) as f, -1 - greatest(fold, o) as other))) end""")
    links = _forests(met.select("home", "rep", "value", "component", F.inline(pairs)), sets, percent, ["home", "value", "f", "other"])
    return links.unionByName(keyed.filter("value is null").select(F.col("rep").alias("a"), F.col("component").alias("b")))


def near_duplicates(df: DataFrame, key: str = "doc_id", text: str = "text", percent: int = PERCENT) -> DataFrame:
    """One row per input row: the key, n_shingles, component_id (the smallest key reachable) and kept."""
    signed = materialise(signatures(df, key, text))
    classes = signed.filter("print is not null").groupBy("print").agg(F.min("key").alias("rep"))
    member = signed.select("key", "n_shingles", "print").join(classes, "print", "left")
    reps = classes.select("rep")
    kept = signed.filter("n_shingles > 0").join(reps, F.col("key") == F.col("rep"), "left_semi").dropDuplicates(["key"])
    index = kept.select(F.col("key").alias("rep"), F.col("n_shingles").alias("n"), F.posexplode("sketch").alias("rank", "value"))
    lists = materialise(index.groupBy("value").agg(F.count("*").alias("members")).filter("members > 1"))
    long, short = lists.filter(F.col("members") > LIST), lists.filter(F.col("members") <= LIST).select("value")
    # long lists are few: at most INDEX / LIST of the classes; each class learns which of its values stand in them
    known = index.join(long.select("value", F.lit(True).alias("long")), "value", "left")
    by_class = known.groupBy("rep").agg(
        F.first("n").alias("n"),
        F.sort_array(F.collect_list("value")).alias("sketch"),
        F.sort_array(F.collect_list(F.when(F.col("long"), F.col("value")))).alias("values"))
    # the union sketch of a linked pair has at least this many values: the smaller set has percent of the larger at least
    least = F.least(F.lit(INDEX), F.col("n") * percent / 100)
    by_class = materialise(by_class.withColumn("crowded", (F.size("values") > 0) & (F.size("values") >= ESTIMATE * least)))

    ranked = by_class.select("rep", "n", "values", F.size("sketch").alias("k"), F.size("values").alias("l"), F.posexplode("sketch").alias("rank", "value"))
    ranked = ranked.filter(~F.array_contains("values", F.col("value"))).drop("values").join(short, "value")
    a = ranked.select("value", F.col("rep").alias("a"), F.col("n").alias("an"), F.col("k").alias("ak"), F.col("l").alias("al"), F.col("rank").alias("ar"))
    b = ranked.select("value", F.col("rep").alias("b"), F.col("n").alias("bn"), F.col("k").alias("bk"), F.col("l").alias("bl"), F.col("rank").alias("br"))
    fits = (F.col("a") < F.col("b")) & (100 * F.least("an", "bn") >= percent * F.greatest("an", "bn"))
    shared = a.join(b, "value").filter(fits).groupBy("a", "b").agg(
        F.sort_array(F.collect_list(F.struct("ar", "br"))).alias("at"), F.least(F.first("ak"), F.first("bk")).alias("k"), F.least(F.first("al"), F.first("bl")).alias("l"))
    # without long values on one side the short ones are all; else they and the long ones it could share bound the estimate
    in_union = F.expr("if(l = 0, size(filter(at, (x, i) -> x.ar + x.br - i < k)), size(at) + l)")
    likely = materialise(shared.filter(in_union >= ESTIMATE * F.col("k")).select("a", "b", "k", (F.col("l") > 0).alias("open")))
    sketches = by_class.filter(F.size("values") > 0).select("rep", "sketch")
    opened = likely.filter("open").join(sketches.select(F.col("rep").alias("a"), F.col("sketch").alias("x")), "a").join(sketches.select(F.col("rep").alias("b"), F.col("sketch").alias("y")), "b")
    whole = F.expr("size(array_intersect(array_intersect(x, y), slice(array_sort(array_union(x, y)), 1, k)))")
    pairs = materialise(likely.filter("not open").select("a", "b").unionByName(opened.filter(whole >= ESTIMATE * F.col("k")).select("a", "b")))
    crowded = by_class.filter("crowded").select("rep", "n", "values")

    wanted = pairs.select(F.col("a").alias("rep")).union(pairs.select("b")).union(crowded.select("rep")).distinct()
    sets = materialise(full_sets(df, wanted, key, text))
    dealt = materialise(_dealt(crowded))
    found = components(_verified(pairs, sets, percent).unionByName(_crowded_links(dealt, sets, percent)))
    if not dealt.filter("blocks > 1").isEmpty():
        more = materialise(_stray_links(dealt, found, sets, percent))
        if not more.isEmpty():
            found = components(found.select(F.col("node").alias("a"), F.col("component").alias("b")).unionByName(more))
    out = member.join(found.withColumnRenamed("node", "rep"), "rep", "left")
    component = F.when(F.col("key").isNotNull(), F.coalesce("component", "rep", "key"))
    return out.select(F.col("key").alias(key), "n_shingles", component.alias("component_id"), F.coalesce(F.col("key") == component, F.lit(True)).alias("kept"))
