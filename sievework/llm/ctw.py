"""Context-tree weighting over bytes.

Every byte of a text is eight binary decisions.  Each decision is counted under its contexts of 0 to DEPTH preceding
bytes, and the weighted probability of the whole training text, mixed over all trees of those contexts from the
Krichevsky-Trofimov estimates of their nodes, gives each node its weight.  A text's score is the log10 probability of
its lower-cased (A-Z) bytes and its end under those weights; contexts that training never reached end the path.

The counts are of all grams (DEPTH + 1 bytes) of the training texts.  They are gathered by blocks of documents as the
scan reads them, without a shuffle of texts; summed over the blocks; and weighted in buckets that hold whole subtrees of
three bytes, so no task sees more than a part of the tree.  Only nodes of at most two context bytes meet in the driver,
and are broadcast: 65,793 contexts of 255 decisions at most, 24 bytes each, whatever the corpus.  Each block then gets
back the values of its own grams and words by a join, and scores its texts.  A block is cut by bytes; a single text
longer than that is a block of its own and is read in slices, so a task holds about one block's bytes and grams.

Grams and words travel as packed lists, one for each block and slot; a slot is a hash of the gram or word alone, so a
frequent one weighs no more than one entry for each block, and the slots grow in number with the bytes of all texts.

Null text is empty: one token, the end, and its probability.  Rows of one id each get their own, equal result.
Without training rows every estimate is 1/2 and the base is 0.  Only the key and the text are read.
"""
from __future__ import annotations

import math
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from .common import ascii_lower, blocks_for, materialise

DEPTH = 5
#: Subtrees of this many context bytes lie in one bucket; shallower nodes are few and shared.
SPLIT = 3
BLOCK_BYTES = 32 << 20
BUCKET_GRAMS = 400_000
#: The bytes of text whose grams or words meet in one slot.
SLOT_BYTES = 48 << 20
#: No UTF-8 text holds this byte: it stands before the first byte and is the end.
_EDGE = 255
_CHUNK = 1 << 20


def _log_gamma(x: np.ndarray) -> np.ndarray:
    """For x > 0; small x are moved up by the recurrence first."""
    x = np.asarray(x, np.float64)
    low = x < 8
    y = np.where(low, x + 8, x)
    out = (y - 0.5) * np.log(y) - y + 0.5 * math.log(2 * math.pi) + 1 / (12 * y) - 1 / (360 * y**3)
    z = x[low]
    rise = z.copy()
    for i in range(1, 8):
        rise *= z + i
    out[low] -= np.log(rise)
    return out


def _estimate(n0: np.ndarray, n1: np.ndarray) -> np.ndarray:
    """The log of the Krichevsky-Trofimov probability of n0 zeros and n1 ones."""
    return _log_gamma(n0 + 0.5) + _log_gamma(n1 + 0.5) - math.log(math.pi) - _log_gamma(n0 + n1 + 1.0)


def _weigh(n0, n1, below):
    """The weighted log probability of a node from that of its children, and the weight of its own estimate."""
    own = _estimate(n0, n1)
    return np.logaddexp(own, below) - math.log(2), 1 / (1 + np.exp(np.clip(below - own, -700, 700)))


def grams(texts: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Slices of the grams at each byte and end of the texts, the nearest context byte first, the byte itself last; and
    which text each stands in.  A slice begins at a text or inside one that is longer than a slice."""
    edge = bytes([_EDGE])
    for first, part in _chunks(texts):
        flat = np.frombuffer(b"".join([edge * DEPTH + t + edge for t in part]), np.uint8)
        ends = np.cumsum([len(t) + 1 + DEPTH for t in part])
        for low in range(DEPTH, len(flat), _CHUNK):
            high = min(low + _CHUNK, len(flat))
            key = np.zeros(high - low, np.int64)
            for d in range(1, DEPTH + 1):
                key = (key << 8) | flat[low - d : high - d]
            key = (key << 8) | flat[low:high]
            at = np.arange(low, high)
            owner = np.searchsorted(ends, at, "right")
            own = at - (ends - [len(t) + 1 for t in part])[owner] >= 0  # not the edges before a text
            yield key[own], owner[own] + first


def _chunks(texts: list[bytes]) -> Iterator[tuple[int, list[bytes]]]:
    """(first, texts) of bounded sizes, a single longer text aside."""
    first = size = 0
    for at, t in enumerate(texts):
        if size and size + len(t) > _CHUNK // 2:
            yield first, texts[first:at]
            first, size = at, 0
        size += len(t) + 1
    if texts:
        yield first, texts[first:]


def _slices(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Runs of rows of about half a chunk of text."""
    size = np.cumsum(pa.compute.binary_length(batch.column(2)).to_numpy(zero_copy_only=False))
    at = 0
    while at < batch.num_rows:
        end = max(at + 1, int(np.searchsorted(size, (size[at - 1] if at else 0) + _CHUNK // 2, "right")))
        yield batch.slice(at, end - at)
        at = end


class _Known(dict):
    """word: its count; a block's counts come in the order in which its words first occur."""

    def __init__(self, counts: np.ndarray):
        super().__init__()
        self._counts = counts

    def __missing__(self, word: bytes) -> float:
        self[word] = c = float(self._counts[len(self)])
        return c


class _Block:
    """The grams and words of the texts of one block, with how often they teach."""

    def __init__(self):
        self.size, self.seen, self.times, self.words = 0, [], [], Counter()

    def add(self, texts: list[bytes], teaches: list[bool]) -> None:
        for teach in (True, False):
            for key, _ in grams([t for t, x in zip(texts, teaches, strict=True) if x == teach]):
                found, n = np.unique(key, return_counts=True)
                self.seen.append(found)
                self.times.append(n if teach else np.zeros(len(n), np.int64))
        if len(self.seen) >= 12:
            self._merge()
        for t, teach in zip(texts, teaches, strict=True):
            self.size += len(t) + 1
            self.words.update(t.split() if teach else dict.fromkeys(t.split(), 0))

    def _merge(self) -> None:
        merged, place = np.unique(np.concatenate(self.seen), return_inverse=True)
        self.times = [np.bincount(place, np.concatenate(self.times), len(merged)).astype(np.int64)]
        self.seen = [merged]

    def lists(self, slots: int) -> Iterator[dict]:
        """The sorted grams, and the words by their numbers in the order of first occurrence, as one list for each slot."""
        if self.seen:
            self._merge()
            for slot, at in _by_slot(_slot_of(self.seen[0], slots), slots):
                yield {"slot": slot, "word": False, "ids": _pack(np.diff(self.seen[0][at], prepend=0)), "n": _pack(self.times[0][at])}
        words = list(self.words)
        times = np.fromiter(self.words.values(), np.int64, len(words))
        hashes = np.fromiter(map(zlib.crc32, words), np.int64, len(words))
        for slot, at in _by_slot(_slot_of(hashes, slots), slots):
            said = pa.compress(b"\n".join([words[i] for i in at.tolist()]), "zstd", asbytes=True)
            yield {"slot": slot, "word": True, "ids": _pack(np.diff(at, prepend=0)), "n": _pack(times[at]), "said": said, "said_bytes": sum(len(words[i]) + 1 for i in at.tolist()) - 1}


def _slot_of(ids: np.ndarray, slots: int) -> np.ndarray:
    mixed = ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    return ((mixed >> np.uint64(32)) % np.uint64(slots)).astype(np.int64)


def _by_slot(slot: np.ndarray, slots: int) -> Iterator[tuple[int, np.ndarray]]:
    order = np.argsort(slot, kind="stable")
    for part in np.split(order, np.flatnonzero(np.diff(slot[order])) + 1):
        if len(part):
            yield int(slot[part[0]]), part


def _pack(a: np.ndarray) -> bytes:
    """Eight-byte values as byte planes, compressed; the size comes first."""
    planes = np.ascontiguousarray(a.view(np.uint8).reshape(-1, 8).T)
    return len(a).to_bytes(8, "little") + pa.compress(planes, "zstd", asbytes=True)


def _unpack(data: bytes, kind=np.int64) -> np.ndarray:
    size = int.from_bytes(data[:8], "little")
    planes = np.frombuffer(pa.decompress(data[8:], 8 * size, "zstd"), np.uint8).reshape(8, size)
    return np.ascontiguousarray(planes.T).view(kind).reshape(-1)


def _levels(key: np.ndarray, n: np.ndarray, lowest: int):
    """For each of the 8 decisions: the bit and the node of each gram; nodes from DEPTH up to ``lowest`` context bytes as
    (place of each gram's node, n0, n1, weight), deepest first, and those of ``lowest`` with their weighted logs."""
    byte = key & 255
    ordered = []
    for depth in range(DEPTH, lowest - 1, -1):
        whole = ((key >> (8 * (DEPTH - depth + 1))) << 8) | byte
        order = np.argsort(whole, kind="stable")
        ordered.append((order, whole[order], n[order]))
    for k in range(8):
        bit, prefix = (byte >> (7 - k)) & 1, (1 << k) | (byte >> (8 - k))
        path, above, within = [], None, None
        for order, whole, times in ordered:  # in this order the nodes of every decision lie together
            ids = (whole >> 8 << 8) | (1 << k) | ((whole & 255) >> (8 - k))
            first = np.flatnonzero(np.concatenate(([True], ids[1:] != ids[:-1])))
            ones = np.add.reduceat(times * ((whole >> (7 - k)) & 1), first)
            n0, n1, ids = np.add.reduceat(times, first) - ones, ones, ids[first]
            place = np.empty(len(order), np.int64)
            place[order] = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(order))))
            if above is None:
                logs, weight = _estimate(n0, n1), np.ones(len(ids))
            else:
                parent = np.zeros(len(above), np.int64)
                parent[within] = place
                logs, weight = _weigh(n0, n1, np.bincount(parent, above, len(ids)))
            path.append((place, n0, n1, weight))
            above, within = logs, place
        yield bit, prefix, path, (ids, n0, n1, logs)


def _mixed(p: np.ndarray, bit: np.ndarray, n0: np.ndarray, n1: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """One step up: nan below means that no deeper node was reached."""
    n = n0 + n1
    own = (np.where(bit == 1, n1, n0) + 0.5) / (n + 1)
    return np.where(n > 0, np.where(np.isnan(p), own, weight * own + (1 - weight) * p), p)


def _buckets(totals: DataFrame) -> DataFrame:
    shift = 8 * (DEPTH + 1 - SPLIT)
    count = blocks_for(totals.count(), BUCKET_GRAMS)
    return totals.withColumn("bucket", F.pmod(F.xxhash64(F.shiftright("gram", shift)), F.lit(count)))


def _top(bucketed: DataFrame) -> list[tuple[np.ndarray, ...]]:
    """The nodes of SPLIT - 1 to 0 context bytes: (ids, n0, n1, weight) for each depth."""

    def sums(table: pa.Table) -> pa.Table:
        key, n = _sorted(table)
        out = []
        for _, _, _, (ids, n0, n1, logs) in _levels(key, n, SPLIT):
            up = ((ids >> 16) << 8) | (ids & 255)
            nodes, place = np.unique(up, return_inverse=True)
            out.append((nodes, *(np.bincount(place, v, len(nodes)) for v in (n0, n1, logs))))
        return pa.table([np.concatenate(c) for c in zip(*out, strict=True)], names=["node", "n0", "n1", "logs"])

    found = bucketed.groupBy("bucket").applyInArrow(sums, "node long, n0 double, n1 double, logs double")
    found = found.groupBy("node").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"), F.sum("logs").alias("logs")).toArrow()
    ids, n0, n1, below = (found.column(c).to_numpy() for c in ("node", "n0", "n1", "logs"))
    order = np.argsort(ids)
    ids, n0, n1, below = ids[order], n0[order], n1[order], below[order]
    out = []
    for depth in range(SPLIT - 1, -1, -1):
        logs, weight = _weigh(n0, n1, below)
        out.append((ids, n0, n1, weight))
        if depth:
            up, place = np.unique(((ids >> 16) << 8) | (ids & 255), return_inverse=True)
            n0, n1, below = (np.bincount(place, v, len(up)) for v in (n0, n1, logs))
            ids = up
    return out


def _sorted(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    key, n = table.column("gram").to_numpy(), table.column("n").to_numpy()
    order = np.argsort(key)
    return key[order], n[order].astype(np.float64)


def gram_values(totals: DataFrame, slots: int) -> DataFrame:
    """totals: gram, n (training occurrences, 0 allowed).  slot, gram, value: the log10 probability of its byte in its context."""
    bucketed = _buckets(totals)
    top = totals.sparkSession.sparkContext.broadcast(_top(bucketed))

    def values(table: pa.Table) -> pa.Table:
        key, n = _sorted(table)
        total = np.zeros(len(key))
        for bit, prefix, path, _ in _levels(key, n, SPLIT):
            p = np.full(len(key), np.nan)
            for place, n0, n1, weight in path:
                p = _mixed(p, bit, n0[place], n1[place], weight[place])
            for up, (ids, n0, n1, weight) in zip(range(SPLIT - 1, -1, -1), top.value, strict=True):
                place = np.searchsorted(ids, ((key >> (8 * (DEPTH - up + 1))) << 8) | prefix)
                p = _mixed(p, bit, n0[place], n1[place], weight[place])
            total += np.log10(np.where(np.isnan(p), 0.5, p))
        return pa.table([_slot_of(key, slots), key, total], names=["slot", "gram", "value"])

    return bucketed.groupBy("bucket").applyInArrow(values, "slot long, gram long, value double")


def score(df: DataFrame, training: Column, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per input row: the key, training, n_tokens, n_known, train_tokens, base_score, score and bits_per_byte.

    ``training`` says which rows teach.  The base is a unigram model of words with one added count.
    """
    own = df.select(F.col(f"`{key}`").alias("key"), F.coalesce(training, F.lit(False)).alias("training"), ascii_lower(F.coalesce(F.col(f"`{text}`"), F.lit(""))).cast("binary").alias("t"))
    kind = own.schema["key"].dataType
    slots = blocks_for(own.agg(F.sum(F.octet_length("t"))).first()[0], SLOT_BYTES)
    listed = {"block": pa.int64(), "slot": pa.int64(), "word": pa.bool_(), "ids": pa.binary(), "n": pa.binary(), "said": pa.binary(), "said_bytes": pa.int64()}
    stored = pa.schema([
        *listed.items(), ("part", pa.int64()), ("keys", pa.list_(to_arrow_type(kind))), ("teaches", pa.list_(pa.bool_())), ("sizes", pa.list_(pa.int64())), ("texts", pa.binary())])

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, held, parts = TaskContext.get().partitionId() << 32, _Block(), 0

        def row(columns: dict) -> pa.RecordBatch:
            return pa.record_batch([columns.get(f.name, pa.nulls(1, f.type)) for f in stored], schema=stored)

        def lists() -> Iterator[pa.RecordBatch]:
            for x in held.lists(slots):
                yield row({k: pa.array([v], listed[k]) for k, v in {**x, "block": number}.items()})

        for batch in batches:
            for part in _slices(batch):
                texts, teaches = part.column(2).to_pylist(), part.column(1).to_pylist()
                held.add(texts, teaches)
                whole = pa.array([0, len(texts)], pa.int32())
                lengths, taught, keys = (pa.ListArray.from_arrays(whole, c) for c in (pa.array(map(len, texts), pa.int64()), pa.array(teaches, pa.bool_()), pa.concat_arrays([part.column(0)])))
                packed = pa.array([pa.compress(b"".join(texts), "zstd", asbytes=True)], pa.binary())
                yield row({"block": pa.array([number], pa.int64()), "part": pa.array([parts], pa.int64()), "keys": keys, "teaches": taught, "sizes": lengths, "texts": packed})
                parts += 1
                if held.size >= BLOCK_BYTES:
                    yield from lists()
                    number, held = number + 1, _Block()
        yield from lists()

    kinds = "block long, slot long, word boolean, ids binary, n binary, said binary, said_bytes long, part long, " + f"keys array<{kind.simpleString()}>, teaches array<boolean>, sizes array<long>, texts binary"
    found = materialise(own.mapInArrow(gather, kinds))
    of_docs, of_grams, of_words = found.filter("texts is not null"), found.filter("not word"), found.filter("word")

    def summed(table: pa.Table) -> pa.Table:
        ids = np.concatenate([np.cumsum(_unpack(x)) for x in table.column("ids").to_pylist()])
        key, place = np.unique(ids, return_inverse=True)
        times = np.concatenate([_unpack(x) for x in table.column("n").to_pylist()])
        return pa.table([key, np.bincount(place, times, len(key)).astype(np.int64)], names=["gram", "n"])

    totals = materialise(of_grams.select("slot", "ids", "n").groupBy("slot").applyInArrow(summed, "gram long, n long"))

    def valued(lists: pa.Table, known: pa.Table) -> pa.Table:
        order = np.argsort(ids := known.column("gram").to_numpy())
        ids, value = ids[order], known.column("value").to_numpy()[order]
        out = [_pack(value[np.searchsorted(ids, np.cumsum(_unpack(x.as_py())))]) for x in lists.column("ids")]
        return pa.table([lists.column("block"), lists.column("word"), lists.column("ids"), pa.array(out, pa.binary())], names=["block", "word", "ids", "values"])

    def counted(lists: pa.Table) -> pa.Table:
        said = [pa.decompress(x, size, "zstd", asbytes=True).split(b"\n") for x, size in zip(lists.column("said").to_pylist(), lists.column("said_bytes").to_pylist(), strict=True)]
        total: dict[bytes, int] = {}
        for words, n in zip(said, lists.column("n").to_pylist(), strict=True):
            for w, times in zip(words, _unpack(n).tolist(), strict=True):
                total[w] = total.get(w, 0) + times
        out = [_pack(np.fromiter(map(total.__getitem__, words), np.float64, len(words))) for words in said]
        rest = [0] * (len(out) - 1)
        return pa.table({
            "block": lists.column("block"), "word": lists.column("word"), "ids": lists.column("ids"), "values": pa.array(out, pa.binary()),
            "all": pa.array([sum(total.values()), *rest], pa.int64()), "distinct": pa.array([sum(c > 0 for c in total.values()), *rest], pa.int64())})

    answer = "block long, word boolean, ids binary, values binary"
    words_back = materialise(of_words.select("slot", "block", "word", "ids", "n", "said", "said_bytes").groupBy("slot").applyInArrow(counted, f"{answer}, all long, distinct long"))
    sums = words_back.agg(F.sum("all").alias("n"), F.sum("distinct").alias("v")).first()
    ends = of_docs.agg(F.sum(F.size(F.filter("teaches", lambda x: x)))).first()[0] or 0
    all_tokens = (sums.n or 0) + ends
    distinct = (sums.v or 0) + (1 if ends else 0)
    down = math.log10(all_tokens + distinct + 1)
    values = gram_values(totals, slots)
    back = of_grams.select("slot", "block", "word", "ids").groupBy("slot").cogroup(values.groupBy("slot")).applyInArrow(valued, answer)
    back = back.unionByName(words_back.select("block", "word", "ids", "values"))

    def scored(docs: pa.Table, known: pa.Table) -> pa.Table:
        of = {}
        for word in (False, True):
            rows = known.filter(pa.compute.equal(known.column("word"), word))
            ids = np.concatenate([np.empty(0, np.int64), *(np.cumsum(_unpack(x)) for x in rows.column("ids").to_pylist())])
            value = np.concatenate([np.empty(0), *(_unpack(x, np.float64) for x in rows.column("values").to_pylist())])
            order = np.argsort(ids)
            of[word] = ids[order], value[order]
        (ids, value), count = of[False], _Known(of[True][1])
        del order, known, rows, of
        done = []
        for row in docs.sort_by("part").to_batches(max_chunksize=1):
            sizes = row.column("sizes")[0].values.to_numpy()
            joined = pa.decompress(row.column("texts")[0].as_buffer(), int(sizes.sum()), "zstd", asbytes=True)
            ends_at = np.cumsum(sizes).tolist()
            texts = [joined[a:b] for a, b in zip([0, *ends_at], ends_at, strict=False)]
            total = np.zeros(len(texts))
            for taught in (True, False):  # the slices of grams() as gather made them
                chosen = [i for i, x in enumerate(row.column("teaches")[0].as_py()) if x == taught]
                part = np.zeros(len(chosen))
                for found, owner in grams([texts[i] for i in chosen]):
                    found, place = np.unique(found, return_inverse=True)
                    part += np.bincount(owner, value[np.searchsorted(ids, found)][place], len(chosen))
                total[chosen] = part
            tokens, hits, base = [], [], []
            for t in texts:
                c = np.fromiter(map(count.__getitem__, t.split()), np.float64)
                tokens.append(len(c) + 1)
                hits.append(int((c > 0).sum()) + (ends > 0))
                base.append(float(np.log10(c + 1).sum()) + math.log10(ends + 1) - down * (len(c) + 1))
            done.append(pa.table({
                "key": row.column("keys")[0].values, "training": row.column("teaches")[0].values, "n_tokens": pa.array(tokens, pa.int64()), "n_known": pa.array(hits, pa.int64()),
                "train_tokens": pa.array([all_tokens] * len(texts), pa.int64()), "base_score": pa.array(base, pa.float64()), "score": pa.array(total), "bits_per_byte": pa.array(-total * math.log2(10) / (sizes + 1))}))
        return pa.concat_tables(done)

    docs = of_docs.select("block", "part", "keys", "teaches", "sizes", "texts")
    out = docs.groupBy("block").cogroup(back.groupBy("block")).applyInArrow(scored, f"key {kind.simpleString()}, training boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double, bits_per_byte double")
    return out.withColumnRenamed("key", key)
