"""Byte-level byte-pair encoding and decoding by corpus-level merge replay.

The distinct pieces of many texts stand one after another as linked bytes.  An inverted index leads from each
mergeable pair to the places where it stands; a heap gives the pair of the lowest rank in the whole corpus, all its
places merge at once, and only the neighbours of touched places enter the index again.  Every distinct piece is
therefore encoded once for each block of texts, however often it occurs.

Null text is the empty text: no tokens.  Special tokens are ordinary text.  Equal texts give equal ids; nothing is
cut.  Only the key and the text are read from the input.
"""
from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from heapq import heappop, heappush

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Code points of text that one block holds at most, a single longer text aside.
BLOCK_CHARS = 24_000_000
_NONE = np.int64(1 << 40)


def load_ranks(path: str) -> list[bytes]:
    """The tokens of a rank file by id: base64, white space and the rank in each line."""
    with open(path, "rb") as lines:
        pairs = [(int(rank), base64.b64decode(token)) for token, rank in (x.split() for x in lines if x.strip())]
    out: list[bytes] = [b""] * (max(r for r, _ in pairs) + 1)
    for rank, token in pairs:
        out[rank] = token
    return out


class Merges:
    """Every pair of tokens whose bytes together are a token, as a sorted table of pair keys, and the rank it gives."""

    def __init__(self, tokens: list[bytes]):
        self.tokens = tokens
        rank = {t: i for i, t in enumerate(tokens) if t}
        keys, gives = [], []
        for token, r in rank.items():
            for cut in range(1, len(token)):
                a, b = rank.get(token[:cut]), rank.get(token[cut:])
                if a is not None and b is not None:
                    keys.append((a << 24) | b)
                    gives.append(r)
        order = np.argsort(np.array(keys, np.int64))
        self.keys, self.gives = np.array(keys, np.int64)[order], np.array(gives, np.int64)[order]
        self.byte = np.array([rank[bytes([i])] for i in range(256)], np.int64)
        self.rank = rank

    def of(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The rank of each pair, _NONE where it doesn't merge."""
        key = (left << 24) | right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.gives[at], _NONE)


def replay(pieces: list[bytes], merges: Merges) -> tuple[np.ndarray, np.ndarray]:
    """All ids of the pieces in order, and the first place of each piece's ids (with one more at the end)."""
    lengths = np.fromiter(map(len, pieces), np.int64, len(pieces))
    ends = np.cumsum(lengths)
    n = int(ends[-1]) if len(ends) else 0
    tok = merges.byte[np.frombuffer(b"".join(pieces), np.uint8)]
    nxt = np.arange(1, n + 1)
    nxt[ends[lengths > 0] - 1] = -1
    prv = np.arange(-1, n - 1)
    prv[(ends - lengths)[lengths > 0]] = -1
    alive = np.ones(n, bool)
    pair = np.full(n, _NONE)
    index: dict[int, list[np.ndarray]] = {}
    heap: list[int] = []

    def enter(places: np.ndarray) -> None:
        """Look up the pairs that begin at places and put them into the index."""
        places = places[nxt[places] >= 0]
        ranks = merges.of(tok[places], tok[nxt[places]])
        pair[places] = ranks
        places, ranks = places[ranks < _NONE], ranks[ranks < _NONE]
        if not len(places):
            return
        order = np.argsort(ranks, kind="stable")
        ranks, places = ranks[order], places[order]
        cuts = np.flatnonzero(np.diff(ranks)) + 1
        for r, group in zip(ranks[np.concatenate(([0], cuts))].tolist(), np.split(places, cuts), strict=True):
            if r not in index:
                index[r] = []
                heappush(heap, r)
            index[r].append(group)

    if n:
        enter(np.arange(n))
    while heap:
        r = heappop(heap)
        groups = index.pop(r)
        at = np.concatenate(groups) if len(groups) > 1 else groups[0]
        at = np.sort(at[alive[at] & (pair[at] == r)])
        if not len(at):
            continue
        if len(at) > 1:
            at = at[np.concatenate(([True], at[1:] != at[:-1]))]
        if len(at) > 1:  # of places that overlap in a row, the first, third, ... merge
            follows = np.zeros(len(at), bool)
            follows[1:] = nxt[at[:-1]] == at[1:]
            if follows.any():
                start = np.maximum.accumulate(np.where(follows, 0, np.arange(len(at))))
                skipped = at[(np.arange(len(at)) - start) % 2 == 1]
                at = at[(np.arange(len(at)) - start) % 2 == 0]
            else:
                skipped = at[:0]
        else:
            skipped = at[:0]
        gone = nxt[at]
        tok[at] = r
        alive[gone] = False
        after = nxt[gone]
        nxt[at] = after
        prv[after[after >= 0]] = at[after >= 0]
        pair[at] = _NONE
        before = prv[at]
        touched = np.concatenate([at, before[before >= 0], skipped[alive[skipped]]])  # a place may come twice
        enter(touched)
    starts = np.concatenate(([0], np.cumsum(np.add.reduceat(alive.astype(np.int64), (ends - lengths)[lengths > 0])) if n else np.zeros(0, np.int64)))
    if (lengths == 0).any():
        full = np.zeros(len(pieces), np.int64)
        full[lengths > 0] = np.diff(starts)
        starts = np.concatenate(([0], np.cumsum(full)))
    return tok[alive], starts


def chunks(text: str, awkward) -> list[str]:
    """The text cut before single spaces.  No piece crosses such a cut, and what stands before it doesn't change the
    pieces after it; a text with a space after other white space stays whole."""
    if awkward(text):
        return [text]
    first, *rest = text.split(" ")
    return [first, *[f" {x}" for x in rest]]


def encode_blocks(batches: Iterator[pa.RecordBatch], merges: Merges, pattern: str, block_chars: int = BLOCK_CHARS):
    """For each block: its keys, for each text the numbers of its chunks, and each distinct chunk's ids.

    The pieces of the pattern are found once for each distinct chunk, and encoded once for each distinct piece.
    ``\\s`` means the White_Space property, as in the rank file's own library.
    """
    space = r"\p{White_Space}"
    split = regex.compile(pattern.replace(r"\S", r"\P{White_Space}").replace(r"[^\s", rf"[^{space}").replace(r"\s", space)).findall
    awkward = regex.compile(rf"{space} ").search
    keys: list = []
    numbers: list[np.ndarray] = []
    known: dict[str, int] = {}
    held = 0

    def done():
        seen: dict[str, int] = {}
        parts = [[seen.setdefault(p, len(seen)) for p in split(c)] for c in known]
        ids, starts = replay([p.encode("utf-8", "surrogatepass") for p in seen], merges)
        ids, starts = ids.tolist(), starts.tolist()
        spans = [ids[a:b] for a, b in zip(starts[:-1], starts[1:], strict=True)]
        return keys, numbers, [spans[ps[0]] if len(ps) == 1 else [x for p in ps for x in spans[p]] for ps in parts]

    for batch in batches:
        for k, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            if held and held + len(t or "") > block_chars:
                yield done()
                keys, numbers, known, held = [], [], {}, 0
            keys.append(k)
            found = chunks(t or "", awkward)
            for c in found:
                if c not in known:
                    known[c] = len(known)
            numbers.append(np.fromiter(map(known.__getitem__, found), np.int32, len(found)))
            held += len(t or "")
    if keys:
        yield done()


def decode(ids, tokens: list[bytes]) -> bytes:
    return b"".join([tokens[i] for i in ids])


_LOADED: dict[str, Merges] = {}


def _merges(path: str) -> Merges:
    if path not in _LOADED:
        _LOADED[path] = Merges(load_ranks(path))
    return _LOADED[path]


def encoded(df: DataFrame, path: str, pattern: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per input row: the key and its ids (array<int>).  ``path`` is a rank file that every executor can open."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        merges = _merges(path)
        for keys, numbers, each in encode_blocks(batches, merges, pattern):
            for i in range(0, len(keys), 500):
                rows = [[x for p in ns.tolist() for x in each[p]] for ns in numbers[i : i + 500]]
                yield pa.record_batch([pa.array(keys[i : i + 500], kind_pa), pa.array(rows, pa.list_(pa.int32()))], names=["key", "ids"])

    own, kind, kind_pa = _own(df, key, text)
    return own.mapInArrow(run, f"key {kind}, ids array<int>").withColumnRenamed("key", key)


def digests(df: DataFrame, path: str, pattern: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per input row: the key, n_tokens, ids_sha256 and decoded_sha256, without carrying the ids out of the task.

    The ids of a text are those of its pieces in order, so their decimal texts and decoded bytes are made once for
    each distinct chunk of a block, from its ids.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        merges = _merges(path)
        for keys, numbers, each in encode_blocks(batches, merges, pattern):
            names = [b"%d" % i for i in range(len(merges.tokens))]
            said = [b" ".join([names[i] for i in ids]) for ids in each]
            back = [decode(ids, merges.tokens) for ids in each]
            count = np.array([len(ids) for ids in each], np.int64)
            sums = []
            for chosen in numbers:
                each_n = count[chosen]
                listed = (chosen[each_n > 0] if not each_n.all() else chosen).tolist()
                sums.append((int(each_n.sum()), hashlib.sha256(b" ".join([said[c] for c in listed])).hexdigest(), hashlib.sha256(b"".join([back[c] for c in listed])).hexdigest()))
            yield pa.record_batch(
                [pa.array(keys, kind_pa), pa.array([x[0] for x in sums], pa.int64()), pa.array([x[1] for x in sums]), pa.array([x[2] for x in sums])],
                names=["key", "n_tokens", "ids_sha256", "decoded_sha256"])

    own, kind, kind_pa = _own(df, key, text)
    return own.mapInArrow(run, f"key {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string").withColumnRenamed("key", key)


def _own(df: DataFrame, key: str, text: str):
    from pyspark.sql.pandas.types import to_arrow_type

    own = df.select(F.col(f"`{key}`").alias("key"), F.col(f"`{text}`").cast("string").alias("t"))
    kind = own.schema["key"].dataType
    return own, kind.simpleString(), to_arrow_type(kind)
