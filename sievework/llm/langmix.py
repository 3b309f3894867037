"""Multilingual mixture inference.

A model holds the log likelihood of hashed letter trigrams under each labelled language.  A document's language
proportions come from expectation-maximisation over its trigrams; languages then leave the set, the least share
first, while the penalised likelihood (half a log of the trigrams per further language) improves.

Rows without text or label teach nothing.  A text that is null or has no letter gets ``und`` and score 0; so does
every text where no labelled row exists.  More than MAX_LANGUAGES labels raise a ValueError.  Equal texts get equal
results; ties go to the language that sorts first.  Only the columns named by the arguments are read.
"""
from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BUCKETS = 1 << 16
#: The model is L x 65,536 floats, broadcast; this bounds it at 64 MB.
MAX_LANGUAGES = 256
UNDETERMINED = "und"
_STEPS = 25


def _folded() -> tuple[np.ndarray, np.ndarray]:
    """For every code point: itself if it is a letter or mark (marks join letters, as in many scripts), else a space; and
    whether it is a letter."""
    kinds = [unicodedata.category(chr(i))[0] for i in range(0x110000)]
    kept = np.array([k in "LM" for k in kinds])
    return np.where(kept, np.arange(0x110000, dtype=np.uint32), np.uint32(32)), np.array([k == "L" for k in kinds])


_FOLD: list[tuple[np.ndarray, np.ndarray]] = []


def trigrams(text: str) -> np.ndarray:
    """The hashed letter trigrams of a whole text, each word bounded by one space; empty if it has no letter."""
    if not _FOLD:
        _FOLD.append(_folded())
    fold, letter = _FOLD[0]
    points = np.frombuffer(f" {text.lower()} ".encode("utf-32-le", "surrogatepass"), np.uint32)
    if not letter[points].any():
        return np.empty(0, np.int64)
    points = fold[points]
    space = points == 32
    keep = np.ones(len(points), bool)
    keep[1:] = ~(space[1:] & space[:-1])
    points = points[keep]
    if len(points) < 3:
        return np.empty(0, np.int64)
    mixed = (points[:-2] * np.uint32(0x9E3779B1)) ^ (points[1:-1] * np.uint32(0x85EBCA6B)) ^ (points[2:] * np.uint32(0xC2B2AE35))
    mixed = (mixed ^ (mixed >> np.uint32(15))) * np.uint32(0x2C1B3C6D)
    return (mixed >> np.uint32(16)).astype(np.int64)


def learn(labelled: DataFrame, text: str = "text", lang: str = "lang") -> tuple[list[str], np.ndarray]:
    """Languages in sorted order and the (L, 65,536) log likelihoods, from every row that has a text and a label.

    Each task sums its rows into one dense vector for each language, so the shuffle holds at most L x 65,536 rows from
    a task whatever the rows; the model that reaches the driver has the size of MAX_LANGUAGES at most.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        waiting: dict[str, list[np.ndarray]] = {}
        for batch in batches:
            for t, k in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if k not in sums and len(sums) >= MAX_LANGUAGES:
                    raise ValueError(f"more than {MAX_LANGUAGES} languages")
                sums.setdefault(k, np.zeros(BUCKETS, np.int64))
                held = waiting.setdefault(k, [])
                held.append(trigrams(t))
                if len(held) >= 200:
                    sums[k] += np.bincount(np.concatenate(held), minlength=BUCKETS)
                    held.clear()
        for k, v in sums.items():
            v += np.bincount(np.concatenate([*waiting[k], np.empty(0, np.int64)]), minlength=BUCKETS)
            at = np.flatnonzero(v)
            yield pa.record_batch([pa.array([k] * len(at), pa.string()), pa.array(at, pa.int32()), pa.array(v[at], pa.int64())], names=["lang", "gram", "n"])

    rows = labelled.select(F.col(f"`{text}`").alias("t"), F.col(f"`{lang}`").alias("k")).dropna()
    counts = rows.mapInArrow(count, "lang string, gram int, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n")).toArrow()
    names = sorted(set(counts.column("lang").to_pylist()))
    if len(names) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages")
    table = np.zeros((len(names), BUCKETS), np.float64)
    if names:
        place = {k: i for i, k in enumerate(names)}
        np.add.at(table, ([place[k] for k in counts.column("lang").to_pylist()], counts.column("gram").to_numpy()), counts.column("n").to_numpy())
        table += 0.1
        table = np.log(table / table.sum(1, keepdims=True))
    return names, table.astype(np.float32)


def _em(like: np.ndarray, n: np.ndarray, share: np.ndarray) -> tuple[np.ndarray, float]:
    """like: (languages, grams), n: occurrences.  The proportions and the log likelihood, up to a constant of the text."""
    total = n.sum()
    for _ in range(_STEPS):
        mix = share @ like
        new = share * (like @ (n / mix)) / total
        moved = np.abs(new - share).max()
        share = new
        if moved < 1e-3:
            break
    return share, float(n @ np.log(share @ like))


def mixture(grams: np.ndarray, table: np.ndarray) -> np.ndarray:
    """The proportions of all languages, 0 for those outside the selected set."""
    ids, n = np.unique(grams, return_counts=True)
    logs = table[:, ids]
    like = np.exp(logs - logs.max(0)).astype(np.float64)
    n = n.astype(np.float64)
    held = np.arange(len(table))
    share, fit = _em(like, n, np.full(len(held), 1 / len(held)))
    price = 0.5 * np.log(n.sum() + 1)
    small = share < 0.02
    if small.any() and not small.all():
        held, share = held[~small], share[~small] / share[~small].sum()
        share, fit = _em(like[held], n, share)
    while len(held) > 1:
        rest = np.delete(np.arange(len(held)), int(np.argmin(share)))
        less, worse = _em(like[held[rest]], n, share[rest] / share[rest].sum())
        if worse + price < fit:
            break
        held, share, fit = held[rest], less, worse
    out = np.zeros(len(table))
    out[held] = share
    return out


def _judged(texts: list[str | None], names: list[str], logs: np.ndarray) -> tuple[list[str], list[float], list[list[dict]]]:
    best, points, sets = [], [], []
    for t in texts:
        grams = trigrams(t) if t and names else ()
        if not len(grams):
            best.append(UNDETERMINED), points.append(0.0), sets.append([])
            continue
        share = mixture(grams, logs)
        top = int(np.argmax(share))
        best.append(names[top])
        points.append(float((share[top] * len(grams) + 0.5) / (len(grams) + 0.5 * len(names))))
        sets.append([{"lang": names[i], "share": float(share[i])} for i in np.argsort(-share, kind="stable") if share[i] > 0])
    return best, points, sets


def predict(df: DataFrame, model: tuple[list[str], np.ndarray], key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per input row: the key, lang_pred, score and the selected languages with their proportions."""
    names, table = model
    shared = df.sparkSession.sparkContext.broadcast(table)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            best, points, sets = _judged(batch.column(1).to_pylist(), names, shared.value)
            yield pa.record_batch(
                [batch.column(0), pa.array(best, pa.string()), pa.array(points, pa.float64()), pa.array(sets, pa.list_(pa.struct([("lang", pa.string()), ("share", pa.float64())])))],
                names=["key", "lang_pred", "score", "languages"])

    own = df.select(F.col(f"`{key}`").alias("key"), F.col(f"`{text}`").alias("t"))
    kind = own.schema["key"].dataType.simpleString()
    return own.mapInArrow(score, f"key {kind}, lang_pred string, score double, languages array<struct<lang:string,share:double>>").withColumnRenamed("key", key)


def clear_only(df: DataFrame, model: tuple[list[str], np.ndarray], least: float, text: str = "text") -> DataFrame:
    """The rows of df whose text has a language with a score of ``least`` or more; every column stays as it is."""
    names, table = model
    shared = df.sparkSession.sparkContext.broadcast(table)
    at = df.columns.index(text)

    def chosen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 1000):
                part = batch.slice(start, 1000)
                best, points, _ = _judged(part.column(at).to_pylist(), names, shared.value)
                yield part.filter(pa.array([b != UNDETERMINED and p >= least for b, p in zip(best, points, strict=True)], pa.bool_()))

    return df.mapInArrow(chosen, df.schema)
