"""Centroid clustering of integer vectors, with partial-distance search.

A vector's components become floor(256 * x).  The vectors whose hash comes first are the first centroids; each round
assigns every vector to its nearest one (ties: the smaller number) and moves every centroid to the floor of the mean.

The nearest centroid is searched by partial distances: the squared differences of a few dimensions at a time are added
up, those of the highest variance first.  The centroid with the least sum after the first of them is finished at once,
which gives a best distance to hold the others against; a centroid is abandoned when its sum so far is strictly above
the current best, and the survivors finish all dimensions, so the result is that of a full search, ties included.

Vectors are read in Arrow batches, never gathered: a round's shuffle holds one row of sums for each task and centroid, and
the driver sees only the centroids and the moments of the dimensions (k x 64 and 2 x 64 numbers).

Left out, because they have no place or no exact distance: vectors that are null, of another length, or with a null or
non-finite component, and those with a component of more than 2^27 after scaling (a squared distance would not fit a
long).  Repeated rows count as often as they occur.  A null id never starts a centroid; its vector is assigned like any
other.  With fewer vectors than centroids each row starts one.  An empty table gives an empty result.  Ids are whole
numbers; others raise a TypeError.  Only the id and the vector are read.
"""
from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import long_key, materialise

DIMS = 64
CENTROIDS = 40
ROUNDS = 5
SALT = "2"
SCALE = 256
LARGEST = 1 << 27
#: Dimensions whose differences are added between two looks at the survivors.
STEP = 8
#: Vectors of a batch that are searched together: 4096 x 40 x 8 differences at most are held.
TOGETHER = 4096


def integers(df: DataFrame, key: str = "vec_id", vector: str = "embedding", dims: int = DIMS) -> DataFrame:
    """key, v (array of integers) of the vectors that count."""
    own = df.select(long_key(df, key).alias("key"), F.col(f"`{vector}`").cast("array<double>").alias("v"))
    whole = own.filter((F.size("v") == dims) & ~F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) > LARGEST / SCALE)))
    return whole.select("key", F.transform("v", lambda x: F.floor(x * SCALE).cast("int")).alias("v"))


def nearest(v: np.ndarray, centroids: np.ndarray, order: np.ndarray, step: int = STEP) -> tuple[np.ndarray, np.ndarray, int]:
    """The number of the nearest centroid of each row, its squared distance, and how many differences were added."""
    n, k, dims = len(v), len(centroids), v.shape[1]
    v, c = v[:, order], centroids[:, order]
    head = ((v[:, None, :step] - c[None, :, :step]) ** 2).sum(2)
    first = head.argmin(1)
    best = head[np.arange(n), first] + ((v[:, step:] - c[first, step:]) ** 2).sum(1)
    work = n * k * min(step, dims) + n * max(0, dims - step)
    row, number = np.nonzero(head <= best[:, None])
    rest = number != first[row]
    row, number = row[rest], number[rest]
    partial = head[row, number]
    for at in range(step, dims, step):
        partial = partial + ((v[row, at : at + step] - c[number, at : at + step]) ** 2).sum(1)
        work += len(row) * min(step, dims - at)
        alive = partial <= best[row]
        row, number, partial = row[alive], number[alive], partial[alive]
    # of the survivors, all at or below the first best: the least distance, then the smallest number
    own = best.copy()
    np.minimum.at(best, row, partial)
    found = np.where(own == best, first, k)
    tied = partial == best[row]
    np.minimum.at(found, row[tied], number[tied])
    return found, best, work


def _batches(batches: Iterator[pa.RecordBatch], dims: int) -> Iterator[tuple[pa.Array, np.ndarray]]:
    for batch in batches:
        for at in range(0, batch.num_rows, TOGETHER):
            piece = batch.slice(at, TOGETHER)
            yield piece.column("key"), piece.column("v").flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(-1, dims)


def _order(vectors: DataFrame, dims: int) -> np.ndarray:
    """The dimensions by falling variance over all vectors."""

    def moments(batches):
        n, sums, squares = 0, np.zeros(dims), np.zeros(dims)
        for _, v in _batches(batches, dims):
            n, sums, squares = n + len(v), sums + v.sum(0), squares + (v.astype(float) ** 2).sum(0)
        yield pa.record_batch([pa.array([n], pa.int64()), pa.array([sums.tolist()]), pa.array([squares.tolist()])], names=["n", "s", "q"])

    parts = vectors.mapInArrow(moments, "n long, s array<double>, q array<double>").filter("n > 0")
    row = parts.agg(F.sum("n").alias("n"), F.array(*(F.sum(F.col("s")[i]) for i in range(dims))).alias("s"), F.array(*(F.sum(F.col("q")[i]) for i in range(dims))).alias("q")).first()
    if not row.n:
        return np.arange(dims)
    mean = np.array(row.s) / row.n
    return np.argsort(-(np.array(row.q) / row.n - mean**2), kind="stable")


def _moved(vectors: DataFrame, centroids: list[list[int]], order: np.ndarray, dims: int) -> list[list[int]]:
    """The centroids after one round."""
    shared = vectors.sparkSession.sparkContext.broadcast((np.array(centroids, np.int64), order))

    def sums(batches):
        c, by = shared.value
        n, total = np.zeros(len(c), np.int64), np.zeros((len(c), dims), np.int64)
        for _, v in _batches(batches, dims):
            found, _, _ = nearest(v, c, by)
            n += np.bincount(found, minlength=len(c))
            np.add.at(total, found, v)
        some = np.nonzero(n)[0]
        yield pa.record_batch([pa.array(some, pa.int32()), pa.array(n[some], pa.int64()), pa.array(total[some].tolist(), pa.list_(pa.int64()))], names=["cluster", "n", "s"])

    parts = vectors.mapInArrow(sums, "cluster int, n long, s array<long>")
    # decimals: the sum over all tasks is exact whatever the number of vectors
    rows = parts.groupBy("cluster").agg(F.sum(F.col("n").cast("decimal(38,0)")).alias("n"), F.array(*(F.sum(F.col("s")[i].cast("decimal(38,0)")) for i in range(dims))).alias("s")).collect()
    out = list(centroids)
    for r in rows:
        out[r.cluster] = [int(x) // int(r.n) for x in r.s]
    return out


def cluster(df: DataFrame, key: str = "vec_id", vector: str = "embedding", centroids: int = CENTROIDS, rounds: int = ROUNDS, dims: int = DIMS, salt: str = SALT) -> DataFrame:
    """One row per vector that counts: the key, cluster, distance, cluster_inertia, inertia and centroid_sha256."""
    spark = df.sparkSession
    vectors = materialise(integers(df, key, vector, dims))
    hashed = vectors.filter("key is not null").withColumn("hash", F.sha2(F.concat(F.lit(f"{salt}:"), F.col("key").cast("string")), 256))
    current = [list(r.v) for r in hashed.orderBy("hash", "v").limit(centroids).collect()]
    if not current:
        current = [list(r.v) for r in vectors.orderBy("v").limit(1).collect()]
    if not current:
        return spark.createDataFrame([], f"`{key}` long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string")
    order = _order(vectors, dims)
    for _ in range(rounds):
        current = _moved(vectors, current, order, dims)
    shared = spark.sparkContext.broadcast((np.array(current, np.int64), order))

    def assign(batches):
        c, by = shared.value
        for keys, v in _batches(batches, dims):
            found, best, _ = nearest(v, c, by)
            yield pa.record_batch([keys, pa.array(found, pa.int32()), pa.array(best, pa.int64())], names=["key", "cluster", "distance"])

    found = materialise(vectors.mapInArrow(assign, "key long, cluster int, distance long"))
    totals = {r.cluster: r.s for r in found.groupBy("cluster").agg(F.sum("distance").alias("s")).collect()}  # k rows at most
    known = [(i, s, sum(totals.values()), hashlib.sha256(",".join(map(str, current[i])).encode()).hexdigest()) for i, s in totals.items()]
    known = spark.createDataFrame(known, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return found.join(F.broadcast(known), "cluster").select(F.col("key").alias(key), "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
