"""Conflict-constrained best-fit packing of documents into fixed windows.

A document of n words takes n + 1 tokens (its end counts).  Whole windows are cut off long documents and stand
alone; what is left of each document is packed.  Items are dealt into shards by a hash of their key, so every task
packs a bounded number; within a shard the largest item goes first into the open bin of the least sufficient room
whose source bitmap and duplicate-cluster bitmap both miss the item's bits.  Where the tightest bin conflicts, the
search goes on to its successor in residual order until a compatible bin is found, else a bin is opened.

Null text: one token (the end).  Null source or cluster: conflicts with nothing.  Repeated rows are packed as
often as they occur; they share a cluster, so never a bin.  Equal sizes go by key.  An empty table gives no rows.
"""
from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WHITE, ascii_lower, blocks_for

CAPACITY = 2048
SHARD_ITEMS = 4096


def best_fit(sizes: list[int], sources: list, clusters: list, capacity: int) -> tuple[list[int], list[int]]:
    """The bin and the place in it of each item, given in the order of packing."""
    open_bins: list[tuple[int, int]] = []
    bits: dict = {}
    source_map: list[int] = []
    cluster_map: list[int] = []
    where, at = [], []
    for size, source, cluster in zip(sizes, sources, clusters, strict=True):
        s = 0 if source is None else 1 << bits.setdefault(("s", source), len(bits))
        c = 0 if cluster is None else 1 << bits.setdefault(("c", cluster), len(bits))
        i = bisect_left(open_bins, (size, -1))
        while i < len(open_bins) and (source_map[open_bins[i][1]] & s or cluster_map[open_bins[i][1]] & c):
            i += 1
        if i == len(open_bins):
            room, b = capacity, len(source_map)
            source_map.append(0)
            cluster_map.append(0)
        else:
            room, b = open_bins.pop(i)
        where.append(b)
        at.append(capacity - room)
        source_map[b] |= s
        cluster_map[b] |= c
        if room > size:
            insort(open_bins, (room - size, b))
    return where, at


def items_of(df: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """key, source, cluster (equal word sequences share one) and n_tokens."""
    spaced = F.translate(F.coalesce(F.col(f"`{text}`"), F.lit("")), WHITE[1:], " " * (len(WHITE) - 1))
    words = F.array_remove(F.split(spaced, " "), "")
    own = df.select(F.col(f"`{key}`").alias("key"), F.col(f"`{source}`").cast("string").alias("source"), words.alias("words"))
    return own.select("key", "source", F.xxhash64(ascii_lower(F.array_join("words", " "))).alias("cluster"), (F.size("words") + 1).cast("long").alias("n_tokens"))


def pack(items: DataFrame, capacity: int = CAPACITY, shard_items: int = SHARD_ITEMS) -> DataFrame:
    """items: key, source, cluster, n_tokens (1 at least).  One row per piece: key, piece, start (token in the document),
    n_tokens, bin_id, bin_start.

    bin_id is shard * 2^32 + the bin in its shard, or for a whole window -1 - (hash of key and piece), as text.
    """
    shards = blocks_for(items.count(), shard_items)
    pieces = items.select("*", F.expr(f"explode(sequence(0L, cast((n_tokens - 1) div {capacity} as long)))").alias("piece"))
    pieces = pieces.withColumns({"start": F.col("piece") * capacity, "n_tokens": F.least(F.lit(capacity), F.col("n_tokens") - F.col("piece") * capacity)})
    whole = pieces.filter(F.col("n_tokens") == capacity).select(
        "key", "piece", "start", "n_tokens", F.concat_ws("-", F.lit("w"), F.col("key").cast("string"), F.col("piece").cast("string")).alias("bin_id"), F.lit(0).cast("long").alias("bin_start"))
    kind = items.schema["key"].dataType.simpleString()

    def shard_bins(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["n_tokens", "key", "source"], ascending=[False, True, True], kind="stable", na_position="last")
        missing = group["source"].isna().tolist()
        sources = [None if m else s for s, m in zip(group["source"].tolist(), missing, strict=True)]
        clusters = [None if pd.isna(c) else int(c) for c in group["cluster"].tolist()]
        bins, at = best_fit(group["n_tokens"].astype(int).tolist(), sources, clusters, capacity)
        return pd.DataFrame({"key": group["key"], "piece": group["piece"], "start": group["start"], "n_tokens": group["n_tokens"], "bin_id": [f"{key[0]}-{b}" for b in bins], "bin_start": at})

    rest = pieces.filter(F.col("n_tokens") < capacity).withColumn("cluster", F.col("cluster").cast("string"))
    # rows without a key are dealt by what else they have: a constant hash would give all of them to one task
    dealt = F.when(F.col("key").isNull(), F.xxhash64("source", "cluster", "n_tokens")).otherwise(F.xxhash64("key"))
    rest = rest.withColumn("shard", F.pmod(dealt, F.lit(shards)))
    packed = rest.groupBy("shard").applyInPandas(shard_bins, f"key {kind}, piece long, start long, n_tokens long, bin_id string, bin_start long")
    return whole.unionByName(packed)


def pack_documents(df: DataFrame, capacity: int = CAPACITY, key: str = "doc_id", text: str = "text", source: str = "source", clusters: DataFrame | None = None) -> DataFrame:
    """``clusters`` (the key, component_id: what near_duplicates gives) makes near copies share a cluster; without it equal
    word sequences do."""
    items = items_of(df, key, text, source)
    if clusters is not None:
        near = clusters.select(F.col(f"`{key}`").alias("key"), F.col("component_id").alias("near")).dropDuplicates(["key"])
        items = items.join(near, "key", "left").withColumn("cluster", F.coalesce("near", "cluster")).drop("near")
    return pack(items, capacity).withColumnRenamed("key", key)
