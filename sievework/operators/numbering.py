"""Global row numbers without a task that sees all rows, and samples spread by them."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import staging

#: monotonically_increasing_id holds the partition above this many bits.
_SHIFT = 33


def numbered(rows: DataFrame, order: list[Column], name: str = "row_number") -> DataFrame:
    """rows with their number (from 0) in a total order.

    Ranges of the order are sorted apart and written; a range's first number is the count of the ranges ahead of it, one
    row for each range."""
    laid = staging.written(rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_sw_id", F.monotonically_increasing_id()))
    part = F.shiftright("_sw_id", _SHIFT)
    counts = {r.p: r.n for r in laid.groupBy(part.alias("p")).agg(F.count("*").alias("n")).collect()}
    total, starts = 0, []
    for p in sorted(counts):
        starts.append((p, total))
        total += counts[p]
    first = laid.sparkSession.createDataFrame(starts, "_sw_p long, _sw_first long")
    inner = F.col("_sw_id") - F.shiftleft("_sw_p", _SHIFT)
    return laid.withColumn("_sw_p", part).join(F.broadcast(first), "_sw_p").withColumn(name, F.col("_sw_first") + inner).drop("_sw_p", "_sw_first", "_sw_id")


def spread(rows: DataFrame, order: list[Column], group: str, every: int = 7, most: int = 5) -> DataFrame:
    """Up to ``most`` rows of each group, from every ``every``-th row of the whole table in order; a group that those miss
    gives its first row."""
    all_rows = numbered(rows, order)
    some = all_rows.filter(F.col("row_number") % every == 0)
    ahead = Window.partitionBy(group).orderBy("row_number")
    chosen = some.withColumn("_sw_place", F.row_number().over(ahead)).filter(F.col("_sw_place") <= most).drop("_sw_place")
    missed = all_rows.join(chosen.select(group).distinct(), group, "left_anti").groupBy(group).agg(F.min("row_number").alias("row_number"))
    return chosen.unionByName(all_rows.join(missed, [group, "row_number"], "left_semi").select(chosen.columns))


def by_rules(rows: DataFrame, text: str, rules: DataFrame, label: str, default: str) -> DataFrame:
    """text and label of each different text: that of the least rule number whose pattern it matches.

    rules: number, pattern, label: a table, so that a rule changes without code.  Rules are few and are broadcast; every
    different text meets each of them once.
    """
    texts = rows.select(text).distinct()
    met = texts.join(F.broadcast(rules), F.expr(f"{text} rlike pattern"), "left")
    return met.groupBy(text).agg(F.coalesce(F.min_by("label", "number"), F.lit(default)).alias(label))
