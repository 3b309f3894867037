"""A stored table of rows by key, in partitions and buckets, that changes only where a change falls.

Rows lie in folders by one column and by a hash of the key.  A change reads and rewrites the folders it touches (dynamic
partition overwrite); which these are is one row a folder, so the driver sees at most partitions x buckets values.
"""
from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import staging
from .maintenance import GUARD_SHARE

BUCKET = "key_bucket"


@dataclass(frozen=True)
class Store:
    spark: SparkSession
    path: str
    schema: str
    key: str
    part: str
    buckets: int = 16

    def _with_bucket(self, rows: DataFrame) -> DataFrame:
        return rows.withColumn(BUCKET, F.pmod(F.xxhash64(self.key), F.lit(self.buckets)).cast("int"))

    def _write(self, rows: DataFrame, mode: str) -> None:
        laid = self._with_bucket(rows).repartition(self.part, BUCKET)
        laid.write.mode("overwrite").option("partitionOverwriteMode", mode).partitionBy(self.part, BUCKET).parquet(self.path)

    def create(self, rows: DataFrame) -> None:
        self._write(rows, "static")

    def read(self) -> DataFrame:
        columns = [c for c in self.spark.createDataFrame([], self.schema).columns]
        return self._files().select(*columns)

    def _files(self) -> DataFrame:
        return self.spark.read.schema(f"{self.schema}, {BUCKET} int").parquet(self.path)

    def touched(self, rows: DataFrame) -> list[tuple]:
        """The folders in which rows of this table would lie."""
        return [tuple(r) for r in self._with_bucket(rows).select(self.part, BUCKET).distinct().collect()]

    def within(self, folders: list[tuple]) -> DataFrame:
        """The rows of some folders: only these are listed and read."""
        where: Column = F.lit(False)
        for value in {v for v, _ in folders}:
            where = where | (F.col(self.part).eqNullSafe(F.lit(value)) & F.col(BUCKET).isin(*[b for v, b in folders if v == value]))
        return self._files().filter(where).drop(BUCKET)

    def upsert(self, source: DataFrame, written: list[str]) -> None:
        """Rows of ``source`` (key, partition column and the written columns, one row a key) win in what they write; other columns
        of a row stay, and are null in a new one.  A key's partition value must not change."""
        source = staging.written(source)
        old = self.within(self.touched(source))
        new = source.select(self.key, self.part, F.struct(*written).alias("_sw_new"))
        both = old.join(new, [self.key, self.part], "full_outer")
        value = lambda c: F.when(F.col("_sw_new").isNotNull(), F.col("_sw_new").getField(c)).otherwise(F.col(c)).alias(c)
        self._write(both.select(*[value(c) if c in written else F.col(c) for c in old.columns]), "dynamic")

    def delete(self, doomed: Column, scope: Column, guard: float = GUARD_SHARE, helper: DataFrame | None = None, on: str = "") -> bool:
        """Doomed rows go, unless they are more than the guard's share of the scope; whether they went.

        ``helper`` is joined from the left on a column before the condition is read (what a run saw, say)."""
        rows = self._files() if helper is None else self._files().join(helper, on, "left")
        flag = F.coalesce(doomed, F.lit(False))
        counts = rows.groupBy(self.part, BUCKET).agg(F.count_if(flag).alias("gone"), F.count_if(F.coalesce(scope, F.lit(False))).alias("all"), F.count("*").alias("n")).collect()
        gone = sum(r.gone for r in counts)
        if gone > guard * sum(r["all"] for r in counts):
            return False
        folders = [(r[self.part], r[BUCKET]) for r in counts if r.gone]
        if folders:
            some = self.within(folders)
            joined = some if helper is None else some.join(helper, on, "left")
            kept = staging.written(joined.filter(~flag).select(*some.columns))
            self._write(kept, "dynamic")
            self._drop([(r[self.part], r[BUCKET]) for r in counts if r.gone == r.n])
        return True

    def _drop(self, folders: list[tuple]) -> None:
        """Folders that no row is left for: an overwrite by no rows would leave them as they are."""
        fs = self.spark.sparkContext._jvm.org.apache.hadoop.fs
        for value, bucket in folders:
            path = fs.Path(f"{self.path}/{self.part}={value}/{BUCKET}={bucket}")
            path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)

    def truncate(self) -> None:
        """All rows go; the table stays, with its columns."""
        self._write(self.spark.createDataFrame([], self.schema), "static")
