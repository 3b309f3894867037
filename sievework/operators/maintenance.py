"""Keeping the table: upserts, guarded sweeps and purges, null-outs, the application log."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

GUARD_SHARE = 0.25


def upsert(target: DataFrame, source: DataFrame, key: str, written: list[str]) -> DataFrame:
    """The source's rows win for the columns it writes, even with nulls; all others keep the target's values.  The source
    must have one row for each key (see ``latest``)."""
    new = source.select(F.col(key), F.struct(*written).alias("_sw_new"))
    both = target.join(new, key, "full_outer")
    value = lambda c: F.when(F.col("_sw_new").isNotNull(), F.col("_sw_new").getField(c)).otherwise(F.col(c)).alias(c)
    return both.select(*[value(c) if c in written else F.col(c) for c in target.columns])


def latest(rows: DataFrame, key: str, order: list[Column]) -> DataFrame:
    """The last row of each key."""
    return rows.withColumn("_sw_place", F.row_number().over(Window.partitionBy(key).orderBy(*order))).filter("_sw_place = 1").drop("_sw_place")


def guarded_delete(rows: DataFrame, doomed: Column, guard: float = GUARD_SHARE, scope: Column | None = None) -> DataFrame:
    """The rows without the doomed, unless those are more than the guard's share of the scope: then all stay.

    The share is one row of counts, joined to every row by broadcast; a null condition does not doom.
    """
    flag = F.coalesce(doomed, F.lit(False))
    counted = F.coalesce(scope, F.lit(False)) if scope is not None else F.lit(True)
    share = rows.agg((F.count_if(flag) > guard * F.count_if(counted)).alias("_sw_stop"))
    return rows.crossJoin(F.broadcast(share)).filter(~flag | F.col("_sw_stop")).drop("_sw_stop")


def stale_sweep(jobs: DataFrame, answered: DataFrame, source: str, run_start: str, guard: float = GUARD_SHARE) -> DataFrame:
    """Jobs of one source whose slug answered in this run but which the run did not meet go, behind the guard."""
    marked = jobs.join(answered.select("slug").distinct().withColumn("_sw_answered", F.lit(True)), "slug", "left")
    doomed = (F.col("ats") == source) & F.col("_sw_answered") & (F.col("fetched_at") < F.expr(f"timestamp_ntz '{run_start}'"))
    return guarded_delete(marked, doomed, guard, F.col("ats") == source).select(*jobs.columns)


def age_purge(jobs: DataFrame, cutoff: str, guard: float = GUARD_SHARE) -> DataFrame:
    """Dated jobs from before the cutoff go, behind the guard; undated ones stay."""
    return guarded_delete(jobs, F.col("posted_at") < F.expr(f"timestamp_ntz '{cutoff}'"), guard)


def null_out(jobs: DataFrame, columns: list[str], limit: int) -> DataFrame:
    return jobs.withColumns({c: F.when(F.col(c) <= limit, F.col(c)) for c in columns})


def hide_applied(jobs: DataFrame, log: DataFrame) -> DataFrame:
    return jobs.join(log.filter("status = 'applied'").select(F.col("job_id").alias("id")), "id", "left_anti")
