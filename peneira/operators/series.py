"""Windows over runs and states: anomalies, first seen, round robin, stage dates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

COUNTABLE = ["SUCCESS", "PARTIAL", "EMPTY"]


def count_anomalies(runs: DataFrame, ratio: float = 0.5, keep: int = 10, least: int = 2) -> DataFrame:
    """runs (source, run, status, n) with the mean of the last countable counts before each and a warning: ZERO if there
    were some and now none, DROP if fewer than ratio times the mean. A failed run is judged but not counted later.

    One sort by source and run; the frame of a run is the last counts kept in a
    running array, so failed runs look the counts up as of their time.
    """
    good = F.col("status").isin(COUNTABLE)
    w = Window.partitionBy("source").orderBy("run")
    ranked = runs.withColumn("g_", F.sum(F.when(good, 1).otherwise(0)).over(w))
    frame = Window.partitionBy("source").orderBy("g_").rangeBetween(-keep, -1)
    # A good run's number is its own count; a failed one shares the number of the good run before it, which it must see.
    position = F.when(good, F.col("g_")).otherwise(F.col("g_") + 1)
    placed = ranked.withColumn("g_", position)
    value = F.when(good, F.col("n"))
    judged = placed.withColumn("mean", F.avg(value).over(frame)).withColumn("seen", F.count(value).over(frame))
    enough = F.col("seen") >= least
    warning = F.when(enough & (F.col("mean") > 0) & (F.col("n") == 0), "ZERO").when(enough & (F.col("n") < F.col("mean") * ratio), "DROP")
    return judged.withColumn("warning", warning).drop("g_")


def first_seen(events: DataFrame, key: str, at: str, state: DataFrame | None = None) -> DataFrame:
    """(key, first_seen, is_new) of every key: the earliest time in state or events. New are keys the state lacks, unless it is empty."""
    now = events.groupBy(key).agg(F.min(at).alias("first_seen"))
    if state is None or state.isEmpty():
        return now.withColumn("is_new", F.lit(False))
    joined = now.join(state.select(key, F.col("first_seen").alias("s_")), key, "full")
    return joined.select(key, F.least("s_", "first_seen").alias("first_seen"), F.col("s_").isNull().alias("is_new"))


def round_robin(rows: DataFrame, group: str, order: str, priority: Column, penalty: Column, limit: int) -> DataFrame:
    """The first rows by priority, penalty and their turn within the group, so that no group takes the whole budget.
    Rows without a priority take no part. The limit is the budget."""
    ranked = rows.withColumn("priority", priority).where("priority is not null").withColumn("penalty", penalty)
    turn = F.row_number().over(Window.partitionBy(group).orderBy(order)) - 1
    return ranked.withColumn("turn", turn).orderBy("priority", "penalty", "turn", order).limit(limit)


def evicted(state: DataFrame, at: str, key: str, capacity: int = 200_000) -> DataFrame:
    """The newest entries of a state table within its capacity."""
    return state.orderBy(F.col(at).desc(), key).limit(capacity)


def stage_dates(events: DataFrame, key: str, stage: str, at: str) -> DataFrame:
    """The first time each key reached each stage."""
    return events.groupBy(key, stage).agg(F.min(at).alias("reached"))


def last_stage(events: DataFrame, key: str, stage: str, at: str, tie: str) -> DataFrame:
    """The stage each key is in now; of simultaneous events the one with the greatest tie."""
    return events.groupBy(key).agg(F.max_by(stage, F.struct(at, tie)).alias("stage"))


def dealt(rows: DataFrame, order: str, workers: int) -> DataFrame:
    """rows dealt to workers in turn."""
    return rows.withColumn("worker", (F.row_number().over(Window.orderBy(order)) - 1) % workers)
