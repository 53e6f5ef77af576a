"""Workers' heartbeats: sums, queue depths, completion, partial upserts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

COUNTERS = ("init", "active_count", "rcount", "scount", "failure", "stop_order")


def summed(value: Column, name: str) -> Column:
    return F.coalesce(F.sum(value), F.lit(0)).cast("long").alias(name)


def totals(beats: DataFrame) -> DataFrame:
    return beats.agg(*(summed(F.col(k), k) for k in COUNTERS))


def completion(table: DataFrame, nodes: int, own: int) -> DataFrame:
    """One row: totals of a table of heartbeats (id and COUNTERS), own_failure (that of worker `own`) and the verdict."""
    found = table.agg(*(summed(F.col(k), k) for k in COUNTERS), summed(F.when(F.col("id") == own, F.col("failure")), "own_failure"))
    return found.withColumn("verdict", verdict(nodes, F.col("own_failure")))


def verdict(nodes: int, own_failure: Column) -> Column:
    """0 done, 1 own failure, 2 another's failure, 3 stopped by hand, null while work goes on; over totals()."""
    done = (F.col("active_count") == 0) & (F.col("rcount") == F.col("scount")) & (F.col("init") == nodes)
    return F.when(done, 0).when(own_failure > 0, 1).when(F.col("failure") > 0, 2).when(F.col("stop_order") > 0, 3)


def upserted(log: DataFrame, key: str, order: str) -> DataFrame:
    """The last value that each key was given in each column of an update log; null means not given."""
    rest = [x for x in log.columns if x not in (key, order)]
    return log.groupBy(key).agg(*(F.max_by(x, F.when(F.col(x).isNotNull(), F.col(order))).alias(x) for x in rest))


def queue_depths(tasks: DataFrame) -> DataFrame:
    return tasks.groupBy("host").agg(F.count("*").alias("depth"))


def latest(beats: DataFrame) -> DataFrame:
    """id, last, state, beats of each worker: its last beat (id, event_id, event_type), and how many there were."""
    return beats.groupBy("id").agg(F.max("event_id").alias("last"), F.max_by("event_type", "event_id").alias("state"), F.count("*").alias("beats"))
