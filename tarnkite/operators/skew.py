"""Joins and orders in which one key may have a third of all rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..sources.tables import stored

#: Parts that a key's rows are dealt out to.
SALTS = 32


def dealt_join(rows: DataFrame, other: DataFrame, keys: list[str], spread: Column, how: str = "inner", salts: int = SALTS) -> DataFrame:
    """rows joined with `other`, of which each row stands once in each part: for an `other` that has one narrow row a key, and is much smaller than rows.

    spread is hashed to the part of a row, and should differ between the rows of a key.
    """
    parts = other.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return rows.withColumn("_salt", F.pmod(F.xxhash64(spread), F.lit(salts)).cast("int")).join(parts, [*keys, "_salt"], how).drop("_salt")


def in_ranges(rows: DataFrame, *by: str) -> DataFrame:
    """rows, stored in the order of the columns `by`, with _at, that order as a number, and _part, a range of it that one task can hold."""
    placed = stored(rows.orderBy(*by).withColumn("_at", F.monotonically_increasing_id()), "ranges")
    return placed.withColumn("_part", F.shiftright("_at", 33))


def carried(ranged: DataFrame, key: str, value: Column, name: str, itself: bool) -> DataFrame:
    """ranged, of in_ranges(key, ...), with the last value that is not null among the rows of its key before each row, or up to it (itself).

    In two levels: inside a range, and from the last values of the ranges before.
    """
    rows = ranged.withColumn("_v", value)
    last = rows.groupBy(key, "_part").agg(F.max_by("_v", F.when(F.col("_v").isNotNull(), F.col("_at"))).alias("_end"))
    before = F.last("_end", ignorenulls=True).over(W.partitionBy(key).orderBy("_part").rowsBetween(W.unboundedPreceding, -1))
    last = last.select(F.col(key).alias("_key"), F.col("_part").alias("_range"), before.alias("_before"))
    near = F.last("_v", ignorenulls=True).over(W.partitionBy(key, "_part").orderBy("_at").rowsBetween(W.unboundedPreceding, 0 if itself else -1))
    rows = rows.withColumn("_near", near).join(last, (F.col(key).eqNullSafe(F.col("_key"))) & (F.col("_part") == F.col("_range")))
    return rows.select(*ranged.columns, F.coalesce("_near", "_before").alias(name))
