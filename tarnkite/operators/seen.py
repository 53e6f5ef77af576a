"""Which URLs were seen before: a blocked Bloom filter that is a table, kept between runs and merged with what a run adds."""

from __future__ import annotations

import json
import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import Text, as_column

#: Bits that a value sets in its block of 256, one in each 32; words that a block is stored as.
LANES, WORDS = 8, ("w0", "w1", "w2", "w3")
#: URLs and rate of false positives that a filter is made for.
CAPACITY, ERROR = 10_000_000, 0.001


def blocks_for(capacity: int, error: float = ERROR) -> int:
    """How many blocks hold `capacity` values at a rate of false positives of at most about `error`: blocks fill unevenly, so half of it is planned for."""
    bits = -LANES / math.log(1 - (error / 2) ** (1 / LANES))
    return max(1, math.ceil(capacity * bits / 256))


def block(value: Text, blocks: int) -> Column:
    return F.pmod(F.xxhash64(as_column(value)), F.lit(blocks).cast("long"))


def words(value: Text) -> list[Column]:
    """The bits that a value sets in its block."""
    marks = F.xxhash64(as_column(value), F.lit(1))
    bit = lambda k: F.shiftrightunsigned(marks, 5 * k).bitwiseAND(F.lit(31)).cast("int") + 32 * (k % 2)
    one = lambda k: F.call_function("shiftleft", F.lit(1).cast("long"), bit(k))
    return [one(2 * k).bitwiseOR(one(2 * k + 1)).alias(w) for k, w in enumerate(WORDS)]


def bloom(values: DataFrame, column: str, blocks: int) -> DataFrame:
    """block and its words, for each block that a value falls into: one aggregation, with most of it before the shuffle."""
    return merged(values.where(F.col(column).isNotNull()).select(block(column, blocks).alias("block"), *words(column)))


def merged(rows: DataFrame) -> DataFrame:
    """One row for each block of any number of filters' rows, of equal numbers of blocks."""
    return rows.groupBy("block").agg(*(F.bit_or(w).alias(w) for w in WORDS))


def maybe(rows: DataFrame, column: str, filter: DataFrame, blocks: int, name: str = "maybe") -> DataFrame:
    """rows with a flag: false where the value is surely not in the filter. Joined by block, so the filter may be of any size; rows should be distinct."""
    own = [w.alias(f"_{k}") for k, w in zip(WORDS, words(column), strict=True)]
    asked = rows.select("*", F.coalesce(block(column, blocks), F.lit(-1)).alias("_block"), *own)
    met = asked.join(filter.withColumnRenamed("block", "_block"), "_block", "left")
    there = [F.col(w).bitwiseAND(F.col(f"_{w}")) == F.col(f"_{w}") for w in WORDS]
    return met.select(*(F.col(f"`{x}`") for x in rows.columns), F.coalesce(there[0] & there[1] & there[2] & there[3], F.lit(False)).alias(name))


class SeenFilter:
    """A filter kept at a path: its size in a file, its rows in a folder for each batch that was added.

    A batch has a number; adding it again, as after a failure, writes the same
    folder, and rows that are there twice change nothing. compact() makes one
    folder of all. A filter that is opened where one is goes on with it, by the
    size that it was made for.
    """

    def __init__(self, spark: SparkSession, path: str, capacity: int = CAPACITY, error: float = ERROR):
        self.spark, self.path = spark, path
        hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
        self._fs = hadoop.Path(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        self._at = lambda name: hadoop.Path(f"{path}/{name}")
        if not self._fs.exists(self._at("size/_SUCCESS")):
            spark.createDataFrame([(json.dumps({"blocks": blocks_for(capacity, error)}),)], "value string").write.mode("overwrite").text(f"{path}/size")
        self.blocks = json.loads(spark.read.text(f"{path}/size").first()["value"])["blocks"]

    def batches(self) -> list[int]:
        """The numbers of the batches that are complete."""
        if not self._fs.exists(self._at("rows")):
            return []
        names = [x.getPath().getName() for x in self._fs.listStatus(self._at("rows"))]
        return sorted(int(x.partition("=")[2]) for x in names if x.startswith("batch=") and self._fs.exists(self._at(f"rows/{x}/_SUCCESS")))

    def rows(self) -> DataFrame:
        """block and words, a row for each block that has any."""
        schema = "block long, " + ", ".join(f"{w} long" for w in WORDS)
        done = [f"{self.path}/rows/batch={k}" for k in self.batches()]
        if not done:
            return self.spark.createDataFrame([], schema)
        found = self.spark.read.schema(schema).parquet(*done)
        return found if len(done) == 1 else merged(found)

    def add(self, values: DataFrame, column: str = "url", batch: int | None = None) -> int:
        """Adds all values as a batch (the next one, if not named); returns its number."""
        batch = max(self.batches(), default=-1) + 1 if batch is None else batch
        bloom(values, column, self.blocks).write.mode("overwrite").parquet(f"{self.path}/rows/batch={batch}")
        return batch

    def compact(self) -> None:
        """All batches as one, by the last one's number plus one; the others go once that is complete."""
        old = self.batches()
        if len(old) > 1:
            self.rows().write.mode("overwrite").parquet(f"{self.path}/rows/batch={old[-1] + 1}")
            for k in old:
                self._fs.delete(self._at(f"rows/batch={k}"), True)

    def maybe(self, rows: DataFrame, column: str = "url", name: str = "maybe") -> DataFrame:
        return maybe(rows, column, self.rows(), self.blocks, name)
