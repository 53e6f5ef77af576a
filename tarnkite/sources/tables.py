"""Tables, queues and files."""

from __future__ import annotations

import math
import re
import tempfile
import time
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

# Fixed value: what a CSV file's path must have.
CSV_PATH = r"(/|^)[A-Za-z0-9_]+\.csv"
#: Zstandard by Parquet's codec, for Spark's readers of text know it but its writers don't; and how far back (bits) it looks at which level.
ZSTD = "org.apache.parquet.hadoop.codec.ZstandardCodec"
LEVELS = ((22, 9), (23, 17), (25, 20), (27, 22))


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def checkpoint_dir(spark: SparkSession) -> str:
    """The session's shared folder; a local session without one gets a temporary folder."""
    context = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not named:
        if not context.master.startswith("local") or context.master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        named = "file://" + tempfile.mkdtemp(prefix="tarnkite-")
    if not context.getCheckpointDir():
        context.setCheckpointDir(named)
    return named


def new_path(spark: SparkSession, tag: str) -> str:
    """A fresh path in the shared folder; what is there goes when the session's JVM ends."""
    path = f"{checkpoint_dir(spark)}/{tag}-{uuid.uuid4().hex}"
    there = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    there.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(there)
    return path


def stored(df: DataFrame, tag: str = "stored") -> DataFrame:
    """df written to the shared folder and read again: computed once, without lineage."""
    path = new_path(df.sparkSession, tag)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def dealt(df: DataFrame) -> DataFrame:
    """df in as many partitions as there are cores, if it has fewer (as of one small file), for work that is heavy on each row."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def scan(df: DataFrame, order: str, n: int | None = None) -> DataFrame:
    """All rows, or the first n by a column."""
    return df if n is None else df.orderBy(order).limit(n)


def pick(df: DataFrame, key: str, value: int | None = None) -> DataFrame:
    """The row with a key, or the one with the least."""
    return df.where(F.col(key) == value) if value is not None else df.orderBy(key).limit(1)


def unbroken(df: DataFrame, key: str) -> DataFrame:
    """Rows from the least key on, up to the first number that is missing.

    The missing number is the least key whose successor is absent: a join of
    the distinct keys with themselves moved by one, not one sorted partition.
    """
    keys = df.select(F.col(key).alias("k")).where("k is not null").distinct()
    ends = keys.join(keys.select((F.col("k") - 1).alias("k")), "k", "left_anti")
    last = ends.agg(F.min("k").alias("last"))
    return df.join(F.broadcast(last), df[key] <= F.col("last")).drop("last")


def capped(df: DataFrame, by: str, order: str, most: int, salts: int = 64) -> DataFrame:
    """The first `most` rows of each group, in two levels: of each part of a group, and of what these leave."""
    first = lambda rows, *keys: rows.withColumn("_n", F.row_number().over(W.partitionBy(*keys).orderBy(order))).where(F.col("_n") <= most).drop("_n")
    parts = first(df.withColumn("_part", F.pmod(F.xxhash64(order), F.lit(salts))), by, "_part").drop("_part")
    return first(parts, by)


def exists(spark: SparkSession, path: str) -> bool:
    there = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return there.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(there)


def append(df: DataFrame, path: str) -> None:
    df.write.mode("append").parquet(path)


def counted_append(df: DataFrame, path: str, **sums: Column) -> dict[str, float]:
    """append(), and what the write itself saw: rows, the sums asked for, and the seconds that it took; there is no second pass."""
    seen = Observation()
    began = time.perf_counter()
    df.observe(seen, F.count("*").alias("rows"), *(F.sum(x).alias(k) for k, x in sums.items())).write.mode("append").parquet(path)
    return {**seen.get, "seconds": time.perf_counter() - began}


def clear(df: DataFrame, path: str) -> None:
    """Leaves an empty table with df's schema."""
    df.limit(0).write.mode("overwrite").parquet(path)


def write_lines(df: DataFrame, column: str, path: str) -> None:
    df.select(F.col(column).cast("string").alias("value")).write.mode("append").text(path)


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path)


def write_csv(df: DataFrame, path: str) -> None:
    """path must name a .csv file of letters, digits and underscores."""
    check_csv(path)
    df.write.mode("overwrite").option("header", True).csv(path)


def is_csv(path: Column) -> Column:
    """Whether a path names a .csv file of letters, digits and underscores."""
    return path.rlike(CSV_PATH)


def check_csv(path: str) -> None:
    if not re.search(CSV_PATH, path):
        raise ValueError(f"not a csv path: {path}")


def write_wide_csv(lines: DataFrame, header: list[str], path: str, packed: bool = False) -> None:
    """Lines (id, line), whose partitions are in order of id, as text under path in as many files, after one line with the header's names.

    Packed by ZSTD, lines that are nearly those before them take next to nothing, if it looks back over a whole line;
    the text is the same.
    """
    check_csv(path)
    spark, wide = lines.sparkSession, lines.schema["line"].metadata.get("bytes", 0)
    level = next((n for bits, n in LEVELS if 1 << bits > wide * 1.1), LEVELS[-1][1])
    options = {"compression": ZSTD, "parquet.compression.codec.zstd.level": str(level)} if packed else {}
    spark.createDataFrame([(",".join(header),)], "value string").coalesce(1).write.mode("overwrite").options(**options).text(f"{path}/part=0")
    lines.select(F.col("line").alias("value")).write.mode("overwrite").options(**options).text(f"{path}/part=1")


def wide_sums(lines: DataFrame, named: int) -> DataFrame:
    """named array<string>, n int, total double: of each line (value) of a wide CSV its first cells, an empty one null, and how many numbers follow and their sum.

    Numbers whose text is that of the line before are not read again.
    """
    cell = rb'(?:"((?:[^"]|"")*)"|([^,]*))'
    first = re.compile(b",".join([cell] * named) + b"(?:,|$)")

    def read_back(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before, n, total = None, 0, 0.0
        for batch in batches:
            out = []
            for value in batch.column(0):
                line = value.as_buffer().to_pybytes()
                found = first.match(line)
                if (tail := line[found.end() :]) != before:
                    numbers = tail.split(b",") if tail else []
                    before, n, total = tail, len(numbers), math.fsum(map(float, numbers))
                cells = [(a.replace(b'""', b'"') if a is not None else b).decode() or None for a, b in zip(found.groups()[::2], found.groups()[1::2], strict=True)]
                out.append({"named": cells, "n": n, "total": total})
            yield pa.RecordBatch.from_pylist(out, pa.schema([("named", pa.list_(pa.string())), ("n", pa.int32()), ("total", pa.float64())]))

    return lines.select("value").mapInArrow(read_back, "named array<string>, n int, total double")


def bag_union(*queues: DataFrame) -> DataFrame:
    """All urls of all queues, repetitions kept."""
    out = queues[0].select("url")
    for q in queues[1:]:
        out = out.unionByName(q.select("url"))
    return out
