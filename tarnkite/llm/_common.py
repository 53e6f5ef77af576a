"""What the operators of this subpackage share: shared-folder tables, keys, classes."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from functools import reduce
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._tokens import mixed

#: White space of the contracts, as a character class for Java and RE2 patterns.
SPACES = r"[\x20\x09-\x0D]+"
WORDS = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bounded_batches(spark: SparkSession, records: int = 1024) -> None:
    """Arrow batches of few rows, as a row may be a long text; must hold when the plan is made."""
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch", "10000")) > records:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(records))


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: the session's spark.checkpoint.dir.

    Only a local session without one gets a temporary folder; a cluster
    without one is an error, since a machine's own folder would not do.
    """
    context = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not named:
        if not context.master.startswith("local") or context.master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        named = "file://" + tempfile.mkdtemp(prefix="tarnkite-")
    if not context.getCheckpointDir():
        context.setCheckpointDir(named)
    return named


def new_folder(spark: SparkSession, tag: str) -> str:
    """A fresh path in the shared folder; it goes when the session's JVM ends."""
    path = f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"
    jvm = spark.sparkContext._jvm
    there = jvm.org.apache.hadoop.fs.Path(path)
    there.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(there)
    return path


def staged(df: DataFrame, tag: str) -> DataFrame:
    """df written as Parquet to the shared folder and read again: computed once, no lineage."""
    path = new_folder(df.sparkSession, tag)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def union(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)


def unused(columns: list[str], name: str) -> str:
    """name, with underscores before it until no column is called so (in any case)."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def order_key(column: Column) -> Column:
    """Orders nulls last inside min() of a struct."""
    return F.struct(column.isNull().alias("none"), column.alias("id"))


def shuffle_width(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions", "200")))


def doc_key() -> Column:
    """128 bits of SHA-256 over a document's doc_id and text: its identity; rows that repeat both share it."""
    number = F.coalesce(F.col("doc_id").cast("string"), F.lit("none"))
    text = F.when(F.col("text").isNull(), F.lit("-")).otherwise(F.concat(F.lit("+"), F.col("text")))
    return F.substring(F.unhex(F.sha2(F.concat(number, text).cast("binary"), 256)), 1, 16)


def salted(spark: SparkSession, spread: Column) -> Column:
    """Which of the parts of its key a row belongs to; as many parts as a shuffle has, 64 at least."""
    return F.pmod(F.xxhash64(spread), F.lit(max(64, shuffle_width(spark)))).cast("int")


def with_first(rows: DataFrame, keys: list[str], place: Column, spread: Column, keep_salt: bool = False) -> DataFrame:
    """rows with `first`, the least place among the rows of equal keys, and `many`, their number.

    In two levels, on keys and salt and then on keys, up and down again: a key
    that a third of all rows have meets in no one task. spread is hashed for the
    salt and should differ between the rows of a key. Keys are never null.
    """
    rows = rows.withColumn("salt", salted(rows.sparkSession, spread))
    near = rows.groupBy(*keys, "salt").agg(F.min(place).alias("near"), F.count("*").alias("some"))
    far = near.groupBy(*keys).agg(F.min("near").alias("first"), F.sum("some").alias("many"))
    down = near.select(*keys, "salt").join(far, keys)
    found = rows.join(down, [*keys, "salt"])
    return found if keep_salt else found.drop("salt")


def join_one(rows: DataFrame, other: DataFrame, keys: list[str], spread: Column) -> DataFrame:
    """rows joined with the one row that `other` has for their keys; a key may be in a third of rows.

    other's row meets one row for each salt of its key, and those copies meet
    the rows of their salt. Rows whose key other lacks go. Keys are never null.
    """
    rows = rows.withColumn("salt", salted(rows.sparkSession, spread))
    copies = rows.select(*keys, "salt").distinct().join(other, keys)
    return rows.join(copies, [*keys, "salt"]).drop("salt")


#: Bits, as a power of two, that a filter may have at most: 16 MB, and 128 MB where what it saves is a shuffle of whole texts.
MOST_BITS, TEXT_BITS = 27, 30


class HashFilter(NamedTuple):
    """A Bloom filter in blocks of one 64-bit word: a hash's first bits name its word, `probes` groups of six its bits there."""

    words: np.ndarray
    probes: int


def filter_bits(n: int, least: int = 16, most: int = MOST_BITS) -> int:
    """Bits of a filter's hashes for n values: sixteen bits a value, up to 2 ** most bits in all."""
    return min(most, max(least, n.bit_length() + 4))


def probes_for(bits: int, n: int) -> int:
    """How many bits a value sets, so that about half of the filter is set: five at most, one where it is overfull."""
    return min(5, max(1, round(0.69 * (1 << bits) / max(1, n))))


def marked_words(bits: int, probes: int):
    """For mapInArrow over hashes: the word of a filter of 2 ** bits bits that each names, and its bits there."""

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = mixed(batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64))
            masks = np.zeros(len(own), np.uint64)
            for k in range(probes):
                masks |= np.uint64(1) << ((own >> np.uint64(6 * k)) & np.uint64(63))
            words = (own >> np.uint64(64 - bits)) >> np.uint64(6)
            yield pa.RecordBatch.from_arrays([pa.array(words.view(np.int64)), pa.array(masks.view(np.int64))], ["word", "mask"])

    return mark


def hash_filter(values: DataFrame, column: str, bits: int, n: int | None = None) -> HashFilter:
    """A filter of 2 ** bits bits for a column of 64-bit hashes; n: how many there are, from which the probes follow (three if not given).

    The hashes are mixed again, as those that were chosen for being small, such as anchors, are not spread evenly.
    """
    probes = 3 if n is None else probes_for(bits, n)
    marks = values.select(column).where(F.col(column).isNotNull()).mapInArrow(marked_words(bits, probes), "word long, mask long")
    words = marks.groupBy("word").agg(F.bit_or("mask").alias("bits")).toArrow()
    table = np.zeros(1 << (bits - 6), np.int64)
    table[words.column("word").to_numpy()] = words.column("bits").to_numpy()
    return HashFilter(table.view(np.uint64), probes)


def passes(table: HashFilter, hashes: np.ndarray) -> np.ndarray:
    """Which of the hashes the filter lets through: all that it was made of, and few others. Later probes look only at what is left."""
    own = mixed(hashes)
    bits = (len(table.words) * 64).bit_length() - 1
    words = table.words[((own >> np.uint64(64 - bits)) >> np.uint64(6)).astype(np.int64)]
    found = ((words >> (own & np.uint64(63))) & np.uint64(1)).astype(bool)
    if table.probes > 1:
        some = np.flatnonzero(found)
        words, own = words[some], own[some]
        more = np.ones(len(some), bool)
        for k in range(1, table.probes):
            more &= ((words >> ((own >> np.uint64(6 * k)) & np.uint64(63))) & np.uint64(1)).astype(bool)
        found[some] = more
    return found


def sieved(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """docs (doc, text) without most of those whose doc is not in ids, by a filter of bounded size."""
    marks = ids.select(F.xxhash64("doc").alias("mark"))
    many = ids.count()
    shared = ids.sparkSession.sparkContext.broadcast(hash_filter(marks, "mark", filter_bits(many, most=TEXT_BITS), many))

    def there(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.select([0, 1]).filter(pa.array(passes(shared.value, batch.column(2).to_numpy(zero_copy_only=False).view(np.uint64))))

    return docs.select("doc", "text", F.xxhash64("doc").alias("mark")).mapInArrow(there, "doc binary, text string")
