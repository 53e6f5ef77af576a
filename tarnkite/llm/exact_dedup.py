"""Exact dedup by a tree merge of sorted digest runs (DataFrame functions only).

Every input partition becomes a run of (digest, verification, smallest row).
In each binomial round a node takes the runs of ``2 ** fan_bits`` children and
merges them in order of their digests: a merged entry keeps the smallest
identifier of the entries whose verification (SHA-256 and length) agrees, not of
those that share a digest only. As runs get fewer and longer, each is cut at the
first bits of the digest into as many slices as there are runs in it, so a round
has the same number of tasks up to the root; a task sorts what its slice of the
children's runs brings and passes over it once. A hot text has one entry a run,
so no merge ever sees more than ``2 ** fan_bits`` entries of it. The verdicts
then go back down the same tree, so no join has a hot key either.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import _common as c

KEY = ("digest", "sha", "n")


def normalised(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), c.SPACES, " ")


def digest_runs(docs: DataFrame, runs: int) -> DataFrame:
    """One row a document: its run, digest, verification and its place (id, row)."""
    text = docs.select("doc_id", normalised(F.col("text")).alias("norm"))
    return text.select(
        F.pmod(F.spark_partition_id(), F.lit(runs)).cast("int").alias("run"),
        F.xxhash64("norm").alias("digest"),
        F.unhex(F.sha2(F.col("norm").cast("binary"), 256)).alias("sha"),
        F.length("norm").alias("n"),
        "doc_id",
        F.monotonically_increasing_id().alias("row"),
    )


def own_runs(leaves: DataFrame, place: Column) -> DataFrame:
    """One entry for each text of a run: run, KEY, its smallest place, and its rows."""
    return leaves.groupBy("run", *KEY).agg(F.min(place).alias("place"), F.count("*").alias("rows"))


def merge_level(entries: DataFrame, shift: int, merged: int, bits: int) -> DataFrame:
    """The runs of 2 ** shift neighbours as one, smallest place and row count kept.

    A run then holds 2 ** merged of the 2 ** bits leaves, in as many slices. The
    aggregate meets each slice sorted by its keys, and needs no exchange of its own.
    """
    run = F.shiftright("run", shift).cast("int").alias("run")
    cut = F.shiftrightunsigned("digest", 64 - merged).alias("slice")
    moved = entries.select(run, cut, *KEY, "place", "rows").repartition(1 << bits, "run", "slice").sortWithinPartitions("run", "slice", *KEY)
    return moved.groupBy("run", "slice", *KEY).agg(F.min("place").alias("place"), F.sum("rows").alias("rows")).drop("slice")


def exact_dedup(docs: DataFrame, fan_bits: int = 4) -> DataFrame:
    """Which row of each group of equal texts stays.

    docs: doc_id, text; further columns are ignored. Texts are equal when
    identical after each run of white space becomes one space; null counts as
    empty, and empty texts are equal to each other. Of equal texts the row with
    the smallest doc_id stays (null ids come last; of rows that repeat an id
    one stays, the first in the input). Returns a row for each row of docs:
    doc_id, keep_id, group_size, kept, text_sha256. An empty table gives none.
    """
    bits = (c.shuffle_width(docs.sparkSession) - 1).bit_length()
    # Written once: the way down must meet the partition numbers of the way up.
    leaves = c.staged(digest_runs(docs, 1 << bits), "digest-runs")
    place = F.struct(c.order_key(F.col("doc_id")).alias("id"), F.col("row"))
    levels, shifts = [own_runs(leaves, place)], []
    while sum(shifts) < bits:
        shifts.append(min(fan_bits, bits - sum(shifts)))
        levels.append(merge_level(levels[-1], shifts[-1], sum(shifts), bits))
    down = levels.pop()
    for shift in reversed(shifts):
        child = levels.pop().select("run", *KEY, F.shiftright("run", shift).cast("int").alias("parent"))
        down = child.join(down.withColumnRenamed("run", "parent"), ["parent", *KEY]).drop("parent")
    return leaves.join(down, ["run", *KEY]).select(
        "doc_id",
        F.col("place.id.id").alias("keep_id"),
        F.col("rows").alias("group_size"),
        (F.col("row") == F.col("place.row")).alias("kept"),
        F.lower(F.hex("sha")).alias("text_sha256"),
    )


def op6_exact_dedup(spark, sf_dir: str) -> DataFrame:
    """exact_dedup() of all documents; it says what holds for nulls, empty texts, ties and repeated rows."""
    return exact_dedup(c.table(spark, sf_dir, "documents"))


OP6_SQL = r"""
WITH t AS (
  SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256
  FROM documents)
SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       row_number() OVER (PARTITION BY text_sha256 ORDER BY doc_id) = 1 AS kept, text_sha256
FROM t WINDOW w AS (PARTITION BY text_sha256)
"""
