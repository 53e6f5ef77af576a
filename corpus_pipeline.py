"""From raw documents to a training mix: the stages, in order, and their run."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarnkite.llm import _common as c
from tarnkite.llm.decontaminate import without_contaminated
from tarnkite.llm.jaccard_join import one_of_each
from tarnkite.llm.line_dedup import dedup_lines
from tarnkite.llm.mixing import mix
from tarnkite.llm.quality_rules import keep_good

DOCUMENT = ("doc_id", "text", "lang", "source", "n_chars")


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rule ensemble rejects go."""
    return keep_good(docs, c.table(spark, sf_dir, "labels"))


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later repeats of line runs go, and with them documents of which nothing is left."""
    cleaned = dedup_lines(docs)
    left = (F.col("n_removed") == 0) | F.col("text").rlike(c.WORDS)
    return cleaned.where(left).withColumn("n_chars", F.when(F.col("n_removed") > 0, F.length("text")).otherwise(F.col("n_chars")).cast("long")).select(*docs.columns)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of similar documents the one with the least doc_id stays."""
    return one_of_each(docs)


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain a benchmark passage go."""
    return without_contaminated(docs, c.table(spark, sf_dir, "benchmark"))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """How many words of each document the mix takes: doc_id, source, size, source_size, target, taken."""
    return mix(docs)


STAGES = [
    ("quality classifier", quality),
    ("line dedup", lines),
    ("n-gram Jaccard join", near_copies),
    ("benchmark decontamination", benchmark),
    ("mixing sources to target weights", mixture),
]

#: The classifier is trained and the cube method draws, which SQL cannot express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each stage's result is stored before the next begins."""
    docs = c.table(spark, sf_dir, "documents").select(*DOCUMENT)
    for _, stage in STAGES[:-1]:
        docs = c.staged(stage(spark, docs, sf_dir), "pipeline")
    return STAGES[-1][1](spark, docs, sf_dir)
