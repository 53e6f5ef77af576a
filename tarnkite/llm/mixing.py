"""Mixing sources to target weights by cube-method balanced sampling.

A source whose target is r times its size takes each document floor(r) times,
and once more with probability r - floor(r). The cube method settles these
fractions: within a block of one source it moves the inclusion probabilities of
three documents along the null space of two constraints (tokens and documents),
so both totals keep their expected values while each step fixes a document at 0
or 1. A block leaves at most two fractions; the fractions of all blocks form
new, fewer blocks, until one block a source is left. That block keeps LANDING
documents of all sizes out of the flight; they and the last two are the landing
problem: of all its roundings the one nearest to the source's token total is taken.
"""

from __future__ import annotations

import random

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import _common as c

#: Documents that one task moves together, at most; hashes fill a block to FULL on average.
BLOCK, FULL = 4096, 0.75
#: Rows that repeat and that one task numbers.
RUN = 4096
#: Documents of each source that the landing phase settles, besides the flight's last two.
LANDING = 10
CLOSE = 1e-9


def source_targets(sizes: DataFrame, weights: tuple[float, ...], share: float, most: float) -> DataFrame:
    """source, rank, source_size, target: weighted shares of the whole, none above most times its source. sizes: source, size, rows.

    Sources go by code point, null last, and weigh `weights`, repeating. The
    excess of a capped source goes to the others by weight until none is above:
    target = min(most * size, level * weight) at the one level that uses up the
    share. Sorted by most * size / weight, the capped sources are a prefix, and
    prefix sums give the level.
    """
    per = sizes.groupBy("source").agg(F.sum(F.col("size") * F.col("rows")).alias("source_size"))
    ranked = per.withColumn("rank", F.row_number().over(W.orderBy(F.col("source").asc_nulls_last())) - 1)
    weight = F.element_at(F.array([F.lit(float(w)) for w in weights]), (F.col("rank") % len(weights) + 1).cast("int"))
    ranked = ranked.withColumn("weight", weight).withColumn("cap", F.col("source_size") * F.lit(float(most)))
    line = W.orderBy(F.col("cap") / F.col("weight"), "rank")
    before, rest = line.rowsBetween(W.unboundedPreceding, -1), line.rowsBetween(0, W.unboundedFollowing)
    whole = W.partitionBy()
    levels = ranked.withColumn("level", (F.sum("source_size").over(whole) * F.lit(float(share)) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("weight").over(rest))
    # The first source that its level does not cap sets the level of all.
    level = F.min(F.when(F.col("level") * F.col("weight") <= F.col("cap"), F.struct(F.col("cap") / F.col("weight"), "rank", "level"))).over(whole)["level"]
    target = F.when(level.isNull(), F.col("cap")).otherwise(F.least(F.col("cap"), level * F.col("weight")))
    return levels.select("source", "rank", "source_size", target.alias("target"))


def moved(sizes: list[float], p: list[float], seed: int) -> list[float]:
    """Flight phase: p with all but two entries at most settled, sums of p and of sizes * p kept."""
    draw, p, live = random.Random(seed), list(p), []
    for k in range(len(p)):
        if not CLOSE < p[k] < 1 - CLOSE:
            p[k] = round(p[k])
            continue
        live.append(k)
        while len(live) == 3:
            a, b, d = (sizes[i] for i in live)
            u = (b - d, d - a, a - b) if (a, b) != (b, d) else (1.0, -1.0, 0.0)
            up = min(((1 - p[i]) / x if x > 0 else -p[i] / x) for i, x in zip(live, u, strict=True) if x)
            down = min((p[i] / x if x > 0 else (p[i] - 1) / x) for i, x in zip(live, u, strict=True) if x)
            step = up if draw.random() * (up + down) < down else -down
            for i, x in zip(live, u, strict=True):
                p[i] = min(1.0, max(0.0, p[i] + step * x))
                if not CLOSE < p[i] < 1 - CLOSE:
                    p[i] = float(round(p[i]))
            live = [i for i in live if 0 < p[i] < 1]
    return p


def landed(sizes: list[float], p: list[float], at: list[int]) -> list[float]:
    """The entries of p at `at` rounded so that the sum of sizes * p changes least (then the sum of p)."""
    bits = (np.arange(1 << len(at))[:, None] >> np.arange(len(at))) & 1
    off = bits - np.array([p[k] for k in at]).reshape(1, -1)
    best = np.lexsort((np.abs(off.sum(1)), np.abs(off @ np.array([sizes[k] for k in at]))))[0]
    p = list(p)
    for k, bit in zip(at, bits[best], strict=True):
        p[k] = float(bit)
    return p


def fly(group: pd.DataFrame) -> pd.DataFrame:
    """One block: large documents first, so that what stays open is small."""
    group = group.sort_values(["size", "mark", "doc_id", "turn", "p"], ascending=[False, True, True, True, True], ignore_index=True)
    last = group["blocks"].iloc[0] == 1
    kept = np.unique(np.linspace(0, len(group) - 1, LANDING).astype(int)) if last else np.zeros(0, int)
    order = np.concatenate([np.setdiff1d(np.arange(len(group)), kept), kept])
    group = group.iloc[order].reset_index(drop=True)
    sizes, p, flying = group["size"].astype(float).tolist(), group["p"].tolist(), len(group) - len(kept)
    seed = int(group["rank"].iloc[0]) * 1_000_003 + int(group["block"].iloc[0])
    p = moved(sizes[:flying], p[:flying], seed) + p[flying:]
    return group.assign(p=landed(sizes, p, [k for k, x in enumerate(p) if 0 < x < 1]) if last else p)


def numbered(sizes: DataFrame) -> DataFrame:
    """doc_id, source, size, turn for each row that sizes (doc_id, source, size, rows) stands for; turn numbers those that repeat.

    Rows that repeat many times are made again by several tasks, RUN by each.
    """
    few = sizes.where(F.col("rows") <= RUN).withColumn("run", F.lit(0).cast("long"))
    many = sizes.where(F.col("rows") > RUN).withColumn("run", F.explode(F.sequence(F.lit(0), F.floor((F.col("rows") - 1) / RUN)))).repartition("doc_id", "source", "size", "run")
    first = F.col("run") * RUN
    return few.unionByName(many).select("doc_id", "source", "size", F.explode(F.sequence(first, F.least(first + RUN, F.col("rows")) - 1)).alias("turn"))


def mix(docs: DataFrame, weights: tuple[float, ...] = (3, 1, 2), share: float = 1.5, most: float = 2.0, block: int = BLOCK) -> DataFrame:
    """How often the mix takes each document.

    docs: doc_id, source, text; further columns are ignored. A document's size
    is its number of words (null or empty text: 0); null is a source of its own.
    Returns a row for each row of docs: doc_id, source, size, source_size,
    target, taken (size times its copies; at most ceil(most) copies). Sources
    without words have target 0. Rows that repeat are documents of their own:
    they are counted, and numbered when they are made again, so they lie in
    different blocks. The draw depends on ids, sizes and these numbers only, so
    reruns agree. An empty table gives none.
    """
    words = F.coalesce(F.regexp_count("text", F.lit(c.WORDS)), F.lit(0)).cast("long")
    sizes = c.staged(docs.select("doc_id", "source", words.alias("size")).groupBy("doc_id", "source", "size").agg(F.count("*").alias("rows")), "mix-sizes")
    targets = c.staged(source_targets(sizes, weights, share, most), "mix-targets")
    ratio = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    units = numbered(sizes).join(targets.withColumnRenamed("source", "of"), F.col("source").eqNullSafe(F.col("of"))).drop("of")
    whole = F.floor(ratio + F.lit(CLOSE)).cast("int")
    units = units.select(
        "doc_id", "source", "size", "turn", "source_size", "target", "rank", whole.alias("copies"), F.greatest(F.lit(0.0), ratio - whole).alias("p"), F.xxhash64(F.lit("mix"), "doc_id", "size", "turn").alias("mark")
    )
    open_, done = (F.col("p") > CLOSE) & (F.col("p") < 1 - CLOSE), []
    while True:
        units = c.staged(units, "mix-units")
        done.append(units.where(~open_))
        left = units.where(open_)
        counts = left.groupBy("rank").agg(F.ceil(F.count("*") / F.lit(block * FULL)).cast("int").alias("blocks"))
        if counts.isEmpty():
            break
        placed = left.join(counts, "rank").withColumn("block", F.pmod(F.xxhash64("mark", "blocks"), F.col("blocks")).cast("int"))
        units = placed.groupBy("rank", "block").applyInPandas(fly, placed.schema).select(*left.columns)
    return c.union(done).select("doc_id", "source", "size", "source_size", "target", (F.col("size") * (F.col("copies") + F.round("p"))).cast("long").alias("taken"))


def op9_mix_sources(spark, sf_dir: str) -> DataFrame:
    """mix() of all documents; it says what holds for nulls, empty texts and repeated rows."""
    return mix(c.table(spark, sf_dir, "documents")).drop("source")
