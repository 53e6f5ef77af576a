"""Ordered passive-aggressive learning (PA-I, Crammer et al. 2006) over sparse vectors."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..sources.tables import new_path, stored
from .frontier import queue_order, running
from .skew import dealt_join

CAP, GATE = 1.0, 0.5
#: Entries of a block (some 200 MB in its task), keys whose changes its task writes at once, changes of weights that are merged at once.
BLOCK, KEYS_AT_ONCE, DELTAS = 1 << 21, 1 << 16, 8
#: Cells of a wide table that one set of first weights serves at least, and such sets for each partition at most.
CELLS, CHUNKS = 1 << 21, 4
BLOCK_OUT = "t long, score double, loss double, updated boolean, step double, key string, moved double"
_NAMES = [x.split()[0] for x in BLOCK_OUT.split(", ")]
_OUT = [pa.int64(), pa.float64(), pa.float64(), pa.bool_(), pa.float64(), pa.string(), pa.float64()]


def learn(weights: dict[str, float], keys: list[str], values: list[float], tc: int | None, cap: float, gate: float) -> tuple[float, float | None, bool]:
    """Score, loss and whether weights were moved by a row: one step of a replay. Without a label there is no loss, and nothing is learned."""
    score = sum(v * weights.get(k, 0.0) for k, v in zip(keys, values, strict=True))
    if tc is None:
        return score, None, False
    loss, size = max(0.0, 1.0 - tc * score), sum(v * v for v in values)
    learns = abs(score) <= gate and size > 0
    if learns:
        step = min(cap, loss / size) * tc
        for k, v in zip(keys, values, strict=True):
            weights[k] = weights.get(k, 0.0) + step * v
    return score, loss, learns


def folded(cap: float, gate: float):
    """For mapInArrow over a block's (t, tc, key, value, weight), key null for an empty vector: rows of BLOCK_OUT, one for each t (key null), one for each key of rows that learned (with the change of its weight)."""

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = list(batches)  # one block, or none
        if not sum(b.num_rows for b in held):
            return
        rows = pa.Table.from_batches(held)
        held.clear()
        t, tc, value, weight = (rows.column(k).to_numpy() for k in (0, 1, 3, 4))
        words = rows.column(2).dictionary_encode().combine_chunks()
        words = words if isinstance(words, pa.Array) else words.chunk(0)
        code, names = words.indices.fill_null(-1).to_numpy(), words.dictionary
        order = np.lexsort((code, t))
        t, tc, code, value, weight = (x[order] for x in (t, tc, code, value, weight))
        begin = np.flatnonzero(np.append(True, t[1:] != t[:-1]))
        end = np.append(begin[1:], len(t))
        before, touched = np.zeros(len(names)), np.zeros(len(names), bool)
        before[code[code >= 0]] = weight[code >= 0]
        weights, out = before.copy(), []
        for low, high in zip(begin.tolist(), end.tolist(), strict=True):
            at, x = (code[low:high], value[low:high]) if code[low] >= 0 else (code[:0], value[:0])
            score, label = float(weights[at] @ x), None if np.isnan(tc[low]) else int(tc[low])
            loss, size = None if label is None else max(0.0, 1.0 - label * score), float(x @ x)
            learns = label is not None and abs(score) <= gate and size > 0
            step = min(cap, loss / size) * label if learns else 0.0
            if learns:
                weights[at] += step * x
                touched[at] = True
            out.append((int(t[low]), score, loss, learns, step, None, None))
        yield pa.RecordBatch.from_arrays([pa.array(x, kind) for x, kind in zip(zip(*out, strict=True), _OUT, strict=True)], _NAMES)
        moved = np.flatnonzero(touched)
        for low in range(0, len(moved), KEYS_AT_ONCE):
            some = moved[low : low + KEYS_AT_ONCE]
            none = [pa.nulls(len(some), kind) for kind in _OUT[:5]]
            yield pa.RecordBatch.from_arrays([*none, names.take(pa.array(some)), pa.array((weights - before)[some])], _NAMES)

    return fold


class Replay:
    """A replay of rows (id, x map<string,double>, tc) in id order (by label and a hash of the vector where ids repeat), block by block.

    Weights are a table. A block is a run of rows with about `block` entries (at
    least one row), so that it fits into one task whatever the table's size. Its
    entries are joined with the weights so far in parallel; what is sequential,
    each row's score and step after those before it, is a fold over the block,
    which writes the rows' steps and the changes of the block's weights. Nothing
    of this goes through the driver but where the blocks begin. Results:

    labels: t (from 1, the order), id, tc and the columns `kept`; entries: t, key, value; steps: t,
    score, loss, updated, step; weights: key, weight, of all keys of rows that learned.
    """

    def __init__(self, rows: DataFrame, cap: float = CAP, gate: float = GATE, block: int = BLOCK, kept: tuple[str, ...] = ()):
        spark = rows.sparkSession
        rows = rows.select(F.col("id").cast("long").alias("id"), "x", F.col("tc").cast("int").alias("tc"), *kept, F.xxhash64(F.map_entries("x")).alias("mark"))
        placed = queue_order(rows, "id", "tc", "mark").withColumnRenamed("rank", "t")
        size = F.greatest(F.lit(1), F.coalesce(F.size("x"), F.lit(0))).cast("long")
        labels = stored(placed.select("t", "id", "tc", *kept, size.alias("n")), "labels")
        self.labels = labels.drop("n")
        # In order of t by files, so that a block is read from few of them; an empty vector is a row without key.
        whole = stored(placed.select("t", "tc", F.explode_outer("x").alias("key", "value")).withColumn("value", F.coalesce("value", F.lit(0.0))), "entries")
        self.entries = whole.where("key is not null").select("t", "key", "value")
        sized = running(labels.select(F.lit(0).alias("host"), F.col("t").alias("seq"), "n"), F.col("n"))
        blocks = sized.groupBy(F.floor(F.col("before") / block)).agg(F.min("seq").alias("low"), F.max("seq").alias("high"))
        deltas: list[DataFrame] = []
        steps: list[str] = []
        for low, high in sorted((r["low"], r["high"]) for r in blocks.collect()):
            entries, known = whole.where(F.col("t").between(low, high)), summed(deltas)
            met = entries.withColumn("weight", F.lit(0.0)) if known is None else entries.join(known.hint("merge"), "key", "left")  # no broadcast: the table would come through the driver for each block
            met = met.select("t", F.col("tc").cast("double").alias("tc"), "key", "value", F.coalesce("weight", F.lit(0.0)).alias("weight"))
            path = new_path(spark, "block")
            met.repartition(1).mapInArrow(folded(cap, gate), BLOCK_OUT).write.parquet(path)
            done = spark.read.schema(BLOCK_OUT).parquet(path)
            steps.append(path)
            deltas.append(done.where("key is not null").select("key", F.col("moved").alias("weight")))
            if len(deltas) > DELTAS:
                deltas = [stored(summed(deltas), "weights")]
        empty = spark.createDataFrame([], BLOCK_OUT)
        found = spark.read.schema(BLOCK_OUT).parquet(*steps) if steps else empty
        self.steps = found.where("t is not null").select("t", "score", "loss", "updated", "step")
        found = summed(deltas)
        self.weights = spark.createDataFrame([], "key string, weight double") if found is None else found

    def scored(self) -> DataFrame:
        """id, score, tc, loss, updated of each row."""
        return self.labels.join(self.steps, "t").select("id", "score", "tc", "loss", "updated")

    def explained(self) -> DataFrame:
        """id, key, x, weight: each entry of each row beside the weight that its key had before the row; 0 before any.

        Sums over earlier rows by key, in ranges of t, so a word of all rows is in no one task.
        """
        moves = self.entries.join(self.steps.where("updated").select("t", "step"), "t", "left")
        moves = moves.select(F.col("key").alias("host"), F.col("t").alias("seq"), "value", (F.coalesce("step", F.lit(0.0)) * F.col("value")).alias("moved"))
        before = running(moves, F.col("moved")).select(F.col("seq").alias("t"), F.col("host").alias("key"), F.col("value").alias("x"), F.col("before").cast("double").alias("weight"))
        return before.join(self.labels.select("t", "id"), "t").select("id", "key", "x", "weight")


def summed(deltas: list[DataFrame]) -> DataFrame | None:
    """key, weight: the sum of changes of weights."""
    if not deltas:
        return None
    return reduce(DataFrame.unionByName, deltas).groupBy("key").agg(F.sum("weight").alias("weight"))


def replay(rows: DataFrame, cap: float = CAP, gate: float = GATE) -> DataFrame:
    """id, score, tc, loss, updated for rows (id, x map<string,double>, tc) taken in id order: a Replay's.

    Each row is scored with the weights so far; unless |score| > gate they move
    by min(cap, loss / |x|^2) * tc * x. Loss is that before the update. A null
    vector is empty; a row without a label is scored only.
    """
    return Replay(rows, cap, gate).scored()


def final_weights(rows: DataFrame, cap: float = CAP, gate: float = GATE) -> DataFrame:
    """key, weight after a replay of all rows (id, x, tc) in id order."""
    return Replay(rows, cap, gate).weights


def replay_weights(rows: DataFrame, cap: float = CAP, gate: float = GATE) -> DataFrame:
    """One row: weights map<string,double>, final_weights() as a map."""
    found = final_weights(rows, cap, gate).agg(F.collect_list(F.struct("key", "weight")).alias("w"))
    return found.select(F.map_from_entries("w").alias("weights"))


def explained(rows: DataFrame, weights: DataFrame) -> DataFrame:
    """id, key, x, weight: each entry of each vector (id, x) beside the weight (key, weight) that it meets; 0 for a key without one."""
    entries = rows.select("id", F.explode("x").alias("key", "x"))
    return dealt_join(entries, weights, ["key"], F.col("id"), "left").select("id", "key", "x", F.coalesce("weight", F.lit(0.0)).alias("weight"))


def slot_index(rows: DataFrame) -> DataFrame:
    """key, col: the columns of a wide table of weights. Slots rise; inside a slot tokens stand in the order in which rows first had them.

    rows: id, slots: the slots of each row, each an array of its keys (a number's slot has its own key only).
    """
    seen = rows.select("id", F.posexplode("slots").alias("slot", "keys")).select("id", "slot", F.posexplode("keys").alias("pos", "key"))
    first = seen.groupBy("key").agg(F.min(F.struct("slot", "id", "pos")).alias("at")).select("key", "at.slot", "at.id", "at.pos")
    return queue_order(first, "slot", "id", "pos", "key").select("key", (F.col("rank") - 1).cast("int").alias("col"))


def trajectory_lines(rows: DataFrame, index: DataFrame, cap: float = CAP, gate: float = GATE) -> DataFrame:
    """id, line: for each row (id, url, x, tc) a CSV line of id, url, score, tc, loss and all weights after it, in the order of
    index (key, col); weights of tokens that no row had yet are 0. Partitions, and lines in them, are in order of id; the
    metadata of line say how many bytes a line has, about.

    After a Replay the lines are written in parallel: rows are cut into chunks of
    CELLS cells or more, each begins with the sums of all moves before it, and a
    task holds one line and one chunk's weights at a time. As each chunk begins
    with all keys that were moved, their number goes by the partitions, not by
    the rows.
    """
    spark, many = rows.sparkSession, index.count()
    done = Replay(rows, cap, gate, kept=("url",))
    parts, total = int(spark.conf.get("spark.sql.shuffle.partitions", "200")), done.labels.count()
    size = max(1, CELLS // max(1, many), -(-total // (CHUNKS * parts)))
    chunk = F.floor((F.col("t") - 1) / size).cast("long").alias("chunk")
    moves = done.entries.join(done.steps.where("updated").select("t", "step"), "t").select("t", "key", (F.col("step") * F.col("value")).alias("x"))
    moves = stored(dealt_join(moves, index, ["key"], F.col("t")).select(chunk, "t", "col", "x"), "moves")
    wide = 4 * many + 24 * moves.select("col").distinct().count()
    # A key's sum after a chunk is where all chunks begin up to the next one that moves it.
    by, last = W.partitionBy("col").orderBy("chunk"), F.lit((total - 1) // size)
    sums = moves.groupBy("chunk", "col").agg(F.sum("x").alias("x"))
    sums = sums.select("col", F.sum("x").over(by).alias("x"), (F.col("chunk") + 1).alias("low"), F.coalesce(F.lead("chunk").over(by), last).alias("high")).where("low <= high")
    begins = sums.select(F.explode(F.sequence("low", "high")).alias("chunk"), F.lit(0).cast("long").alias("t"), "col", "x")
    heads = done.labels.join(done.steps, "t").select(chunk, "t", F.lit(many).alias("col"), "id", "url", "score", "tc", "loss")
    whole = stored(begins.unionByName(moves).unionByName(heads, allowMissingColumns=True), "chunks")

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, weights, cells, tail = None, [], [], None  # a row that moves nothing has the tail of the row before
        for batch in batches:
            for at, _, col, x, number, url, score, tc, loss in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if at != now:
                    now, weights, cells, tail = at, [0.0] * many, ["0.0"] * many, None
                if col < many:
                    weights[col] += x
                    cells[col], tail = repr(weights[col]), None
                    continue
                tail = "".join(f",{c}" for c in cells) if tail is None else tail
                quoted = '"' + (url or "").replace('"', '""') + '"'
                line = ",".join([str(number), quoted, repr(score), "" if tc is None else str(tc), "" if loss is None else repr(loss)]) + tail
                yield pa.RecordBatch.from_arrays([pa.array([number], pa.int64()), pa.array([line], pa.string())], ["id", "line"])

    return whole.repartitionByRange(parts, "chunk").sortWithinPartitions("chunk", "t", "col").mapInArrow(fold, "id long, line string").select("id", F.col("line").alias("line", metadata={"bytes": wide}))


def scores(rows: DataFrame, weights: DataFrame) -> DataFrame:
    """id, score: vectors (id, x) against a weight table (key, weight), as a join; a word that is in most rows is dealt out."""
    entries = rows.select("id", F.explode_outer("x").alias("key", "value"))
    return dealt_join(entries, weights, ["key"], F.col("id"), "left").groupBy("id").agg(F.coalesce(F.sum(F.col("value") * F.coalesce("weight", F.lit(0.0))), F.lit(0.0)).alias("score"))


def feature_index(rows: DataFrame) -> DataFrame:
    """token, idx: tokens (id, pos, token) numbered from 0 in the order in which they first appear."""
    first = rows.groupBy("token").agg(F.min(F.struct("id", "pos")).alias("at")).select("token", "at.id", "at.pos")
    return queue_order(first, "id", "pos", "token").select("token", (F.col("rank") - 1).alias("idx"))
