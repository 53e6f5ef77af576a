"""The frontier over streams: dedup, one request at a time for each host, host queues with timers, expiry of idle hosts,
taking from a queue, capped writing, heartbeats until all is done, failures on record, messages that arrive at least once."""

from __future__ import annotations

import contextlib
import heapq
import math
import time
from collections.abc import Callable, Iterator
from itertools import islice

import numpy as np
import pandas as pd
from pyspark.errors import StreamingQueryException
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery, StreamingQueryListener
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.streaming.stateful_processor import ExpiredTimerInfo, TimerValues

from ..operators import frontier as fr
from ..operators import monitor as mo
from ..operators.seen import SeenFilter
from ..sources.tables import bag_union, exists, new_path

#: Rows that a host's answer comes in at once.
ROWS = 10_000
#: Tasks of a block of a host's queue, blocks that are in memory at once, tasks that are sorted into blocks at once.
BLOCK, HELD, TAKEN = 1024, 256, 1 << 16
#: What a message carries.
MESSAGE = "node long, url string, parent_url string"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def unseen(urls: DataFrame) -> DataFrame:
    """Each url once; all that came before are remembered (exactly, and without end)."""
    return urls.dropDuplicates(["url"])


def unseen_kept(urls: DataFrame, path: str) -> DataFrame:
    """Each url of a stream once, over all runs with the same path, as far as the stream's source goes now.

    What was seen is a table at the path, with a filter of it beside it, and no
    state of the stream, so it may grow without end: a batch's URLs are asked of
    the filter, and those that it lets through are looked up. A batch that is run
    again after a failure replaces its own rows and knows only those of earlier ones.
    """
    spark, seen = urls.sparkSession, "url string, batch int"

    def add(batch: DataFrame, number: int) -> None:
        known = spark.read.schema(seen).parquet(f"{path}/urls").where(F.col("batch") < number) if exists(spark, f"{path}/urls") else spark.createDataFrame([], seen)
        sieve = SeenFilter(spark, f"{path}/filter")
        fresh = fr.unseen(batch.where("url is not null").select("url", F.lit(0).alias("seq")), known, sieve).select("url")
        fresh.write.mode("overwrite").parquet(f"{path}/urls/batch={number}")
        sieve.add(spark.read.schema("url string").parquet(f"{path}/urls/batch={number}"), batch=number)

    run = urls.writeStream.foreachBatch(add).option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start()
    run.awaitTermination()
    return spark.read.schema(seen).parquet(f"{path}/urls").select("url")


def pull_times(tasks: DataFrame, idle_ms: int | None = None) -> DataFrame:
    """host, seq, start for tasks (host, seq, delay): the sum of the delays of the host's earlier tasks.

    The state of a host is the time at which it is free again; tasks of one
    batch go by seq. A host that was idle for idle_ms (say an hour) is dropped
    and starts anew. Leave it None where a run is to end by itself: with a
    timeout there is always another batch to run. Of one host's tasks in one
    batch only seq and delay are held, 16 bytes a task; the source's files per
    trigger bound them.
    """

    def serve(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        parts = [(pdf["seq"].to_numpy(), pdf["delay"].to_numpy(float)) for pdf in batches]
        seq, delay = (np.concatenate(x) for x in zip(*parts, strict=True))
        order = np.argsort(seq, kind="stable")
        seq, ends = seq[order], np.cumsum(delay[order])
        free = state.get[0] if state.exists else 0.0
        start = free + ends - delay[order]
        state.update((float(free + ends[-1]),))
        if idle_ms is not None:
            state.setTimeoutDuration(idle_ms)
        for low in range(0, len(seq), ROWS):
            yield pd.DataFrame({"host": key[0], "seq": seq[low : low + ROWS], "start": start[low : low + ROWS]})

    return tasks.groupBy("host").applyInPandasWithState(serve, "host string, seq long, start double", "free double", "append", GroupStateTimeout.NoTimeout if idle_ms is None else GroupStateTimeout.ProcessingTimeTimeout)


class Newest:
    """A host's tasks, newest first, in blocks of up to BLOCK tasks by seq; of a map state's blocks no more than HELD are in memory.

    index: the blocks' numbers, last seqs and sizes. A block that the state has
    dropped, as its time was over, has no tasks.
    """

    def __init__(self, state, index: list[tuple[int, int, int]]):
        self.state, self.held = state, {}
        self.sizes = {k: size for k, _, size in index}
        self.tops = [(-top, k) for k, top, _ in index]
        heapq.heapify(self.tops)

    def __len__(self) -> int:
        return sum(self.sizes.values())

    def block(self, k: int) -> tuple[list[int], list[float]]:
        found = self.held.pop(k, None)
        if found is None:
            if len(self.held) >= HELD:
                self.store(next(iter(self.held)))
            value = self.state.getValue((k,))
            found = (list(value[0]), list(value[1])) if value is not None else ([], [])
        self.held[k] = found  # the last one used is the last one here
        return found

    def store(self, k: int) -> None:
        self.state.updateValue((k,), self.held.pop(k))

    def drop(self, k: int) -> None:
        del self.sizes[k]
        self.held.pop(k, None)
        if self.state.containsKey((k,)):
            self.state.removeKey((k,))

    def push(self, tasks: list[tuple[int, float]]) -> None:
        """Adds tasks, with those of the last block if that is not full, in new blocks."""
        k = max(self.sizes, default=-1) + 1
        if k and self.sizes[k - 1] < BLOCK:
            tasks = [*tasks, *zip(*self.block(k - 1), strict=True)]
            self.drop(k - 1)
            self.tops = [x for x in self.tops if x[1] != k - 1]
            heapq.heapify(self.tops)
        tasks.sort(key=lambda x: x[0])
        for low in range(0, len(tasks), BLOCK):
            seqs, delays = zip(*tasks[low : low + BLOCK], strict=True)
            self.state.updateValue((k,), (list(seqs), list(delays)))
            self.sizes[k] = len(seqs)
            heapq.heappush(self.tops, (-seqs[-1], k))
            k += 1

    def pull(self) -> tuple[int, float] | None:
        while self.tops:
            k = self.tops[0][1]
            seqs, delays = self.block(k)
            task = (seqs.pop(), delays.pop()) if seqs else None
            if seqs:
                heapq.heapreplace(self.tops, (-seqs[-1], k))
                self.sizes[k] = len(seqs)
            else:
                heapq.heappop(self.tops)
                self.drop(k)
            if task:
                return task
        return None

    def close(self) -> list[tuple[int, int, int]]:
        """The index, after all that changed is in the state."""
        for k in list(self.held):
            self.store(k)
        return [(k, -top, self.sizes[k]) for top, k in self.tops]


class HostQueues(StatefulProcessor):
    """A host's queue: newest task first, one pull at a time, the next one when the delay of the last is over.

    Tasks are in blocks by seq in a map state (see Newest), so that a push or a
    pull costs a small part of a call to the state, in whatever order a batch
    brings them, and neither a batch nor a queue is ever held whole. A timer
    stands at the next pull time, while there are tasks, or else at the end of
    the last delay, when the host goes. With ttl_ms, which needs the clock of the
    machine, a queue that nothing has touched for so long goes too.
    """

    def __init__(self, event_time: bool, ttl_ms: int | None):
        self.event_time, self.ttl_ms = event_time, ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.blocks = handle.getMapState("blocks", "block long", "seqs array<long>, delays array<double>", self.ttl_ms)
        self.queue = handle.getValueState("queue", "turn long, free double, waits boolean, blocks array<long>, tops array<long>, sizes array<long>", self.ttl_ms)

    def now(self, timerValues: TimerValues) -> int:
        return timerValues.getCurrentWatermarkInMs() if self.event_time else timerValues.getCurrentProcessingTimeInMs()

    def keep(self, turn: int, free: float, tasks: Newest) -> None:
        index = tasks.close()
        self.queue.update((turn, free, True, *([x[k] for x in index] for k in range(3))))

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues: TimerValues) -> Iterator[Row]:
        turn, free, waits, *index = self.queue.get() or (0, 0.0, False, [], [], [])
        tasks, first = Newest(self.blocks, list(zip(*index, strict=True))), None
        idle = not len(tasks)
        while some := [(row.seq, row.delay or 0.0, row.at_ms) for row in islice(rows, TAKEN)]:
            tasks.push([x[:2] for x in some])
            came = min(x[2] for x in some)
            first = came if first is None else min(first, came)
        if idle and first is not None:
            free = max(free, float(first))
        if not waits:
            self.handle.registerTimer(max(int(free), self.now(timerValues) + 1))
        self.keep(turn, free, tasks)
        return iter(())

    def handleExpiredTimer(self, key: tuple, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[Row]:
        state = self.queue.get()
        if state is None:
            return
        turn, free, _, *index = state
        tasks, now = Newest(self.blocks, list(zip(*index, strict=True))), self.now(timerValues)
        while free <= now and (task := tasks.pull()):
            turn += 1
            yield Row(host=key[0], seq=task[0], turn=turn, pulled_ms=free)
            free += 1000.0 * task[1]
        if not tasks.tops and free <= now:
            self.queue.clear()
            return
        self.handle.registerTimer(max(math.ceil(free), now + 1))
        self.keep(turn, free, tasks)


def host_queues(tasks: DataFrame, event_time: bool = True, ttl_ms: int | None = None) -> DataFrame:
    """host, seq, turn, pulled_ms for a stream of tasks (host, seq, delay in seconds, at_ms: when it came, in milliseconds).

    With event_time the clock is the tasks' watermark, so that a stream is
    answered alike however often it runs: a pull comes out once the watermark
    has passed its time. Else it is the machine's. Needs the RocksDB state store.
    """
    tasks.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    rows = tasks.where("host is not null").select("host", "seq", "delay", "at_ms", *([F.timestamp_millis("at_ms").alias("at")] if event_time else []))
    rows = rows.withWatermark("at", "0 seconds") if event_time else rows
    return rows.groupBy("host").transformWithState(
        statefulProcessor=HostQueues(event_time, ttl_ms), outputStructType="host string, seq long, turn long, pulled_ms double", outputMode="Append", timeMode="EventTime" if event_time else "ProcessingTime"
    )


def taken(spark: SparkSession, queue: str, schema: str, out: str, state: str, files: int | None = None, delete: bool = True) -> DataFrame:
    """Takes what is in a queue (a folder of Parquet files) into the table at out, and returns all that was taken so far.

    A row is taken once, also when a run failed and another one goes on with the
    same state: offsets are committed there, and a batch that was not is taken
    again into the same files. With delete, files that were taken go. files: so
    many at most in a batch.
    """
    rows = spark.readStream.schema(schema).option("cleanSource", "delete" if delete else "off")
    rows = (rows.option("maxFilesPerTrigger", files) if files else rows).parquet(queue)
    return drained(rows, "taken", out, state)


def heartbeats(beats: DataFrame) -> DataFrame:
    """The latest state of each worker (id, event_id, event_type) so far; for output mode update or complete."""
    return mo.latest(beats)


def watched(beats: DataFrame, nodes: int, own: int, tag: str = "beats", state: str | None = None) -> DataFrame:
    """One row: the totals over the latest heartbeat of each worker, and their verdict, when that ends the run or no beats are left.

    beats: a stream of id, seq and monitor.COUNTERS, each null where a beat does
    not give it. Each batch updates the workers' table and looks at its totals;
    the stream stops at the first verdict. own: this worker's id.

    state: the folder of the checkpoint and of the workers' table. A watch that
    failed is taken up by a call with the same folder, and one that came to its
    verdict gives that again. The table holds a row for each counter that a
    worker has given, with the seq of that beat, so a late beat changes what it
    is the last to tell and nothing else; it is written to two folders in turn,
    each batch reading the one before, so a batch that runs again finds what it
    had found.
    """
    spark = beats.sparkSession
    root = state or new_path(spark, tag)
    schema = "id long, counter string, seq long, value long, batch long"
    over: list[int] = []  # the batch that came to a verdict; later ones are left alone

    def workers(slot: int) -> DataFrame:
        path = f"{root}/workers-{slot}"
        whole = exists(spark, f"{path}/_SUCCESS")  # not where a writer was lost half-way
        return spark.read.schema(schema).parquet(path) if whole else spark.createDataFrame([], schema)

    def outcome(table: DataFrame) -> DataFrame:
        given = [F.max(F.when(F.col("counter") == k, F.col("value"))).alias(k) for k in mo.COUNTERS]
        return mo.completion(table.groupBy("id").agg(*given), nodes, own)

    def ended(table: DataFrame) -> bool:
        return outcome(table).first()["verdict"] is not None

    def newest() -> DataFrame:
        return max((workers(k) for k in (0, 1)), key=lambda table: table.agg(F.coalesce(F.max("batch"), F.lit(-1))).first()[0])

    def look(batch: DataFrame, number: int) -> None:
        if over:
            return
        held = workers((number + 1) % 2).where(F.col("batch") < number)
        told = batch.select(F.col("id").cast("long"), F.col("seq").cast("long"), *(F.col(k).cast("long") for k in mo.COUNTERS))
        told = told.unpivot(["id", "seq"], list(mo.COUNTERS), "counter", "value").where("value is not null")
        every = told.unionByName(held.select("id", "seq", "counter", "value"))
        last = every.groupBy("id", "counter").agg(F.max(F.struct("seq", "value")).alias("last"))
        found = last.select("id", "counter", "last.seq", "last.value", F.lit(number).cast("long").alias("batch"))
        found.write.mode("overwrite").parquet(f"{root}/workers-{number % 2}")
        if ended(workers(number % 2)):
            over.append(number)

    if ended(newest()):
        return outcome(newest())
    run = beats.writeStream.foreachBatch(look).option("checkpointLocation", f"{root}/checkpoint").trigger(availableNow=True).start()
    while run.isActive and not over:
        run.awaitTermination(1)
    run.stop()
    if run.exception() is not None:
        raise run.exception()
    return outcome(newest())


def capped_writer(stream: DataFrame, path: str, most: int, state: str | None = None) -> DataFrame:
    """Appends the stream's rows to the table at path until `most` are there; the rest is taken from the stream and not written.

    One row: written, drained, active (false once the cap was reached), over all
    runs. state: the folder of the stream's checkpoint, beside the table if not
    given, so that a run again goes on where the one before ended. A batch that
    is run again after a failure replaces its own rows, as it writes to a folder
    of its number, and each folder's counts stand in a file of their own; the
    rows that still fit are the first of the batch in its order.
    """
    spark = stream.sparkSession
    counts = f"{path}-counts"

    def before(number: int | None = None) -> tuple[int, int]:
        """Rows written and drained so far, or by the batches before one."""
        if not exists(spark, counts):
            return 0, 0
        rows = spark.read.schema("written long, drained long, batch int").parquet(counts)
        rows = rows if number is None else rows.where(F.col("batch") < number)
        return rows.agg(F.coalesce(F.sum("written"), F.lit(0)), F.coalesce(F.sum("drained"), F.lit(0))).first()

    def write(batch: DataFrame, number: int) -> None:
        room, came = max(0, most - before(number)[0]), batch.count()
        written = min(room, came)
        batch.limit(written).write.mode("overwrite").parquet(f"{path}/batch={number}")
        spark.createDataFrame([(written, came - written)], "written long, drained long").coalesce(1).write.mode("overwrite").parquet(f"{counts}/batch={number}")

    run = stream.writeStream.foreachBatch(write).option("checkpointLocation", state or f"{path}-state").trigger(availableNow=True).start()
    run.awaitTermination()
    written, left = before()
    return spark.createDataFrame([(written, left, written < most)], "written long, drained long, active boolean")


class FailureLog(StreamingQueryListener):
    """Notes how streams end: a failed one leaves its error, for recorded() to write."""

    def __init__(self) -> None:
        self.ended: dict[str, str | None] = {}

    def onQueryStarted(self, event) -> None:
        self.ended.pop(str(event.id), None)

    def onQueryProgress(self, event) -> None:
        pass

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        self.ended[str(event.id)] = event.exception


def recorded(start: Callable[[], StreamingQuery], path: str, *queues: DataFrame) -> bool:
    """Starts a stream and waits for its end; true if it ended well.

    If it failed, the error goes to path/failures (id, error, and a failure flag
    as workers report it), and the URLs of all queues to path/dump, for the next
    start to read by restarted(). A later failure replaces the dump and is added
    to the failures.
    """
    spark, log = SparkSession.active(), FailureLog()
    spark.streams.addListener(log)
    try:
        run = start()
        with contextlib.suppress(StreamingQueryException):
            run.awaitTermination()
        end = time.monotonic() + 30
        while str(run.id) not in log.ended and time.monotonic() < end:  # the listener hears of it a little later
            time.sleep(0.05)
        error = log.ended.get(str(run.id)) or (str(run.exception()) if run.exception() is not None else None)
    finally:
        spark.streams.removeListener(log)
    if error is None:
        return True
    spark.createDataFrame([(str(run.id), error, 1)], "id string, error string, failure int").coalesce(1).write.mode("append").parquet(f"{path}/failures")
    held = bag_union(*queues) if queues else spark.createDataFrame([], "url string")
    held.write.mode("overwrite").text(f"{path}/dump")
    return False


def restarted(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """What recorded() left at path: the failures, and the dumped URLs; both empty where nothing failed."""
    failures = "id string, error string, failure int"
    if not exists(spark, f"{path}/failures"):
        return spark.createDataFrame([], failures), spark.createDataFrame([], "url string")
    return spark.read.schema(failures).parquet(f"{path}/failures"), spark.read.text(f"{path}/dump").withColumnRenamed("value", "url")


def send(messages: DataFrame, path: str) -> None:
    """Messages (node, url, parent_url), as files of JSON lines in a folder for each node; a sender that got no answer may send again."""
    messages.select("node", "url", "parent_url", F.col("node").alias("to")).repartition("to").write.mode("append").partitionBy("to").json(path)


def received(spark: SparkSession, path: str) -> DataFrame:
    """The stream of messages sent to path, each once: those sent again are told by what they say."""
    rows = spark.readStream.schema(MESSAGE + ", `to` int").json(path).drop("to")
    return rows.dropDuplicates(["node", "url", "parent_url"])


def drained(stream: DataFrame, tag: str, out: str | None = None, state: str | None = None) -> DataFrame:
    """All that the stream's source has now, processed and stored; its checkpoint and result are in the shared folder.

    A run that failed is taken up again by a call with the same `out` and
    `state`: what was finished is not done twice, and nothing is left out.
    """
    spark: SparkSession = stream.sparkSession
    out = out or new_path(spark, tag)
    run = stream.writeStream.format("parquet").option("checkpointLocation", state or new_path(spark, f"{tag}-state")).trigger(availableNow=True).start(out)
    run.awaitTermination()
    return spark.read.schema(stream.schema).parquet(out)


def source(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table's files as a stream."""
    schema = spark.read.parquet(f"{sf_dir}/{name}.parquet").schema
    # A pattern, as the table may be one file or a folder of files, and a stream takes a plain path for a folder.
    return spark.readStream.schema(schema).parquet(f"{sf_dir}/{name}.parque[t]")
