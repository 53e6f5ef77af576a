"""The URL frontier: admission, routing, politeness, capacity, and expansion hop by hop."""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import urls as u
from ..functions.text import Text, as_column
from ..sources.tables import stored
from . import skew as sk
from .seen import SeenFilter

#: Seconds of base delay, hosts that are served at once, seconds that an address stays valid.
BASE_DELAY, LIVE_HOSTS, ADDRESS_AGE = 60.0, 6, 21_600
#: Numbers of seq that one task sums up at once; a host with more is summed in parts.
PART = 1 << 16


def unseen(candidates: DataFrame, seen: DataFrame, sieve: SeenFilter | None = None) -> DataFrame:
    """Candidates (url, seq, ...) whose url is new: the first of each by seq, none of seen (url).

    With a sieve that all of seen is in, only the few candidates that it lets
    through are looked up in seen; the result is the same.
    """
    first = candidates.groupBy("url").agg(F.min_by(F.struct(*candidates.columns), "seq").alias("c")).select("c.*")
    if sieve is None:
        return first.join(seen.select("url").distinct(), "url", "left_anti")
    asked = stored(sieve.maybe(first), "asked")
    doubtful = asked.where("maybe").drop("maybe")
    # The doubtful ones are the small side of this join, and the large side is read once.
    known = seen.select("url").join(doubtful.select("url"), "url", "left_semi").distinct()
    return asked.where("not maybe").drop("maybe").unionByName(doubtful.join(known, "url", "left_anti"))


def is_stale(now: Column, checked: Column, age: int = ADDRESS_AGE) -> Column:
    """Whether an address is too old, or there is none."""
    return F.coalesce(F.unix_timestamp(now) - F.unix_timestamp(checked) > age, F.lit(True))


def addresses(rows: DataFrame, known: DataFrame, now: Column, age: int = ADDRESS_AGE) -> DataFrame:
    """rows (host, ...) with addr and stale: the known address (host, addr, checked_at), and whether it is too old. A host may have a third of all rows."""
    found = sk.dealt_join(rows, known, ["host"], F.struct(*rows.columns), "left")
    return found.withColumn("stale", is_stale(now, F.col("checked_at"), age)).drop("checked_at")


def addresses_then(requests: DataFrame, lookups: DataFrame, age: int = ADDRESS_AGE) -> DataFrame:
    """requests (host, at, ...) with addr, checked_at and stale, as they were at the time of each: by the last lookup of its host up to then.

    lookups: host, at, seq, addr; a null addr is a lookup that failed, after
    which the host has no address. Of lookups of one time the last by seq counts,
    and a request of that time knows it. Both are sorted together by host and
    time, in ranges, and the last lookup is carried on from range to range.
    """
    asked = requests.select("host", "at", F.lit(1).alias("side"), F.lit(None).cast("long").alias("seq"), F.struct(*requests.columns).alias("r"), F.lit(None).alias("known"))
    told = lookups.select("host", "at", F.lit(0).alias("side"), F.col("seq").cast("long").alias("seq"), F.lit(None).alias("r"), F.struct("addr", F.col("at").alias("checked_at")).alias("known"))
    both = sk.in_ranges(asked.unionByName(told.where("host is not null")), "host", "at", "side", "seq")
    found = sk.carried(both, "host", F.col("known"), "last", itself=True).where("side = 1")
    stale = is_stale(F.col("r.at"), F.col("last.checked_at"), age) | F.col("last.addr").isNull()
    return found.select("r.*", F.col("last.addr").alias("addr"), F.col("last.checked_at").alias("checked_at"), stale.alias("stale"))


def to_refresh(requests: DataFrame) -> DataFrame:
    """host, at of addresses_then() whose latest request found no address, or one that was too old."""
    last = requests.groupBy("host").agg(F.max(F.struct("at", "stale")).alias("last"))
    return last.where("host is not null and last.stale").select("host", "last.at")


def resolvable(rows: DataFrame) -> DataFrame:
    """rows of addresses() whose host has one."""
    return rows.where(F.col("addr").isNotNull())


def child_distance(host: Column, parent_host: Column, distance: Column) -> Column:
    """Links inside a host keep its distance from the seeds; others are one further."""
    return F.when(host == parent_host, distance).otherwise(distance + 1)


def admitted(candidates: DataFrame, seen: DataFrame, most: int = 0, blocked: str = u.BLOCKED, sieve: SeenFilter | None = None) -> DataFrame:
    """One pass of admission over candidates (url, seq, parent_url, distance).

    In this order: drop one trailing slash, drop blocked URLs, take those never
    seen (all that get here count as seen from now on), then drop unsafe paths
    and what is more than `most` hosts away (-1: no limit). Returns url, seq,
    parent_url, host, distance, admitted; rows that are not admitted are seen.
    """
    rows = candidates.select(u.normal_url("url").alias("url"), "seq", "parent_url", "distance").where(~u.is_blocked("url", blocked))
    rows = unseen(rows, seen, sieve)
    rows = rows.withColumn("host", u.host("url")).withColumn("distance", child_distance(F.col("host"), u.host("parent_url"), F.col("distance")))
    fits = u.is_safe("url") & (F.lit(most < 0) | (F.col("distance") <= most))
    return rows.select("url", "seq", "parent_url", "host", "distance", fits.alias("admitted"))


def delay(success: Column, seconds: Column, draw: Column, base: float = BASE_DELAY) -> Column:
    """Seconds until a host may be asked again; draw is uniform from 0 to 1."""
    return F.when(success, 10.0 * seconds + draw * base).otherwise((0.5 + draw) * base)


def fixed_draw(key: Column) -> Column:
    """A repeatable draw from 0 to 1: 32 bits of the key's MD5."""
    return F.conv(F.substring(F.md5(key.cast("string").cast("binary")), 1, 8), 16, 10).cast("double") / float(1 << 32)


def running(tasks: DataFrame, value: Column, newest: bool = False) -> DataFrame:
    """tasks (host, seq) with `before`: the sum of value over the host's tasks before each, or after it if newest.

    In two levels, inside ranges of PART numbers of seq and over the ranges, so
    that a host with a third of all tasks is in no one task.
    """
    order = F.desc if newest else F.asc
    rows = tasks.withColumn("_value", value).withColumn("_part", F.floor(F.col("seq") / PART))
    over = lambda *keys: W.partitionBy(*keys).rowsBetween(W.unboundedPreceding, -1)
    sums = rows.groupBy("host", "_part").agg(F.sum("_value").alias("_sum"))
    sums = sums.select("host", "_part", F.sum("_sum").over(over("host").orderBy(order("_part"))).alias("_far"))
    rows = rows.withColumn("_near", F.sum("_value").over(over("host", "_part").orderBy(order("seq"))))
    rows = rows.join(sums, ["host", "_part"])
    return rows.select(*tasks.columns, (F.coalesce("_near", F.lit(0)) + F.coalesce("_far", F.lit(0))).alias("before"))


def pull_times(tasks: DataFrame) -> DataFrame:
    """tasks (host, seq, delay) with start: the sum of the delays before it on its host, one at a time. Null hosts have no queue and go."""
    return running(tasks, F.col("delay").cast("double")).withColumn("start", F.col("before").cast("double")).drop("before")


def queue_order(tasks: DataFrame, *by: str) -> DataFrame:
    """tasks with rank, from 1, in the order of the columns `by`: sorted in ranges, and only the ranges' sizes are added up in one place."""
    # Numbered by file and place in it: an id is the number of its range, shifted by 33 bits, plus the place in that range.
    placed = stored(tasks.orderBy(*by).withColumn("_at", F.monotonically_increasing_id()), "queue")
    part = F.shiftright("_at", 33)
    sizes = placed.groupBy(part.alias("_part")).agg(F.count("*").alias("_n"))
    before = sizes.select("_part", F.coalesce(F.sum("_n").over(W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    ranked = placed.withColumn("_part", part).join(F.broadcast(before), "_part")
    return ranked.select(*tasks.columns, (F.col("_before") + F.col("_at") - F.shiftleft("_part", 33) + 1).alias("rank"))


def host_slots(tasks: DataFrame, slots: int = LIVE_HOSTS) -> DataFrame:
    """tasks (host, seq) with slot, the rank of the host by its first task, and live (slot within slots); others overflow."""
    firsts = tasks.groupBy("host").agg(F.min("seq").alias("at"))
    # Only the first `slots` hosts matter, and those are found without sorting all of them in one task.
    live = firsts.orderBy("at", "host").limit(slots).withColumn("slot", F.row_number().over(W.orderBy("at", "host")).cast("long"))
    ranked = tasks.join(F.broadcast(live.select("host", "slot")), "host", "left")
    return ranked.withColumn("live", F.col("slot").isNotNull())


def initialised(seeds: DataFrame, slots: int = LIVE_HOSTS) -> DataFrame:
    """Which host queue each seed (host, seq) comes into when a frontier begins, and its turn there: host, seq, slot, turn.

    Seeds are taken from the end until `slots` hosts have a queue; then the rest
    follow from the front, into the queues of their hosts or, where a host has
    none (slot null), into overflow, whose turns are in the order in which they
    came. A queue's first seed is its host's first task (turn 1), and the others
    are pulled in the reverse of the order in which they came. Slots that no
    host takes are empty queues: a row without host and seq.
    """
    tops = seeds.groupBy("host").agg(F.max("seq").alias("top")).where("host is not null")
    # Only the first hosts from the end matter, and those are found without sorting all in one task.
    live = tops.orderBy(F.desc("top"), "host").limit(slots).withColumn("slot", F.row_number().over(W.orderBy(F.desc("top"), "host")).cast("long"))
    live = stored(live, "live")
    taken, cut = live.agg(F.count("*"), F.min("top")).first()
    low = seeds.agg(F.coalesce(F.min("seq"), F.lit(0))).first()[0]
    # With a slot left, all seeds are taken from the end; else those down to the first one of the last host.
    from_end = F.lit(True) if taken < slots else F.col("seq") >= cut
    came = F.when(from_end, -F.col("seq")).otherwise(F.col("seq") - low - (cut or 0) + 1)
    rows = seeds.where("host is not null").join(F.broadcast(live), "host", "left")
    rows = rows.select("host", F.col("seq").alias("number"), "slot", (F.col("seq") == F.col("top")).alias("first"), came.alias("seq"))
    queued = running(rows.where("slot is not null"), F.lit(1), newest=True)
    queued = queued.select("host", F.col("number").alias("seq"), "slot", F.when(F.col("first"), 1).otherwise(F.col("before") + 2).cast("long").alias("turn"))
    rest = queue_order(rows.where("slot is null"), "seq").select("host", F.col("number").alias("seq"), "slot", F.col("rank").cast("long").alias("turn"))
    empty = seeds.sparkSession.range(taken + 1, slots + 1).select(F.lit(None).cast("string").alias("host"), F.lit(None).cast("long").alias("seq"), F.col("id").alias("slot"), F.lit(None).cast("long").alias("turn"))
    return queued.unionByName(rest).unionByName(empty)


def newest_first(tasks: DataFrame) -> DataFrame:
    """tasks (host, seq) with turn: 1 for the latest of each host."""
    return running(tasks, F.lit(1), newest=True).withColumn("turn", (F.col("before") + 1).cast("long")).drop("before")


def host_turns(tasks: DataFrame, slots: int = LIVE_HOSTS) -> DataFrame:
    """tasks (host, seq, delay) with slot, opens and start, when at most `slots` hosts have a queue at once.

    A host holds its slot until its last delay is over; then the queue is
    dropped, and the slot goes to the first host that waits in overflow, all of
    whose tasks come into the new queue. Hosts wait in the order of their first
    tasks (then by name). Only the hosts' totals go through one task, in that
    order; it keeps the `slots` times at which slots are free.
    """
    totals = tasks.groupBy("host").agg(F.min("seq").alias("at"), F.sum("delay").alias("busy"))

    def serve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        free = [(0.0, k) for k in range(1, slots + 1)]
        for batch in batches:
            out = []
            for host, busy in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), strict=True):
                opens, slot = heapq.heappop(free)
                heapq.heappush(free, (opens + (busy or 0.0), slot))
                out.append((host, slot, opens))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(x, kind) for x, kind in zip(zip(*out, strict=True), (pa.string(), pa.int64(), pa.float64()), strict=True)], ["host", "slot", "opens"])

    given = totals.repartition(1).sortWithinPartitions("at", "host").mapInArrow(serve, "host string, slot long, opens double")
    return pull_times(tasks).join(given, "host").withColumn("start", F.col("start") + F.col("opens"))


def expand(edges: DataFrame, seeds: DataFrame, hops: int | None = None) -> DataFrame:
    """node, hop: all nodes (column node of seeds) that edges (src, dst) reach, with the least number of hops; those within `hops`, if given.

    Hop by hop; each hop's new nodes are stored, so the plan does not grow but
    by one file list a hop, and the loop ends when nothing new is found.
    """
    seen = front = stored(seeds.select("node").distinct().withColumn("hop", F.lit(0).cast("long")), "hop")
    hop = 0
    while hops is None or hop < hops:
        hop += 1
        found = front.join(edges, front["node"] == edges["src"]).select(F.col("dst").alias("node")).distinct()
        front = stored(found.join(seen, "node", "left_anti").withColumn("hop", F.lit(hop).cast("long")), "hop")
        if front.isEmpty():
            break
        seen = seen.unionByName(front)
    return seen


def page_key(url: Text) -> Column:
    """What a URL is looked up by: no fragment, no trailing slash."""
    return u.normal_url(F.regexp_replace(as_column(url), "(?d)#.*$", ""))


def edge_table(pages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """What a crawl needs of the web: key, page_id of what a URL finds (the least page_id of a key), and key, page_id, links (pos, url) of those of these pages that have any. html is read once."""
    keys = stored(pages.select(page_key("url").alias("key"), "page_id").groupBy("key").agg(F.min("page_id").alias("page_id")), "keys")
    links = u.page_links(pages.select("page_id", page_key("url").alias("url"), "html"))
    links = links.groupBy("page_id").agg(F.collect_list(F.struct("pos", "url")).alias("links"))
    return keys, stored(links.join(keys, "page_id").select("key", "page_id", "links"), "edges")


def crawl(pages: DataFrame, seeds: DataFrame, most: int = 0, blocked: str = u.BLOCKED, sieve: SeenFilter | None = None) -> DataFrame:
    """The whole loop: fetch, extract, filter, dedup, enqueue, until nothing is in flight.

    pages: page_id, url, html, which stand for the web (a URL without a page is
    a failed fetch); seeds: url. Each hop takes the links of the pages that the
    frontier's URLs find, and admits them by admitted(), with the links
    of the pages fetched first, and of one page the first ones, first. Seeds are
    never tested for having been seen, but for being blocked or unsafe. Returns
    a row for each URL that was queued: url, hop, distance, parent_url, page_id
    (null: not fetched). Documents by type are queued, not read for links. Links
    are extracted once, and a page's are filed under the key by which it is
    found, so a hop shuffles its own links and what was seen before; a frontier
    that fits a broadcast leaves the links where they are. All page_ids are
    looked up once, at the end. Each hop's URLs are stored, and added to the
    sieve, if one is given; it then spares the hops from comparing all
    candidates with all that was seen, which pays where hops are many and small.
    """
    keys, edges = edge_table(pages)

    def queued(rows: DataFrame, *by: str) -> DataFrame:
        # Sorted in ranges; a row's number is that of its range, shifted, plus its place there.
        return stored(rows.orderBy(*by).withColumn("seq", F.monotonically_increasing_id()), "frontier")

    first = seeds.select(u.normal_url("url").alias("url"), F.monotonically_increasing_id().alias("seq"))
    seen = stored(first.groupBy("url").agg(F.min("seq").alias("seq")), "seeds")
    if sieve:
        sieve.add(seen)
    begin = seen.where(~u.is_blocked("url", blocked) & u.is_safe("url"))
    front = queued(begin.select("url", "seq", F.lit(None).cast("string").alias("parent_url"), F.lit(0).alias("distance")), "seq", "url")
    done, hop = [], 0
    while hop == 0 or not front.isEmpty():
        done.append(front.select("url", F.lit(hop).alias("hop"), "distance", "parent_url"))
        read = front.where(~u.is_document("url")).select(page_key("url").alias("key"), F.col("url").alias("parent_url"), "seq", "distance")
        links = read.join(edges, "key").select("page_id", "parent_url", "seq", "distance", F.explode("links").alias("link"))
        links = links.select(F.col("link.url").alias("url"), F.struct("seq", "page_id", "link.pos").alias("seq"), "parent_url", "distance")
        found = queued(admitted(links, seen, most, blocked, sieve).select("url", "seq", "parent_url", "distance", "admitted"), "seq")
        if sieve:
            sieve.add(found)
        seen = seen.select("url").unionByName(found.select("url"))
        front = found.where("admitted").drop("admitted")
        hop += 1
    rows = reduce(DataFrame.unionByName, done).withColumn("key", page_key("url"))
    return rows.join(keys, "key", "left").drop("key")
