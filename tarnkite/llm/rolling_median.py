"""Exact rolling median and MAD of skewed series by a square-root decomposition table.

The rows of a series in order of time are cut into tiles, about as many as a
shuffle has partitions, by bounds on (series, time, row) from a bounded sample;
the bounds decide where rows are worked on, never a result. A row goes to the
tile in which it arrives and, if that is another one, to the tile in which it
leaves its window. Inside a tile the table has a row for each boundary of a
block of time and a column for each bucket of values, and holds cumulative
counts. The rows at a window's end and at its beginning are subtracted and
corrected by what their two partial blocks hold; then one bucket is scanned for
the wanted rank. The MAD bisects the radius around the median, and each step
counts by the same table.

Rows that arrive before a tile and leave after it are in all its windows. They
are not copied there: a second table, over all tiles and buckets, gives their
cumulative counts (arrivals less departures), and only the buckets that a tile's
answers fall into are fetched, with equal values added up.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import _common as c
from . import _tokens as t

#: Microseconds of a window; sampled rows a tile, and in all at least; value buckets of the table over all tiles.
SPAN, SAMPLED, LEAST_SAMPLED, BUCKETS = 15 * 60 * 1_000_000, 128, 8192, 256
#: Distinct times that are answered at once; cents from which on a value counts as none (|8 * cents| must fit a long).
AT_ONCE, MOST_CENTS = 1024, 1 << 58
#: What a row of a tile is: it arrives here, came from before and leaves here, is a value of a fetched bucket, is a bucket's count, names a fetched bucket.
OWN, CARRIED, VALUE, COUNT, FETCHED = range(5)
TILE_ROW = "pid int, tag int, kind string, ts long, cents long, click_id long, n long, bucket int"
#: What the solver says: an answer, a click whose time goes on in another tile, such a time's answer so far, a bucket that is needed.
ANSWER, PENDING, SO_FAR, NEED = range(4)
SAID = "state int, pid int, click_id long, kind string, ts long, cents long, n long, median2 long, mad4 long, bucket int"


def cents(value: str) -> Column:
    """floor(100 * value + 0.5) as long; null for null, NaN and what is beyond MOST_CENTS."""
    scaled = F.col(value) * 100 + 0.5
    return F.floor(F.when(F.abs(scaled) < MOST_CENTS, scaled)).cast("long")


class Bounds:
    """Where tiles begin: sorted (kind, time, tie); tile p holds what is above bound p - 1 and not above bound p."""

    def __init__(self, rows: list[tuple], tiles: int):
        key = lambda r: (r[0] is not None, r[0] or "", *r[1:])
        rows = sorted(rows, key=key)
        self.rows = [rows[len(rows) * k // tiles] for k in range(1, tiles)] if rows else []
        self.kinds = [key(r)[:2] for r in self.rows]
        self.times = np.array([r[1] for r in self.rows], np.int64)
        self.ties = np.array([r[2] for r in self.rows], np.int64)

    def tile(self, kind: str | None, time: np.ndarray, tie: np.ndarray) -> np.ndarray:
        """The tiles of elements of one kind: the number of bounds below each."""
        own = (kind is not None, kind or "")
        low = bisect_left(self.kinds, own)
        high = low + self.kinds[low:].count(own)
        times, ties = self.times[low:high], self.ties[low:high]
        left, right = np.searchsorted(times, time, "left"), np.searchsorted(times, time, "right")
        out = left.copy()
        on = np.flatnonzero(right > left)
        for a in np.unique(left[on]).tolist():
            these = on[left[on] == a]
            out[these] = a + np.searchsorted(ties[a : right[these[0]]], tie[these], "left")
        return out + low

    def at_edge(self, pid: int) -> set[tuple]:
        """The (kind, time) that tile pid may share with its neighbours."""
        return {self.rows[k][:2] for k in (pid - 1, pid) if 0 <= k < len(self.rows)}


def ties(click_id: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """What orders elements of one time: departures come before arrivals, and either by a hash of the id."""
    mark = t.mixed(click_id.fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)) >> np.uint64(2)
    return mark.astype(np.int64), mark.astype(np.int64) + (1 << 62)


def micros(column: pa.Array) -> np.ndarray:
    return column.cast(pa.timestamp("us", column.type.tz)).cast(pa.int64()).to_numpy(zero_copy_only=False).astype(np.int64)


def once_and_tiled(bounds: Bounds, span: int):
    """For mapInArrow over (click_id, ts, kind, cents) sorted by these: each id's first row, with the tiles of its arrival and departure."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: object = scan  # no id
        for batch in batches:
            ids = batch.column(0)
            if not len(ids):
                continue
            values, none = ids.fill_null(0).to_numpy(zero_copy_only=False), ids.is_null().to_numpy(zero_copy_only=False)
            new = np.ones(len(ids), bool)
            new[1:] = (values[1:] != values[:-1]) | (none[1:] != none[:-1])
            new[0] = ids[0].as_py() != last
            last = ids[-1].as_py()
            batch = batch.filter(pa.array(new))
            if not batch.num_rows:
                continue
            ts, (leaves, arrives) = micros(batch.column(1)), ties(batch.column(0))
            coded = batch.column(2).dictionary_encode()
            code = coded.indices.fill_null(-1).to_numpy(zero_copy_only=False)
            here, gone = np.zeros(len(ts), np.int32), np.zeros(len(ts), np.int32)
            order = np.argsort(code, kind="stable")
            for at in np.split(order, np.flatnonzero(np.diff(code[order])) + 1):
                kind = batch.column(2)[int(at[0])].as_py()
                here[at], gone[at] = bounds.tile(kind, ts[at], arrives[at]), bounds.tile(kind, ts[at] + span, leaves[at])
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(ts), batch.column(3), pa.array(here), pa.array(gone)], ["click_id", "kind", "ts", "cents", "here", "gone"])

    return scan


class Table:
    """Cumulative counts of some values in order of time, at boundaries of blocks of time, by bucket of values; and `always`: values (with counts) that are in every window."""

    def __init__(self, values: np.ndarray, always: np.ndarray, counts: np.ndarray):
        m = len(values) + len(always)
        both = np.concatenate([values, always])
        order = np.argsort(both, kind="stable")
        self.sorted = both[order]
        self.wide = max(8, -(-m // 1024))
        self.buckets = -(-m // self.wide)
        pad = self.buckets * self.wide - m
        # A value's place in time; those of `always` have none, and padding is never inside a window.
        index = np.where(order < len(values), order, -1)
        self.index = np.concatenate([index, np.full(pad, 1 << 40)]).reshape(self.buckets, self.wide)
        self.weight = None
        if len(always):
            weight = np.ones(m, np.int64)
            weight[order >= len(values)] = counts[order[order >= len(values)] - len(values)]
            self.weight = np.concatenate([weight, np.zeros(pad, np.int64)]).reshape(self.buckets, self.wide)
        rank = np.empty(m, np.int64)
        rank[order] = np.arange(m)
        self.bucket = (rank // self.wide)[: len(values)]
        self.block = max(16, int(len(values) ** 0.5))
        rows = len(values) // self.block + 1
        cells = np.bincount(np.arange(len(values)) // self.block * self.buckets + self.bucket, minlength=rows * self.buckets).reshape(rows, self.buckets)
        self.table = np.zeros((rows + 1, self.buckets), np.int64)
        np.cumsum(cells, axis=0, out=self.table[1:])
        self.base = np.bincount((rank // self.wide)[len(values) :], counts, self.buckets).astype(np.int64) if len(always) else None

    def partial(self, at: np.ndarray) -> np.ndarray:
        """For each place in time, counts by bucket between the boundary of a block before it and it."""
        reach = at % self.block
        most = int(reach.max(initial=0))
        spots = (at - reach)[:, None] + np.arange(most)
        inside = np.arange(most) < reach[:, None]
        cells = np.repeat(np.arange(len(at)), reach) * self.buckets + self.bucket[spots[inside]]
        return np.bincount(cells, minlength=len(at) * self.buckets).reshape(len(at), self.buckets)

    def open(self, low: np.ndarray, high: np.ndarray) -> None:
        """The windows to ask about, each from one place in time up to another."""
        self.low, self.high = low[:, None], high[:, None]
        inside = self.table[high // self.block] - self.table[low // self.block] + self.partial(high) - self.partial(low)
        if self.base is not None:
            inside = inside + self.base
        self.upto = np.zeros((len(low), self.buckets + 1), np.int64)
        np.cumsum(inside, axis=1, out=self.upto[:, 1:])
        self.n = self.upto[:, -1]

    def scan(self, bucket: np.ndarray) -> np.ndarray:
        """How often each value of a bucket is in the window."""
        index = self.index[bucket]
        inside = (index >= self.low) & (index < self.high)
        return inside if self.weight is None else (inside | (index < 0)) * self.weight[bucket]

    def pick(self, k: np.ndarray) -> np.ndarray:
        """The place, in order of values, of each window's k-th least value (from 1)."""
        bucket = np.minimum((self.upto[:, 1:] < k[:, None]).sum(axis=1), self.buckets - 1)
        left = k - np.take_along_axis(self.upto, bucket[:, None], 1)[:, 0]
        return np.minimum(bucket * self.wide + (np.cumsum(self.scan(bucket), axis=1) < left[:, None]).sum(axis=1), len(self.sorted) - 1)

    def below(self, place: np.ndarray) -> np.ndarray:
        """How many values of each window are before a place in the order of values."""
        bucket = np.minimum(place // self.wide, self.buckets - 1)
        part = np.arange(self.wide) < (place - bucket * self.wide)[:, None]
        return np.take_along_axis(self.upto, bucket[:, None], 1)[:, 0] + (self.scan(bucket) * part).sum(axis=1)

    def within(self, middle2: np.ndarray, radius: np.ndarray) -> np.ndarray:
        """How many values x of each window have |2 * x - middle2| <= radius."""
        return self.below(np.searchsorted(self.sorted, (middle2 + radius) // 2, "right")) - self.below(np.searchsorted(self.sorted, -((radius - middle2) // 2), "left"))

    def radius(self, middle2: np.ndarray, k: np.ndarray) -> np.ndarray:
        """The least radius that holds k values, by bisection."""
        low, high = np.full(len(k), -1), np.maximum(np.abs(2 * self.sorted[-1] - middle2), np.abs(2 * self.sorted[0] - middle2))
        while (high - low > 1).any():
            middle = (low + high) // 2
            enough = self.within(middle2, middle) >= k
            low, high = np.where(enough, low, middle), np.where(enough, middle, high)
        return high

    def next_radius(self, middle2: np.ndarray, radius: np.ndarray, k: np.ndarray) -> np.ndarray:
        """The least radius that holds k values, where `radius` is the least one with k - 1 or k values."""
        before = self.below(np.searchsorted(self.sorted, -((radius - middle2) // 2), "left"))
        upto = self.below(np.searchsorted(self.sorted, (middle2 + radius) // 2, "right"))
        left = np.where(before > 0, middle2 - 2 * self.sorted[self.pick(np.maximum(before, 1))], 1 << 62)
        right = np.where(upto < self.n, 2 * self.sorted[self.pick(np.minimum(upto + 1, np.maximum(self.n, 1)))] - middle2, 1 << 62)
        return np.where(upto - before >= k, radius, np.minimum(left, right))


def rolled(ts: np.ndarray, values: np.ndarray, times: np.ndarray, span: int, always: np.ndarray, counts: np.ndarray, unknown: np.ndarray, cuts: np.ndarray):
    """n, median2, mad4 of the windows that end at each of the rising `times`, over values at rising ts and `always`; and the needed buckets.

    unknown marks those of `always` that stand for a whole bucket of values
    between two of the cuts. An answer that could depend on where inside its
    bucket such a value lies names the bucket as needed.
    """
    n, median2, mad4 = (np.zeros(len(times), np.int64) for _ in range(3))
    needed: set[int] = set()
    low, high = np.searchsorted(ts, times - span, "right"), np.searchsorted(ts, times, "right")
    hidden = always[unknown]
    for k in range(0, len(times), AT_ONCE):
        first, last = int(low[k]), int(high[min(k + AT_ONCE, len(times)) - 1])
        if last == first and not len(always):
            continue
        table = Table(values[first:last], always, counts)
        table.open(low[k : k + AT_ONCE] - first, high[k : k + AT_ONCE] - first)
        some = table.n > 0
        size = np.maximum(table.n, 1)
        one, two = (size + 1) // 2, size // 2 + 1
        places = table.pick(one), table.pick(two)
        middle2 = table.sorted[places[0]] + table.sorted[places[1]]
        # The two middle distances: the k-th least is the least radius with k values.
        radii = [table.radius(middle2, one)]
        radii.append(table.next_radius(middle2, radii[0], two))
        far = radii[0] + radii[1]
        n[k : k + AT_ONCE], median2[k : k + AT_ONCE], mad4[k : k + AT_ONCE] = table.n, middle2, far
        if len(hidden):
            inside = np.isin(np.concatenate([table.sorted[p][some] for p in places]), hidden)
            asked = np.unique(np.concatenate([table.sorted[p][some] for p in places])[inside])
            needed.update(np.searchsorted(cuts, asked, "right").tolist())
            if not len(asked):
                ends = np.concatenate([(middle2 + s * r)[some] // 2 + d for r in radii for s in (-1, 1) for d in (-1, 0, 1)])
                needed.update(set(np.unique(np.searchsorted(cuts, ends, "right")).tolist()) & set(np.searchsorted(cuts, hidden, "right").tolist()))
    return n, median2, mad4, needed


def solver(bounds: Bounds, span: int, cuts: np.ndarray):
    """For mapInArrow over TILE_ROW sorted by pid: answers, or the buckets that a tile needs."""
    names = [x.split()[0] for x in SAID.split(", ")]

    def solve(pid: int, tile: pa.Table) -> Iterator[pa.RecordBatch]:
        tag = tile.column("tag").to_numpy()
        kinds = tile.column("kind").combine_chunks().dictionary_encode()
        code = kinds.indices.fill_null(-1).to_numpy(zero_copy_only=False)
        col = {x: tile.column(x).combine_chunks().fill_null(0).to_numpy(zero_copy_only=False) for x in ("ts", "cents", "n", "bucket")}
        blank = tile.column("cents").combine_chunks().is_null().to_numpy(zero_copy_only=False)
        ids, edge = tile.column("click_id").combine_chunks(), bounds.at_edge(pid)
        known, counted = col["bucket"][tag == FETCHED], tag == COUNT
        whole = counted & ~np.isin(col["bucket"], known)
        floors = np.concatenate([[-(1 << 59)], cuts])
        value = tag == VALUE
        always = np.concatenate([col["cents"][value], floors[col["bucket"][whole]]])
        counts = np.concatenate([col["n"][value], col["n"][whole]])
        unknown = np.arange(len(always)) >= value.sum()
        found = []
        for this in np.unique(code[tag <= CARRIED]).tolist():
            rows = np.flatnonzero((tag <= CARRIED) & (code == this))
            rows = rows[np.argsort(col["ts"][rows], kind="stable")]
            own = rows[tag[rows] == OWN]
            if not len(own):
                continue
            items = rows[~blank[rows]]
            times, which = np.unique(col["ts"][own], return_inverse=True)
            # Rows from before to after the tile are of its only kind.
            n, median2, mad4, needed = rolled(col["ts"][items], col["cents"][items], times, span, always, counts, unknown, cuts)
            kind = kinds.dictionary[this].as_py() if this >= 0 else None
            if needed:
                none = [None] * len(needed)
                yield pa.RecordBatch.from_pydict(dict(zip(names, ([NEED] * len(needed), [pid] * len(needed), none, [kind] * len(needed), none, none, none, none, none, sorted(needed)), strict=True)), schema=SCHEMA)
                return
            shared = np.isin(times, [at for k, at in edge if k == kind])
            empty = n < 1
            for state, at, of in ((np.where(shared[which], PENDING, ANSWER), which, own), (np.full(int(shared.sum()), SO_FAR), np.flatnonzero(shared), None)):
                take = pa.array(of) if of is not None else None
                no = pa.nulls(len(at), pa.int64())
                arrays = [pa.array(state.astype(np.int32)), pa.array(np.full(len(at), pid, np.int32)), ids.take(take) if take is not None else no, pa.array([kind] * len(at), pa.string()), pa.array(times[at])]
                arrays += [tile.column("cents").combine_chunks().take(take) if take is not None else no, pa.array(n[at]), pa.array(median2[at], mask=empty[at]), pa.array(mad4[at], mask=empty[at]), pa.nulls(len(at), pa.int32())]
                found.append(pa.RecordBatch.from_arrays(arrays, schema=SCHEMA))
        yield from found

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            while batch.num_rows:
                pid = batch.column(0).to_numpy()
                if held and held[0].column(0)[0].as_py() != pid[0]:
                    yield from solve(held[0].column(0)[0].as_py(), pa.Table.from_batches(held))
                    held = []
                cut = int(np.searchsorted(pid, pid[0], "right"))
                held.append(batch.slice(0, cut))
                batch = batch.slice(cut)
        if held:
            yield from solve(held[0].column(0)[0].as_py(), pa.Table.from_batches(held))

    return run


SCHEMA = pa.schema([(x.split()[0], {"int": pa.int32(), "long": pa.int64(), "string": pa.string()}[x.split()[1]]) for x in SAID.split(", ")])


def sampled(clicks: DataFrame, tiles: int) -> tuple[Bounds, np.ndarray]:
    """The tiles' bounds and the value cuts, from about SAMPLED rows a tile; rows with one id are sampled once."""
    wanted = max(LEAST_SAMPLED, SAMPLED * tiles)
    share = int(min(1.0, wanted / max(1, clicks.count())) * (1 << 30))
    some = clicks.where(F.pmod(F.xxhash64("click_id"), F.lit(1 << 30)) < share).distinct().toArrow().combine_chunks()
    kinds, at = some.column("kind").to_pylist(), micros(some.column("ts").combine_chunks()) if some.num_rows else np.zeros(0, np.int64)
    tie = ties(some.column("click_id").combine_chunks())[1] if some.num_rows else at
    value = some.column("cents").drop_null().to_numpy()
    cuts = np.unique(np.quantile(value, np.arange(1, BUCKETS) / BUCKETS, method="lower")).astype(np.int64) if len(value) else np.zeros(0, np.int64)
    return Bounds(list(zip(kinds, at.tolist(), tie.tolist(), strict=True)), tiles), cuts


def residents(clicks: DataFrame, cuts: np.ndarray) -> DataFrame:
    """series, kind, bucket, cents, here, gone, n: rows with a value that arrive two tiles or more before they leave, equal ones added up."""
    edges = F.array(*(F.lit(int(x)) for x in cuts)) if len(cuts) else F.array().cast("array<bigint>")
    through = clicks.where((F.col("gone") - F.col("here") >= 2) & F.col("cents").isNotNull())
    bucket = F.size(F.filter(edges, lambda x: x <= F.col("cents")))
    return through.groupBy(F.coalesce(F.concat(F.lit("="), "kind"), F.lit("")).alias("series"), "kind", bucket.alias("bucket"), "cents", "here", "gone").agg(F.count("*").alias("n"))


def counted(spanning: DataFrame) -> DataFrame:
    """pid, bucket, n: how many rows of each bucket are in every window of a tile: cumulative arrivals less cumulative departures."""
    moves = spanning.select("series", "bucket", F.explode(F.array(F.struct((F.col("here") + 1).alias("pid"), F.col("n")), F.struct(F.col("gone").alias("pid"), (-F.col("n")).alias("n")))).alias("m"))
    steps = moves.groupBy("series", "bucket", "m.pid").agg(F.sum("m.n").alias("n")).where("n <> 0")
    order = W.partitionBy("series", "bucket").orderBy("pid")
    steps = steps.select("series", "bucket", "pid", F.sum("n").over(order).alias("n"), F.lead("pid").over(order).alias("next"))
    return steps.where("n > 0").select(F.explode(F.sequence("pid", F.col("next") - 1)).alias("pid"), "bucket", "n")


def fetched(spanning: DataFrame, needs: DataFrame) -> DataFrame:
    """pid, cents, n: the values of the needed buckets (pid, kind, bucket), equal ones added up."""
    wanted = needs.groupBy(F.coalesce(F.concat(F.lit("="), "kind"), F.lit("")).alias("series"), "bucket").agg(F.collect_set("pid").alias("pids"))
    met = spanning.join(wanted, ["series", "bucket"])
    inside = F.filter("pids", lambda p: (p > F.col("here")) & (p < F.col("gone")))
    return met.select(F.explode(inside).alias("pid"), "cents", "n").groupBy("pid", "cents").agg(F.sum("n").alias("n"))


def rolling_median(clicks: DataFrame, span: int = SPAN) -> DataFrame:
    """click_id, kind, n, median2, mad4, far of each click, over the window of its series that ends with it.

    clicks: click_id, ts, kind, value; further columns are ignored. Rows without
    a ts go; of the rows left with one click_id (null is one too) the first by
    ts, kind and value counts. Clicks of one kind, null being a kind, are a
    series. A window holds the cents of its series' clicks with ts more than
    the own ts less span microseconds, and at most the own ts; clicks of one
    time have one window, whatever their order. Values that are null, NaN or
    beyond 2 ** 58 cents have no cents. n is the number of cents in the window;
    median2 the sum of the two middle ones (twice the only one), mad4 the same
    of |2 * cents - median2|, far whether the own deviation is more than twice
    the median one; null where n is 0, far also without own cents. An empty
    table gives none.
    """
    spark = clicks.sparkSession
    rows = clicks.where("ts is not null").select(F.col("click_id").cast("long").alias("click_id"), "ts", F.col("kind").cast("string").alias("kind"), cents("value").alias("cents"))
    tiles = c.shuffle_width(spark)
    bounds, cuts = sampled(rows, tiles)
    placed = "click_id long, kind string, ts long, cents long, here int, gone int"
    once = rows.repartition("click_id").sortWithinPartitions("click_id", "ts", "kind", "cents").mapInArrow(once_and_tiled(bounds, span), placed)
    once = c.staged(once, "clicks")
    none = lambda kind: F.lit(None).cast(kind)
    moves = F.array_compact(F.array(F.struct(F.col("here").alias("pid"), F.lit(OWN).alias("tag")), F.when((F.col("gone") > F.col("here")) & F.col("cents").isNotNull(), F.struct(F.col("gone").alias("pid"), F.lit(CARRIED).alias("tag")))))
    tiled = once.select(F.explode(moves).alias("m"), "kind", "ts", "cents", "click_id").select("m.pid", "m.tag", "kind", "ts", "cents", F.when(F.col("m.tag") == OWN, F.col("click_id")).alias("click_id"), none("long").alias("n"), none("int").alias("bucket"))

    def answered(rows: DataFrame) -> DataFrame:
        return c.staged(rows.repartitionById(tiles, F.col("pid")).sortWithinPartitions("pid").mapInArrow(solver(bounds, span, cuts), SAID), "windows")

    more = lambda df, tag: df.select("pid", F.lit(tag).alias("tag"), *((F.col(x) if x in df.columns else none(kind)).alias(x) for x, kind in (("kind", "string"), ("ts", "long"), ("cents", "long"), ("click_id", "long"), ("n", "long"), ("bucket", "int"))))
    spanning = residents(once, cuts)
    if spanning.isEmpty():
        said = answered(tiled)
    else:
        spanning = c.staged(spanning, "spanning")
        table = c.staged(counted(spanning), "table")
        # A tile with rows from before to after it is asked again with what it needs; each round fetches at least a bucket more.
        parts, needs = [answered(tiled.unionByName(more(table, COUNT)))], None
        while not parts[-1].where(F.col("state") == NEED).isEmpty():
            new = parts[-1].where(F.col("state") == NEED).select("pid", "kind", "bucket")
            ask = new.select("pid").distinct()
            needs = c.staged(new if needs is None else needs.unionByName(new), "needs")
            again = c.union([tiled, more(table, COUNT), more(needs.drop("kind"), FETCHED), more(fetched(spanning, needs), VALUE)])
            parts.append(answered(again.join(ask, "pid", "left_semi")))
        said = c.union(parts)
    out = ["click_id", "kind", "cents", "n", "median2", "mad4"]
    # At most two of a tile's times go on in other tiles, so these are two rows a tile; the last tile of a time has all of it.
    last = said.where(F.col("state") == SO_FAR).groupBy(F.col("kind").alias("_kind"), F.col("ts").alias("_ts")).agg(F.max_by(F.struct("n", "median2", "mad4"), "pid").alias("last"))
    waiting = said.where(F.col("state") == PENDING).select("click_id", "kind", "cents", "ts")
    resolved = waiting.join(F.broadcast(last), F.col("kind").eqNullSafe(F.col("_kind")) & (F.col("ts") == F.col("_ts"))).select("click_id", "kind", "cents", "last.*")
    both = said.where(F.col("state") == ANSWER).select(*out).unionByName(resolved.select(*out))
    far = 2 * F.abs(2 * F.col("cents") - F.col("median2")) > 2 * F.col("mad4")
    return both.select("click_id", "kind", "n", "median2", "mad4", F.when(F.col("n") > 0, far).alias("far"))


def op11_rolling_median(spark, sf_dir: str) -> DataFrame:
    """rolling_median() of all clicks over 15 minutes; it says what holds for nulls, ties, repeated and broken rows."""
    return rolling_median(c.table(spark, sf_dir, "clicks").select("click_id", "ts", "kind", "value"))


OP11_SQL = r"""
WITH once AS (SELECT click_id, any_value(ts) AS ts, any_value(kind) AS kind, any_value(CASE WHEN NOT isnan(value) THEN floor(100 * value + 0.5)::BIGINT END) AS c FROM clicks WHERE ts IS NOT NULL GROUP BY click_id),
w AS (SELECT click_id, kind, c, list_sort(list_filter(list(c) OVER (PARTITION BY kind ORDER BY ts RANGE BETWEEN INTERVAL 899999999 MICROSECONDS PRECEDING AND CURRENT ROW), lambda x: x IS NOT NULL)) AS v FROM once),
m AS (SELECT click_id, kind, c, v, len(v) AS n, v[(len(v) + 1) // 2] + v[len(v) // 2 + 1] AS median2 FROM w),
d AS (SELECT *, list_sort(list_transform(v, lambda x: abs(2 * x - median2))) AS r FROM m),
e AS (SELECT *, CASE WHEN n > 0 THEN r[(n + 1) // 2] + r[n // 2 + 1] END AS mad4 FROM d)
SELECT click_id, kind, coalesce(n, 0)::BIGINT AS n, CASE WHEN n > 0 THEN median2 END AS median2, mad4, CASE WHEN n > 0 THEN 2 * abs(2 * c - median2) > 2 * mad4 END AS far FROM e
"""
