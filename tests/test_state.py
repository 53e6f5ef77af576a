"""What is kept between runs: queues, tables, addresses, archives, failures."""

import random
import time

import pytest
from pyspark.sql import functions as F

from tarnkite.functions import features as ft
from tarnkite.functions import urls as u
from tarnkite.operators import frontier as fr
from tarnkite.operators import learn as ln
from tarnkite.operators import monitor as mo
from tarnkite.operators import skew as sk
from tarnkite.plans import queries as qs
from tarnkite.sources import bucketed as bk
from tarnkite.sources import tables as tb
from tarnkite.sources import web as wb
from tarnkite.streaming import frontier as st

SF = "/root/testdata/sf0.001"
TASK = "host string, seq long, delay double, at_ms long"
DAY = 86_400_000


def test_a_queue_goes_on_over_runs_newest_first(spark, tmp_path):
    source, out, state = (str(tmp_path / k) for k in ("in", "out", "state"))

    def run(*rows):
        spark.createDataFrame(rows, TASK).repartition(3).write.mode("append").parquet(source)
        found = st.drained(st.host_queues(spark.readStream.schema(TASK).parquet(source)), "pulls", out, state)
        return {(r.host, r.seq): (r.turn, round(r.pulled_ms - DAY, 3)) for r in found.where("seq >= 0").collect()}

    run(("h", 1, 5.0, DAY), ("h", 2, 2.0, DAY), ("h", 3, 1.0, DAY), ("g", 4, 1.0, DAY), (None, 9, 1.0, DAY))
    got = run(("", -1, 0.0, DAY + 1500))
    # Time went by up to 1.5 s: the newest of h at once, and the one before it 1 s later.
    assert got == {("h", 3): (1, 0), ("h", 2): (2, 1000), ("g", 4): (1, 0)}
    # A task that comes now is newer than the one that waits, and goes first, when the host is free again.
    run(("h", 5, 4.0, DAY + 1600))
    got = run(("", -2, 0.0, DAY + 60_000))
    assert got[("h", 5)] == (3, 3000)
    assert got[("h", 1)] == (4, 7000)
    # Long after its last delay the host is gone, and starts anew.
    run(("h", 6, 1.0, DAY + 100_000))
    assert run(("", -3, 0.0, DAY + 200_000))[("h", 6)] == (1, 100_000)


def test_a_queue_is_a_heap(spark, tmp_path):
    draw = random.Random(2)
    rows = [("h", k, 1.0, DAY) for k in range(120)]
    draw.shuffle(rows)
    source, out, state = (str(tmp_path / k) for k in ("in", "out", "state"))
    for part in (rows, [("", -1, 0.0, 9 * DAY)]):
        spark.createDataFrame(part, TASK).repartition(5).write.mode("append").parquet(source)
        found = st.drained(st.host_queues(spark.readStream.schema(TASK).parquet(source)), "pulls", out, state)
    assert {r.seq: r.turn for r in found.where("seq >= 0").collect()} == {k: 120 - k for k in range(120)}


def test_an_untouched_queue_goes_by_its_time_to_live(spark, tmp_path):
    source, out, state = (str(tmp_path / k) for k in ("in", "out", "state"))
    put = lambda *rows: spark.createDataFrame(rows, TASK).coalesce(1).write.mode("append").parquet(source)
    now = int(time.time() * 1000)
    put(("h", 1, 3600.0, now), ("h", 2, 3600.0, now))
    run = st.host_queues(spark.readStream.schema(TASK).parquet(source), False, 4000).writeStream.format("parquet").option("checkpointLocation", state).trigger(processingTime="300 milliseconds").start(out)

    def wait(n):
        end = time.time() + 60
        while time.time() < end:
            found = spark.read.schema("host string, seq long, turn long, pulled_ms double").parquet(out).collect() if run.lastProgress else []
            if len(found) >= n:
                return sorted((r.seq, r.turn) for r in found)
            time.sleep(0.3)
        raise AssertionError(f"nothing came: {run.exception()}")

    try:
        assert wait(1) == [(2, 1)]
        time.sleep(9)  # an hour's delay is not over, but the state is
        put(("h", 3, 1.0, int(time.time() * 1000)))
        assert wait(2) == [(2, 1), (3, 1)]
    finally:
        run.stop()


def test_taken_once_also_after_a_failure(spark, tmp_path):
    queue, out, state = (str(tmp_path / k) for k in ("queue", "out", "state"))
    schema = "page_id long, url string"
    for k in range(3):
        tb.append(spark.createDataFrame([(k, f"u{k}")], schema).coalesce(1), queue)
    assert sorted(r.page_id for r in st.taken(spark, queue, schema, out, state, files=1).collect()) == [0, 1, 2]
    # A batch whose commit is lost is taken again, into the same files.
    last = max((tmp_path / "state" / "commits").glob("[0-9]*"), key=lambda p: int(p.name))
    last.unlink()
    (last.parent / f".{last.name}.crc").unlink()
    tb.append(spark.createDataFrame([(3, "u3")], schema).coalesce(1), queue)
    assert sorted(r.page_id for r in st.taken(spark, queue, schema, out, state, delete=False).collect()) == [0, 1, 2, 3]
    assert sorted(r.page_id for r in st.taken(spark, queue, schema, out, state).collect()) == [0, 1, 2, 3]


def test_upserts_write_touched_buckets_only(spark, tmp_path):
    path = str(tmp_path / "table")
    schema = "id long, seq long, a double, b string"
    draw = random.Random(1)
    log = [(draw.randrange(200), k, draw.choice((None, draw.random())), draw.choice((None, "x", "y"))) for k in range(900)]
    table = bk.BucketedTable(spark, path, schema, "id", "seq", 8)
    for k in range(3):
        assert table.upsert(spark.createDataFrame(log[300 * k : 300 * k + 300], schema), k) == 8
    want = sorted(map(tuple, mo.upserted(spark.createDataFrame(log, schema), "id", "seq").collect()), key=repr)
    assert sorted(map(tuple, table.table().collect()), key=repr) == want
    assert table.upsert(spark.createDataFrame(log[:300], schema), 2) == 0  # done before
    again = bk.BucketedTable(spark, path, schema, "id", "seq", 8)
    assert again.upsert(spark.createDataFrame(log[:300], schema)) == 8  # old news change nothing
    assert sorted(map(tuple, again.table().collect()), key=repr) == want
    before = {p: p.stat().st_mtime_ns for p in (tmp_path / "table/rows").rglob("*.parquet")}
    assert again.upsert(spark.createDataFrame([(7, 10_000, 5.0, None)], schema), 9) == 1
    after = {p: p.stat().st_mtime_ns for p in (tmp_path / "table/rows").rglob("*.parquet")}
    assert len({p.parent for p, _ in before.items() ^ after.items()}) == 1
    assert again.table().where("id = 7").first().a == 5.0


def test_a_failed_batch_of_upserts_is_done_again(spark, tmp_path):
    source, state, schema = str(tmp_path / "in"), str(tmp_path / "state"), "id long, seq long, a double"
    table = bk.BucketedTable(spark, str(tmp_path / "table"), schema, "id", "seq", 4)
    for k in range(3):
        spark.createDataFrame([(i, 10 * k + i, float(k)) for i in range(k, 6)], schema).coalesce(1).write.mode("append").parquet(source)
    bad = [True]

    def upsert(batch, number):
        table.upsert(batch, number)
        if number == 1 and bad:
            raise RuntimeError("after the write, before the commit")

    start = lambda: spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(source).writeStream.foreachBatch(upsert).option("checkpointLocation", state).trigger(availableNow=True).start()
    assert not st.recorded(start, str(tmp_path / "failed"))
    bad.clear()
    assert st.recorded(start, str(tmp_path / "failed"))
    assert sorted((r.id, r.a) for r in table.table().collect()) == [(0, 0.0), (1, 1.0), *((i, 2.0) for i in range(2, 6))]


def test_failures_and_dumps_are_read_back(spark, tmp_path):
    path, source = str(tmp_path / "failed"), str(tmp_path / "in")
    spark.range(3).write.parquet(source)
    failures, urls = st.restarted(spark, path)
    assert failures.isEmpty()
    assert urls.isEmpty()

    def fail(batch, number):
        raise RuntimeError("the disk is full")

    start = lambda f, state: lambda: spark.readStream.schema("id long").parquet(source).writeStream.foreachBatch(f).option("checkpointLocation", str(tmp_path / state)).trigger(availableNow=True).start()
    queue = lambda *x: spark.createDataFrame([(k,) for k in x], "url string")
    assert not st.recorded(start(fail, "a"), path, queue("u", "v"), queue("v"))
    assert st.recorded(start(lambda batch, number: None, "b"), path, queue("w"))
    failures, urls = st.restarted(spark, path)
    assert [(r.failure, "the disk is full" in r.error) for r in failures.collect()] == [(1, True)]
    assert sorted(r.url for r in urls.collect()) == ["u", "v", "v"]
    assert not st.recorded(start(fail, "c"), path, queue("z"))
    failures, urls = st.restarted(spark, path)
    assert failures.count() == 2
    assert [r.url for r in urls.collect()] == ["z"]


def test_the_cap_holds_when_the_writer_runs_again(spark, tmp_path):
    source, out, state = (str(tmp_path / k) for k in ("in", "out", "state"))
    put = lambda a, b: spark.range(a, b).coalesce(1).write.mode("append").parquet(source)
    for k in range(3):
        put(10 * k, 10 * k + 10)
    stream = lambda n: spark.readStream.schema("id long").option("maxFilesPerTrigger", n).parquet(source)
    assert tuple(st.capped_writer(stream(1), out, 25, state).first()) == (25, 5, False)
    assert tuple(st.capped_writer(stream(9), out, 25, state).first()) == (25, 5, False)
    put(30, 40)
    assert tuple(st.capped_writer(stream(9), out, 25, state).first()) == (25, 15, False)
    assert spark.read.parquet(out).count() == 25


def test_a_write_counts_itself(spark, tmp_path):
    path = str(tmp_path / "out")
    rows = spark.createDataFrame([(1, "ab"), (2, None), (3, "c")], "k long, t string")
    seen = tb.counted_append(rows, path, letters=F.length("t"), keys=F.col("k"))
    assert (seen["rows"], seen["letters"], seen["keys"]) == (3, 3, 6)
    assert seen["seconds"] > 0
    assert tb.counted_append(rows.limit(0), path)["rows"] == 0
    assert tb.counted_append(rows.where("k > 9"), path)["rows"] == 0
    assert spark.read.parquet(path).count() == 3


def test_links_of_a_node_are_in_its_partition(spark):
    rows = spark.range(1000).select((F.col("id") % 5).alias("node"))
    found = u.routed(rows, 5).select("node", F.spark_partition_id().alias("part")).distinct().collect()
    assert sorted((r.node, r.part) for r in found) == [(k, k) for k in range(5)]


def test_archive_is_pruned_by_host(spark, tmp_path):
    path = f"file://{tmp_path}/archive"
    hosts = [f"h{k}.org" for k in range(30)]
    rows = [(h, f"http://{h}/{k}", 200, None, "<p>x</p>" * k) for h in hosts for k in range(3)]
    rows += [("big.org", f"http://big.org/{k}", 404 if k % 2 else 200, None, None) for k in range(100)]
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # as where files are large
    wb.write_archive(spark.createDataFrame(rows, wb.FETCHED), path)
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    web = wb.archive(spark, path)
    assert sorted(map(tuple, web.collect()), key=repr) == sorted(rows, key=repr)
    one = web.where("host = 'h3.org'")
    assert sorted(r.url for r in one.collect()) == [f"http://h3.org/{k}" for k in range(3)]
    assert one.rdd.getNumPartitions() < web.rdd.getNumPartitions() / 5
    assert web.where("host in ('h1.org', 'big.org') and status < 400").count() == 53
    assert web.where("host = 'none.org'").count() == 0
    assert web.where("host = 'big.org'").rdd.getNumPartitions() > 1


def test_redirects_are_followed_so_far(spark):
    pages = [("h", f"u{k}", 301, f"u{k + 1}", None) for k in range(8)] + [("h", "u8", 200, None, "end"), ("h", "loop", 302, "loop", None), ("h", "gone", 410, None, "no"), ("h", "lost", 307, "nowhere", None)]
    web = spark.createDataFrame(pages, wb.FETCHED)
    asked = spark.createDataFrame([("u2", 1), ("u3", 2), ("u3", 3), ("loop", 4), ("gone", 5), ("lost", 6), ("new", 7)], "url string, k int")
    got = {r.k: (r.url, r.final, r.redirects, r.status, r.ok, r.html) for r in wb.fetched(asked, web).collect()}
    assert got == {
        1: ("u2", "u7", 5, 301, False, None), 2: ("u3", "u8", 5, 200, True, "end"), 3: ("u3", "u8", 5, 200, True, "end"), 4: ("loop", "loop", 5, 302, False, None),
        5: ("gone", "gone", 0, 410, False, "no"), 6: ("lost", "nowhere", 1, None, False, None), 7: ("new", "new", 0, None, False, None),
    }


def test_addresses_are_those_of_their_time(spark):
    draw, hosts = random.Random(6), [*["hot"] * 20, "a", "b", None]
    asked = [(draw.choice(hosts), draw.randrange(60), k) for k in range(400)]
    told = [(draw.choice(hosts), draw.randrange(60), k, draw.choice((None, f"addr{k}"))) for k in range(60)]
    at = F.timestamp_seconds(F.col("minute") * 60).alias("at")
    requests = spark.createDataFrame(asked, "host string, minute long, k long").select("host", at, "k", "minute")
    lookups = spark.createDataFrame(told, "host string, minute long, seq long, addr string").select("host", at, "seq", "addr")
    found = fr.addresses_then(requests, lookups, age=600)
    want = {}
    for host, minute, k in asked:
        known = max(((m, s, a) for h, m, s, a in told if h == host and h is not None and m <= minute), default=None, key=lambda x: x[:2])
        addr = known and known[2]
        want[k] = (addr, addr is None or (minute - known[0]) * 60 > 600)
    assert {r.k: (r.addr, r.stale) for r in found.collect()} == want
    last = {}
    for host, minute, k in asked:
        if host is not None:
            last[host] = max(last.get(host, (-1, False)), (minute, want[k][1]))
    assert {r.host for r in fr.to_refresh(found).collect()} == {h for h, (_, stale) in last.items() if stale}


def rows_a_task(spark, df):
    """How many rows the tasks of a result hold, those with any."""
    return sorted(r.n for r in df.groupBy(F.spark_partition_id().alias("p")).agg(F.count("*").alias("n")).collect())


@pytest.mark.parametrize("what", ["addresses", "scores", "parents"])
def test_a_third_of_rows_on_one_key(spark, what):
    """Without adaptive execution and broadcasts, no task of a join or window has twice the median of rows."""
    old = {k: spark.conf.get(k) for k in ("spark.sql.adaptive.enabled", "spark.sql.autoBroadcastJoinThreshold", "spark.sql.shuffle.partitions")}
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.shuffle.partitions", "8")
    try:
        key = F.when(F.col("id") % 3 == 0, F.lit("hot")).otherwise(F.concat(F.lit("k"), F.col("id") % 5000))
        rows = spark.range(60_000).select("id", key.alias("host"), F.lit(1.0).alias("ptl"))
        known = rows.select("host").distinct()
        if what == "addresses":
            joined = sk.dealt_join(rows, known.withColumn("addr", F.lit("x")), ["host"], F.col("id"), "left")
        elif what == "scores":
            joined = sk.dealt_join(rows.withColumnRenamed("host", "key"), known.select(F.col("host").alias("key"), F.lit(1.0).alias("weight")), ["key"], F.col("id"), "left")
        else:
            joined = ft.with_parents(rows.withColumn("id", F.col("id") * 100), "id", "ptl")
            assert joined.where("parent is null").count() == known.count()
        got = rows_a_task(spark, joined)
        assert sum(got) == 60_000
        assert got[-1] <= 2 * got[len(got) // 2]
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)


def test_parents_over_ranges(spark, monkeypatch):
    monkeypatch.setattr(ft, "PART", 7)
    draw = random.Random(3)
    rows = [(k, draw.choice(("a", "a", "b", None)), float(k)) for k in draw.sample(range(300), 120)]
    got = {r.page_id: r.parent and r.parent.ptl for r in ft.with_parents(spark.createDataFrame(rows, "page_id long, host string, ptl double"), "page_id", "ptl").collect()}
    want, last = {}, {}
    for k, host, ptl in sorted(rows):
        want[k], last[host] = last.get(host), ptl
    assert got == want


def test_scores_of_words_in_all_rows(spark):
    rows = spark.createDataFrame([(k, {"all": 1.0, f"w{k}": 2.0}) for k in range(40)], "id long, x map<string,double>")
    weights = spark.createDataFrame([("all", 0.5), ("w3", 1.0)], "key string, weight double")
    assert {r.id: r.score for r in ln.scores(rows, weights).collect()} == {k: 2.5 if k == 3 else 0.5 for k in range(40)}


def test_all_events_are_logged(spark):
    assert qs.k5_log_lines(spark, SF).count() == tb.read(spark, SF, "events").count()


def test_what_was_seen_is_kept_over_runs_and_failures(spark, tmp_path):
    source, path = str(tmp_path / "in"), str(tmp_path / "seen")
    put = lambda *x: spark.createDataFrame([(k,) for k in x], "url string").coalesce(1).write.mode("append").parquet(source)
    run = lambda: sorted(r.url for r in st.unseen_kept(spark.readStream.schema("url string").option("maxFilesPerTrigger", 1).parquet(source), path).collect())
    put("a", "b", "a")
    put("b", "c", None)
    assert run() == ["a", "b", "c"]
    # The last batch's commit is lost: it is done again beside its own traces, and loses nothing.
    last = max((tmp_path / "seen/state/commits").glob("[0-9]*"), key=lambda p: int(p.name))
    last.unlink()
    (last.parent / f".{last.name}.crc").unlink()
    put("c", "d")
    assert run() == ["a", "b", "c", "d"]
