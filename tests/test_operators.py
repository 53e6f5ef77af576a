import csv
import hashlib
import math
import pathlib
import random
import re
import time

import duckdb
import pytest
from pyspark.sql import functions as F
from pyspark.sql.classic.dataframe import DataFrame

from tarnkite.functions import features as ft
from tarnkite.functions import text as tx
from tarnkite.functions import urls as u
from tarnkite.operators import frontier as fr
from tarnkite.operators import learn as ln
from tarnkite.operators import monitor as mo
from tarnkite.operators import seen as sn
from tarnkite.plans import queries as qs
from tarnkite.sources import tables as tb
from tarnkite.streaming import frontier as st

SF = "/root/testdata/sf0.001"


def test_replay_equals_a_plain_fold(spark):
    rows = qs.labelled(spark, SF)
    weights, want = {}, []
    for r in sorted(rows.collect(), key=lambda r: r.id):
        score = sum(v * weights.get(k, 0.0) for k, v in r.x.items())
        loss, size = max(0.0, 1 - r.tc * score), sum(v * v for v in r.x.values())
        if learns := abs(score) <= 0.5 and size > 0:
            for k, v in r.x.items():
                weights[k] = weights.get(k, 0.0) + min(1.0, loss / size) * r.tc * v
        want.append((r.id, score, loss, learns))
    got = sorted(ln.replay(rows).collect(), key=lambda r: r.id)
    assert len(got) == len(want) > 50
    for g, (k, score, loss, learns) in zip(got, want, strict=True):
        assert (g.id, g.updated) == (k, learns)
        assert g.score == pytest.approx(score, abs=1e-9)
        assert g.loss == pytest.approx(loss, abs=1e-9)


@pytest.mark.parametrize("block", [1, 7, 1000])
def test_a_replay_in_blocks_is_the_fold(spark, block, monkeypatch):
    """Blocks of any size, keys of one row and of all rows, weights merged often; and what each weight was before each row."""
    monkeypatch.setattr(ln, "DELTAS", 2)
    monkeypatch.setattr(ln, "KEYS_AT_ONCE", 3)
    monkeypatch.setattr(fr, "PART", 5)
    draw = random.Random(block)
    rows = [(3 * k, {"all": 0.5, f"own{k}": 1.0, **{f"w{draw.randrange(9)}": draw.gauss(0, 1) for _ in range(4)}}, draw.choice((1, -1, None))) for k in range(15 if block == 1 else 40)]
    weights, want, then = {}, [], {}
    for k, x, tc in rows:
        then |= {(k, key): (v, weights.get(key, 0.0)) for key, v in x.items()}
        want.append((k, *ln.learn(weights, list(x), list(x.values()), tc, 1.0, 0.5)))
    done = ln.Replay(spark.createDataFrame(rows, "id long, x map<string,double>, tc int").repartition(3), block=block)
    got = sorted((r.id, r.score, r.loss, r.updated) for r in done.scored().collect())
    assert [(g[0], g[3]) for g in got] == [(w[0], w[3]) for w in want]
    assert [g[1] for g in got] == pytest.approx([w[1] for w in want], abs=1e-9)
    assert {r.key: r.weight for r in done.weights.collect()} == pytest.approx(weights, abs=1e-9)
    told = {(r.id, r.key): (r.x, r.weight) for r in done.explained().collect()}
    assert told == {k: pytest.approx(v, abs=1e-9) for k, v in then.items()}


def test_a_replay_sends_the_driver_next_to_nothing(spark, monkeypatch):
    """Rows that all share words, in several blocks: what the driver collects does not grow with their products."""
    collect, got = DataFrame.collect, []
    monkeypatch.setattr(DataFrame, "collect", lambda df: got.extend(found := collect(df)) or found)
    rows = spark.range(2500).select("id", F.create_map(F.lit("all"), F.lit(0.6), F.concat(F.lit("w"), F.col("id") % 50), F.lit(0.8)).alias("x"), F.when(F.col("id") % 3 == 0, -1).otherwise(1).alias("tc"))
    done = ln.Replay(rows, block=2000)
    assert sum(len(v) if isinstance(v, (bytes, bytearray)) else 8 for r in got for v in r) < 10_000
    assert done.steps.count() == 2500


def test_weights_gate_and_skips_of_all_labelled_documents(spark):
    weights, skipped, gated = {}, {}, {}
    for r in sorted(qs.labelled(spark, SF).collect(), key=lambda r: r.id):
        score = sum(v * weights.get(k, 0.0) for k, v in r.x.items())
        loss, size = max(0.0, 1 - r.tc * score), sum(v * v for v in r.x.values())
        skipped[r.id] = abs(score) > 0.5 or size == 0
        if abs(score) > 0.5:
            gated[r.id] = score
        if not skipped[r.id]:
            for k, v in r.x.items():
                weights[k] = weights.get(k, 0.0) + min(1.0, loss / size) * r.tc * v
    found = lambda name: {r[0]: r[1] for r in getattr(qs, name)(spark, SF).collect()}
    assert len(skipped) > 50
    assert found("m6_skipped") == skipped
    assert found("f8_confidence_gate") == pytest.approx(gated, abs=1e-9)
    assert found("k6_weight_rows") == pytest.approx(weights, abs=1e-9)
    sure = {k: v for k, v in weights.items() if v > 1e-9}
    readable = found("m7_readable_weights")
    assert {k: v for k, v in readable.items() if v > 1e-9} == pytest.approx(sure, abs=1e-9)
    assert min(readable.values()) > 0


def test_golden_weights(spark):
    """Four rows whose trace is known."""
    want = {"0": 0.73445, "3:lease": 0.189082, "3:news": -1.420887}
    assert ln.replay_weights(qs.golden(spark)).first().weights == pytest.approx(want, abs=1e-6)
    assert {r.key: r.weight for r in ln.final_weights(qs.golden(spark)).collect()} == pytest.approx(want, abs=1e-6)
    assert [r.id for r in ln.replay(qs.golden(spark)).collect() if not r.updated] == [2]


def test_replay_of_nulls_far_ids_and_nothing(spark):
    rows = spark.createDataFrame([(5_000_000_000, {"a": 1.0}, 1), (0, {"a": 1.0, "b": None}, -1), (1, None, 1), (2, {}, 1), (3, {"a": 1.0}, None)], "id long, x map<string,double>, tc int")
    got = {r.id: (r.score, r.tc, r.loss, r.updated) for r in ln.replay(rows).collect()}
    assert got == {0: (0.0, -1, 1.0, True), 1: (0.0, 1, 1.0, False), 2: (0.0, 1, 1.0, False), 3: (-1.0, None, None, False), 5_000_000_000: (-1.0, 1, 2.0, False)}
    assert ln.replay_weights(rows).first().weights == {"a": -1.0, "b": 0.0}
    assert ln.replay(rows.limit(0)).isEmpty()
    assert ln.replay_weights(rows.limit(0)).first().weights == {}


def test_skipped_rows_change_nothing(spark):
    rows = qs.golden(spark)
    kept = ln.replay(rows).where("updated").select("id")
    assert ln.replay_weights(rows.join(kept, "id")).first().weights == pytest.approx(ln.replay_weights(rows).first().weights)


def test_wide_csv_of_a_replay(spark, tmp_path):
    """The header by slot and first sight, and each row's weights after it, shorter rows padded with 0."""
    slots = {0: [["0"], ["3:lease"]], 1: [["0"], ["3:news"]], 2: [["0"], ["3:lease"]], 3: [["0"], ["3:lease", "3:news"]]}
    side = spark.createDataFrame([(k, 'http://h.org/"a",b', v) for k, v in slots.items()], "id int, url string, slots array<array<string>>")
    rows = qs.golden(spark).join(side, "id")
    index = ln.slot_index(rows)
    names = [r.key for r in index.orderBy("col").collect()]
    assert names == ["0", "3:lease", "3:news"]
    path = str(tmp_path / "batch.csv")
    tb.write_wide_csv(ln.trajectory_lines(rows, index), ["db_id", "url", "score", "tc", "LOSS", *names], path)
    text = [r.value for r in spark.read.text(path + "/part=0").collect()] + [r.value for r in spark.read.text(path + "/part=1").collect()]
    table = list(csv.reader(text))
    assert table[0] == ["db_id", "url", "score", "tc", "LOSS", "0", "3:lease", "3:news"]
    assert [r[:2] + [r[3]] for r in table[1:]] == [[str(k), 'http://h.org/"a",b', t] for k, t in enumerate(["1", "-1", "1", "-1"])]
    weights, want = {}, []
    for r in sorted(rows.collect(), key=lambda r: r.id):
        score = sum(v * weights.get(k, 0.0) for k, v in r.x.items())
        loss = max(0.0, 1 - r.tc * score)
        if abs(score) <= 0.5:
            for k, v in r.x.items():
                weights[k] = weights.get(k, 0.0) + min(1.0, loss) * r.tc * v
        want.append([score, loss, *(weights.get(k, 0.0) for k in names)])
    got = [[float(x) for x in (r[2], *r[4:])] for r in table[1:]]
    assert got == [pytest.approx(x, abs=1e-12) for x in want]
    with pytest.raises(ValueError):
        tb.write_wide_csv(ln.trajectory_lines(rows, index), [], str(tmp_path / "batch.txt"))


def test_a_wide_csv_in_chunks(spark, tmp_path, monkeypatch):
    """Lines come from several tasks, each with the weights of all rows before its own, and the files are in order."""
    monkeypatch.setattr(ln, "CELLS", 12)
    draw = random.Random(3)
    rows = [(3 * k, f"u{k}", {"all": 0.5, **{f"w{draw.randrange(5)}": draw.gauss(0, 1) for _ in range(2)}}, draw.choice((1, -1, None))) for k in range(40)]
    names = ["all", *(f"w{k}" for k in range(5))]
    index = spark.createDataFrame([(x, k) for k, x in enumerate(names)], "key string, col int")
    lines = ln.trajectory_lines(spark.createDataFrame(rows, "id long, url string, x map<string,double>, tc int").repartition(3), index)
    path = str(tmp_path / "batch.csv")
    tb.write_wide_csv(lines, ["db_id", "url", "score", "tc", "LOSS", *names], path)
    files = sorted((tmp_path / "batch.csv" / "part=1").glob("part-*"))
    got = list(csv.reader(x for f in files for x in f.read_text().splitlines()))
    assert len([f for f in files if f.stat().st_size]) > 1
    weights = {}
    for (k, url, x, tc), cells in zip(rows, got, strict=True):
        score, loss, _ = ln.learn(weights, list(x), list(x.values()), tc, 1.0, 0.5)
        assert cells[:2] == [str(k), url] and cells[3] == ("" if tc is None else str(tc))
        assert float(cells[2]) == pytest.approx(score, abs=1e-9)
        assert [float(c) for c in cells[5:]] == pytest.approx([weights.get(n, 0.0) for n in names], abs=1e-9)


def test_a_wide_csv_is_small_on_disk(spark, monkeypatch):
    """All cells of all rows are written, in far fewer bytes than their text; and first weights go by partitions, not by rows."""
    paths, made = [], tb.new_path
    monkeypatch.setattr(tb, "new_path", lambda spark, tag: paths.append(made(spark, tag)) or paths[-1])
    monkeypatch.setattr(ln, "CELLS", 1)
    draw = random.Random(5)
    word = lambda: f"3:w{draw.randrange(400)}"
    rows = [(k, f"http://h.org/{k}", draw.choice((1, -1)), {"0": 0.5, **{word(): 0.2 for _ in range(6)}}) for k in range(300)]
    rows = [(*r, [["0"], [x for x in r[3] if x != "0"]]) for r in rows]
    judged = spark.createDataFrame(rows, "id long, url string, tc int, x map<string,double>, slots array<array<string>>")
    monkeypatch.setattr(qs, "judged_pages", lambda spark, sf_dir: judged)
    got = {r.db_id: r for r in qs.k6_batch_csv(spark, SF).collect()}
    path = next(p for p in paths if "/batch-" in p) + "/batch.csv"
    text = [r.value for r in spark.read.text(path).where("part = 1").collect()]
    keys = {k for r in rows for k in r[3]}
    assert [len(x) for x in csv.reader(text)] == [5 + len(keys)] * len(rows)
    assert {r.n_weights for r in got.values()} == {len(keys)}
    weights = {}
    for k, _, tc, x, _ in rows:
        score, loss, _ = ln.learn(weights, list(x), list(x.values()), tc, 1.0, 0.5)
        assert (got[k].tc, got[k].score, got[k].loss, got[k].weight_sum) == (tc, *(pytest.approx(v, abs=1e-8) for v in (score, loss, sum(weights.values()))))
    on_disk = sum(f.stat().st_size for f in pathlib.Path(path.removeprefix("file:")).rglob("part-*"))
    assert on_disk < sum(map(len, text)) / 4
    first = spark.read.parquet(next(p for p in paths if "/chunks-" in p)).where("t = 0")
    assert first.select("chunk").distinct().count() <= ln.CHUNKS * 4


def test_a_packed_csv_looks_back_over_a_line(spark, tmp_path):
    """Lines of 3 MB, alike but for their numbers, take little more than one of them."""
    tail = "," + ",".join(repr(random.Random(k).random()) for k in range(150_000))
    lines = spark.range(12).coalesce(1).select("id", F.concat(F.col("id").cast("string"), F.lit(tail)).alias("line", metadata={"bytes": len(tail)}))
    tb.write_wide_csv(lines, ["id"], str(tmp_path / "far.csv"), packed=True)
    assert sum(f.stat().st_size for f in (tmp_path / "far.csv").rglob("part-*")) < len(tail)
    assert [r.value for r in spark.read.text(str(tmp_path / "far.csv")).where("part = 1").collect()] == [f"{k}{tail}" for k in range(12)]


def test_sums_of_a_wide_csv(spark):
    """Quotes and commas in a cell, an empty one, no numbers, and numbers after those of another line."""
    lines = ['1,"a"",b",0.5,1,1.0,0.25,-0.5', '2,"a",,-1,"",0.25,-0.5', "3,x,0.5,1,1.0", "4,é,0.5,1,1.0,1e-3"]
    got = tb.wide_sums(spark.createDataFrame([(x,) for x in lines], "value string").coalesce(1), 5).collect()
    assert [(r.named, r.n, r.total) for r in got] == [(["1", 'a",b', "0.5", "1", "1.0"], 2, -0.25), (["2", "a", None, "-1", None], 2, -0.25), (["3", "x", "0.5", "1", "1.0"], 0, 0.0), (["4", "é", "0.5", "1", "1.0"], 1, 0.001)]


def test_judged_pages_step_by_step(spark):
    """The analysis of all judged pages, and the wide CSV of the same, against one plain fold."""
    rows = sorted(qs.judged_pages(spark, SF).collect(), key=lambda r: r.id)
    weights, seen, want = {}, set(), {}
    for r in rows:
        seen |= {k for slot in r.slots for k in slot}
        score = sum(v * weights.get(k, 0.0) for k, v in r.x.items())
        loss, size = max(0.0, 1 - r.tc * score), sum(v * v for v in r.x.values())
        if abs(score) <= 0.5 and size > 0:
            for k, v in r.x.items():
                weights[k] = weights.get(k, 0.0) + min(1.0, loss / size) * r.tc * v
        want[r.id] = (score, r.tc, loss, sum(weights.values()))
    assert len(want) > 10
    told = {r.id: r for r in qs.m8_analysis(spark, SF).collect()}
    assert set(told) == set(want)
    for k, (score, tc, loss, _) in want.items():
        assert float(told[k].shown) == pytest.approx(100 * score, abs=0.006)
        assert (told[k].tc, told[k].route) == (tc, "positive" if tc == 1 else "negative")
        assert told[k].loss == pytest.approx(loss, abs=1e-8)
    wide = {r.db_id: r for r in qs.k6_batch_csv(spark, SF).collect()}
    assert {r.n_weights for r in wide.values()} == {len(seen)}
    assert {k: (r.score, r.tc, r.loss, r.weight_sum) for k, r in wide.items()} == {k: pytest.approx(v, abs=1e-8) for k, v in want.items()}
    side = {(r.id, r.key): (r.x, r.weight) for r in qs.m7_explained(spark, SF).collect()}
    assert side == {(r.id, k): pytest.approx((v, weights.get(k, 0.0)), abs=1e-9) for r in rows for k, v in r.x.items()}


def test_feature_index_keeps_the_order_of_first_sight(spark):
    rows = spark.createDataFrame([(5, 0, "b"), (5, 1, "a"), (2000, 0, "a"), (2000, 1, "c"), (1, 3, "z")], "id long, pos int, token string")
    assert {r.token: r.idx for r in ln.feature_index(rows).collect()} == {"z": 0, "b": 1, "a": 2, "c": 3}


def test_admission_order(spark):
    rows = [("http://a.org/x/", 1, "http://a.org/", 0), ("http://a.org/x", 2, "http://b.org/", 0), ("http://c.org/y", 3, "http://a.org/", 0), ("http://c.org/y", 4, "http://c.org/", 0), ("http://a.org/p.jpg", 5, "http://a.org/", 0), ("http://www.onecle.com/", 6, "http://a.org/", 0), ("http://a.org/seen", 7, "http://a.org/", 0)]
    df = spark.createDataFrame(rows, "url string, seq long, parent_url string, distance int")
    seen = spark.createDataFrame([("http://a.org/seen",)], "url string")
    got = {r.url: (r.seq, r.distance, r.admitted) for r in fr.admitted(df, seen).collect()}
    # c.org/y was first found from afar, and so it stays out although it is found nearer later.
    assert got == {"http://a.org/x": (1, 0, True), "http://c.org/y": (3, 1, False), "http://a.org/p.jpg": (5, 0, False)}
    again = fr.admitted(df, seen.unionByName(fr.admitted(df, seen).select("url")))
    assert again.isEmpty()


def test_expand_ends_on_cycles(spark):
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("c", "d")], "src string, dst string")
    seeds = spark.createDataFrame([("a",)], "node string")
    assert {r.node: r.hop for r in fr.expand(edges, seeds, 50).collect()} == {"a": 0, "b": 1, "c": 2, "d": 3}
    assert {r.node for r in fr.expand(edges, seeds, 1).collect()} == {"a", "b"}
    assert fr.expand(edges, seeds.limit(0), 3).isEmpty()


def test_expansion_of_the_whole_graph(spark):
    read = lambda t, *c: [tuple(r) for r in tb.read(spark, SF, t).select(*c).collect()]
    orders, nations = read("orders", "o_orderkey", "o_custkey"), read("nation", "n_nationkey", "n_regionkey")
    edges = [(f"o{a}", f"c{b}") for a, b in orders] + [(f"c{a}", f"n{b}") for a, b in read("customer", "c_custkey", "c_nationkey")]
    edges += [(f"n{a}", f"r{b}") for a, b in nations] + [(f"r{b}", f"n{a}") for a, b in nations]
    want, front = {f"o{a}": 0 for a, _ in orders}, {f"o{a}" for a, _ in orders}
    for hop in range(1, 7):
        front = {b for a, b in edges if a in front} - set(want)
        want |= dict.fromkeys(front, hop)
    got = qs.r1_expand(spark, SF).collect()
    assert len(got) == len(want) > len(orders)
    assert {r.node: r.hop for r in got} == want


def walk(pages, links, seeds, most):
    """A plain crawl: pages {key: page_id}, links {page_id: [(url, ...)]} in order; rows as crawl() returns them."""
    host = lambda url: re.match(r"(?:[^:/?#]+:)?(?://([^/?#]*))?", url)[1] or ""
    path = lambda url: re.match(r"(?:[^:/?#]+:)?(?://[^/?#]*)?([^?#]*)", url)[1]
    safe = lambda url: re.search(u.SAFE_PATH, path(url)) and not re.search(u.BLOCKED, url)
    key = lambda url: re.sub("/$", "", re.sub("#.*", "", url))
    front = [(x, None, 0) for x in (re.sub("/$", "", s) for s in seeds) if safe(x)]
    seen, out, hop = {re.sub("/$", "", s) for s in seeds}, [], 0
    while front:
        found = []
        for url, parent, distance in front:
            here = pages.get(key(url), [None])
            out += [(url, hop, distance, parent, page_id) for page_id in here]
            for page_id in here:
                for link in links.get(page_id, []):
                    one = re.sub("/$", "", link)
                    if re.search(u.BLOCKED, one) or one in seen:
                        continue
                    seen.add(one)
                    far = distance + (host(one) != host(url))
                    if safe(one) and (most < 0 or far <= most):
                        found.append((one, url, far))
        front, hop = found, hop + 1
    return out


@pytest.mark.parametrize("most", [0, 1, -1])
def test_crawl_is_a_walk(spark, most):
    a = lambda *to: "".join(f'<a href="{x}">go there</a> ' for x in to)
    rows = [
        (1, "http://a.org/", a("/x", "/y/", "http://b.org/", "/x", "/p.jpg", "http://www.onecle.com/z")), (2, "http://a.org/x", a("/z", "http://c.org/w", "#top")),
        (3, "http://a.org/y", a("http://b.org/q", "/z#part", "/doc.pdf")), (4, "http://b.org/", a("http://a.org/x", "/q")), (5, "http://b.org/q", a("http://c.org/w")),
        (6, "http://c.org/w", a("/v", "http://a.org/")), (7, "http://c.org/v", None), (8, "http://a.org/doc.pdf", a("/never")), (9, "http://a.org/z", a("/end")), (10, "http://far.org/", a("/x")),
    ]
    web = spark.createDataFrame(rows, "page_id long, url string, html string")
    seeds = ["http://a.org/", "http://www.onecle.com/", "http://b.org/none"]
    links = {}
    for r in u.page_links(web.where("page_id <> 8")).orderBy("page_id", "pos").collect():
        links.setdefault(r.page_id, []).append(r.url)
    want = walk({re.sub("/$", "", x[1]): [x[0]] for x in rows}, links, seeds, most)
    got = fr.crawl(web, spark.createDataFrame([(x,) for x in seeds], "url string"), most).collect()
    assert sorted(((r.url, r.hop, r.distance, r.parent_url, r.page_id) for r in got), key=repr) == sorted(want, key=repr)
    assert len(want) > 4
    assert fr.crawl(web, spark.createDataFrame([], "url string"), most).isEmpty()


def test_crawl_of_the_sample(spark):
    web = qs.linked_pages(spark, SF)
    rows, links, pages = sorted(web.collect(), key=lambda r: r.page_id), {}, {}
    for r in rows:
        pages.setdefault(re.sub("/$", "", re.sub("#.*", "", r.url)), [r.page_id])  # a URL finds one page, the least
    for r in u.page_links(web).orderBy("page_id", "pos").collect():
        links.setdefault(r.page_id, []).append(r.url)
    want = walk(pages, links, [rows[0].url], -1)
    got = fr.crawl(web, spark.createDataFrame([(rows[0].url,)], "url string"), -1).collect()
    assert sorted(((r.url, r.hop, r.distance, r.page_id) for r in got), key=repr) == sorted(((w[0], w[1], w[2], w[4]) for w in want), key=repr)
    assert len({w[4] for w in want} - {None}) == len(pages) > 40
    assert len({r.url for r in got}) == len(got)
    assert max(w[1] for w in want) >= 5


def test_crawl_reads_one_page_for_each_url(spark):
    """Pages of one key: the least one is fetched; a URL that is a seed twice is queued once."""
    rows = [(5, "http://a.org/x", '<a href="/five">it goes</a>'), (3, "http://a.org/x/", '<a href="/three">it goes</a>'), (4, "http://a.org/x#part", None)]
    web = spark.createDataFrame(rows, "page_id long, url string, html string")
    seeds = spark.createDataFrame([("http://a.org/x",), ("http://a.org/x/",)], "url string")
    got = sorted((r.url, r.hop, r.page_id) for r in fr.crawl(web, seeds).collect())
    assert got == [("http://a.org/three", 1, None), ("http://a.org/x", 0, 3)]


def test_a_hop_shuffles_its_own_links(spark, monkeypatch):
    """Of a web of which a crawl finds little, its hops shuffle little: neither all keys nor all links, hop for hop."""
    n, hops = 20_000, 6
    web = spark.range(n).select(F.col("id").alias("page_id"), F.concat(F.lit("http://a.org/p"), "id").alias("url"), F.concat(F.lit('<a href="/p'), F.col("id") + F.when(F.col("id") < hops, 1).otherwise(0), F.lit('">it goes</a>')).alias("html"))
    table = fr.edge_table(web)
    monkeypatch.setattr(fr, "edge_table", lambda pages: table)

    def shuffled():
        tracker = spark.sparkContext._jsc.sc().statusStore()
        stages = tracker.stageList(None, False, False, spark.sparkContext._gateway.new_array(spark._jvm.double, 0), None)
        return sum(stages.apply(k).shuffleWriteRecords() for k in range(stages.size()))

    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "50k")
    try:
        before = shuffled()
        got = fr.crawl(web, spark.createDataFrame([("http://a.org/p0",)], "url string")).collect()
        records = shuffled() - before
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
    assert sorted((r.hop, r.page_id) for r in got) == [(k, k) for k in range(hops + 1)]
    assert records < 2 * n


def test_a_crawl_goes_on_with_the_filter_of_another(spark, tmp_path):
    """What a first run saw is in its filter; a lookup in the exact table decides, so nothing new is lost."""
    web = qs.linked_pages(spark, SF)
    seeds = spark.createDataFrame([(web.orderBy("page_id").first().url,)], "url string")
    path = str(tmp_path / "seen")
    sieve = sn.SeenFilter(spark, path, 10_000)
    first = {(r.url, r.hop) for r in fr.crawl(web, seeds, -1, sieve=sieve).collect()}
    again = sn.SeenFilter(spark, path)
    assert again.blocks == sieve.blocks
    assert again.maybe(spark.createDataFrame([(x,) for x, _ in first], "url string")).where("not maybe").isEmpty()
    assert {(r.url, r.hop) for r in fr.crawl(web, seeds, -1, sieve=again).collect()} == first


def test_rate_of_false_positives(spark, tmp_path):
    sieve = sn.SeenFilter(spark, str(tmp_path / "seen"), 20_000, 0.001)
    urls = lambda a, b: spark.range(a, b).select(F.concat(F.lit("http://h.org/"), "id").alias("url"))
    sieve.add(urls(0, 10_000))
    sieve.add(urls(10_000, 20_000))
    sieve.add(urls(10_000, 20_000), batch=1)  # again, as after a failure
    assert sieve.batches() == [0, 1]
    assert sieve.maybe(urls(0, 20_000)).where("not maybe").isEmpty()
    false = sieve.maybe(urls(20_000, 220_000)).where("maybe").count() / 200_000
    assert 0 < false < 0.002
    sieve.compact()
    assert sieve.batches() == [2]
    assert sieve.maybe(urls(0, 20_000)).where("not maybe").isEmpty()
    none = spark.createDataFrame([(None,)], "url string")
    sieve.add(none)
    assert sieve.maybe(none).first().maybe is False


def initialised(seeds, slots):
    """A plain loop: {host: [task, then its queue as pulled]}, overflow in order, empty queues."""
    left, queues, rest, empty = sorted(seeds, key=lambda s: s[1]), {}, [], 0

    def add(host, seq):
        if host in queues:
            queues[host].append(seq)
        elif len(queues) + empty < slots:
            queues[host] = [seq]
        else:
            rest.append((host, seq))

    while len(queues) + empty < slots:
        if left:
            add(*left.pop())
        else:
            empty += 1
    for s in left:
        add(*s)
    out = [(h, s, k, 1 if n == 0 else 1 + len(q) - n) for k, (h, q) in enumerate(queues.items(), 1) for n, s in enumerate(q)]
    out += [(h, s, None, k) for k, (h, s) in enumerate(rest, 1)]
    return out + [(None, None, len(queues) + k, None) for k in range(1, empty + 1)]


@pytest.mark.parametrize(("hosts", "slots", "part"), [(9, 6, 1 << 16), (3, 6, 1 << 16), (40, 6, 4), (1, 2, 3)])
def test_the_frontier_begins_as_the_loop_does(spark, monkeypatch, hosts, slots, part):
    monkeypatch.setattr(fr, "PART", part)
    draw = random.Random(hosts)
    seeds = [(f"h{int(hosts * draw.random() ** 2)}", k * 3) for k in range(60)]
    got = fr.initialised(spark.createDataFrame([(*s, "more") for s in seeds], "host string, seq long, slot string").drop("slot"), slots).collect()
    assert sorted(map(tuple, got), key=repr) == sorted(initialised(seeds, slots), key=repr)
    none = fr.initialised(spark.createDataFrame([], "host string, seq long"), slots).collect()
    assert sorted(r.slot for r in none) == list(range(1, slots + 1))


def simulated(rows, slots):
    """When each host's queue opens, and each task starts."""
    first, free, out = {}, [0.0] * slots, {}
    for host, seq, _ in sorted(rows, key=lambda r: r[1]):
        first.setdefault(host, seq)
    for host in sorted(first, key=lambda h: (first[h], h)):
        k = min(range(slots), key=lambda i: (free[i], i))
        at = opens = free[k]
        for _, seq, delay in sorted((r for r in rows if r[0] == host), key=lambda r: r[1]):
            out[seq] = (opens, at)
            at += delay
        free[k] = at
    return out


def test_hosts_take_turns(spark):
    rows = [(f"h{k * k % 13}", k, float(1 + k * 7 % 11)) for k in range(80)]
    for slots in (1, 3, 20):
        got = fr.host_turns(spark.createDataFrame(rows, "host string, seq long, delay double"), slots).collect()
        assert {r.seq: (r.opens, r.start) for r in got} == {k: pytest.approx(v) for k, v in simulated(rows, slots).items()}
        assert {r.slot for r in got} <= set(range(1, slots + 1))
    tasks = [(r.host, r.seq, r.delay) for r in qs.tasks(spark, SF).collect()]
    got = {r.page_id: (r.opens, r.start) for r in qs.r3_host_turns(spark, SF).collect()}
    assert got == {k: pytest.approx(v, abs=1e-5) for k, v in simulated(tasks, 6).items()}


def test_sums_in_parts(spark, monkeypatch):
    monkeypatch.setattr(fr, "PART", 4)
    rows = [(["a", "b"][k % 3 == 0], k, float(k % 5)) for k in range(50)]
    df = spark.createDataFrame(rows, "host string, seq long, delay double")
    want = {k: sum(d for h2, k2, d in rows if h2 == h and k2 < k) for h, k, _ in rows}
    assert {r.seq: r.start for r in fr.pull_times(df).collect()} == want
    turns = {k: 1 + sum(1 for h2, k2, _ in rows if h2 == h and k2 > k) for h, k, _ in rows}
    assert {r.seq: r.turn for r in fr.newest_first(df).collect()} == turns
    assert sorted(r.seq for r in tb.capped(df, "host", "seq", 3).collect()) == [0, 1, 2, 3, 4, 6]


def test_whole_scan_and_queue(spark):
    pages = sorted(r.page_id for r in tb.read(spark, SF, "pages").collect())
    assert sorted(r.page_id for r in qs.s1_scan(spark, SF).collect()) == pages
    # More rows than a report would show, so that a cap shows.
    many = spark.range(5000, numPartitions=7).select(F.col("id").alias("seq"), F.concat(F.lit("h"), F.col("id") % 11).alias("host"), ((F.col("id") * 37) % 101).cast("double").alias("start"))
    got = fr.queue_order(many, "start", "host", "seq").collect()
    want = sorted(got, key=lambda r: (r.start, r.host, r.seq))
    assert [r["rank"] for r in want] == list(range(1, 5001))
    assert fr.queue_order(many.limit(0), "start").isEmpty()
    assert tb.scan(many, "seq").count() == 5000
    assert [r.seq for r in tb.scan(many, "seq", 2).collect()] == [0, 1]


def test_delays(spark):
    got = spark.range(1).select(fr.delay(F.lit(True), F.lit(2.0), F.lit(0.5)), fr.delay(F.lit(False), F.lit(2.0), F.lit(0.5))).first()
    assert tuple(got) == (50.0, 60.0)


def test_host_slots_overflow(spark):
    tasks = spark.createDataFrame([(f"h{k}", k) for k in range(8)] + [("h0", 100)], "host string, seq long")
    got = {(r.host, r.seq): r.slot for r in fr.host_slots(tasks).collect()}
    assert [got[f"h{k}", k] for k in range(8)] == [1, 2, 3, 4, 5, 6, None, None]
    assert got["h0", 100] == 1


def test_upsert_keeps_what_is_not_given(spark):
    log = spark.createDataFrame([(1, 1, 5, None), (1, 2, None, 7), (1, 3, 6, None), (2, 1, None, None)], "id int, seq int, a int, b int")
    assert {r.id: (r.a, r.b) for r in mo.upserted(log, "id", "seq").collect()} == {1: (6, 7), 2: (None, None)}


def test_totals_of_nothing(spark):
    empty = spark.createDataFrame([], "init int, active_count int, rcount int, scount int, failure int, stop_order int")
    assert tuple(mo.totals(empty).first()) == (0,) * 6


def test_unbroken(spark):
    df = spark.createDataFrame([(3,), (4,), (4,), (5,), (7,), (None,)], "id long")
    assert sorted(r.id for r in tb.unbroken(df, "id").collect()) == [3, 4, 4, 5]
    assert tb.unbroken(df.limit(0), "id").isEmpty()


def test_csv_paths(spark, tmp_path):
    with pytest.raises(ValueError):
        tb.write_csv(spark.range(1), str(tmp_path / "out.txt"))


def test_streams_equal_batches(spark):
    batch = {(r.seq, r.start) for r in fr.pull_times(qs.tasks(spark, SF)).withColumn("start", F.round("start", 6)).collect()}
    stream = {(r.seq, r.start) for r in qs.r2_stream_pull_times(spark, SF).collect()}
    assert stream == batch


def test_hosts_are_remembered_between_batches(spark, tmp_path):
    source = str(tmp_path / "in")
    rows = [[("h", 1, 5.0), ("g", 2, 1.0)], [("h", 3, 2.0)], [("h", 4, 1.0)]]
    got = []
    out, state = str(tmp_path / "out"), str(tmp_path / "state")
    for part in rows:
        spark.createDataFrame(part, "host string, seq long, delay double").coalesce(1).write.mode("append").parquet(source)
        stream = st.pull_times(spark.readStream.schema("host string, seq long, delay double").parquet(source))
        stream.writeStream.format("parquet").option("checkpointLocation", state).trigger(availableNow=True).start(out).awaitTermination()
    got = {(r.seq, r.start) for r in spark.read.parquet(out).collect()}
    assert got == {(1, 0.0), (2, 0.0), (3, 5.0), (4, 7.0)}


def test_an_idle_host_starts_anew(spark, tmp_path):
    """With a timeout the state of a host goes, while one that is asked again in time keeps its own."""
    source, out, state = (str(tmp_path / k) for k in ("in", "out", "state"))
    schema = "host string, seq long, delay double"
    put = lambda *rows: spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(source)
    put(("h", 1, 5.0))
    stream = st.pull_times(spark.readStream.schema(schema).parquet(source), idle_ms=4000)
    run = stream.writeStream.format("parquet").option("checkpointLocation", state).trigger(processingTime="200 milliseconds").start(out)

    def wait(n):
        end = time.time() + 60
        while time.time() < end:
            try:
                found = spark.read.schema(stream.schema).parquet(out).collect()
            except Exception:  # noqa: BLE001 - nothing is there yet
                found = []
            if len(found) >= n:
                return {(r.seq, r.start) for r in found}
            time.sleep(0.2)
        raise AssertionError("nothing came")

    try:
        assert wait(1) == {(1, 0.0)}
        put(("h", 2, 1.0))
        assert wait(2) == {(1, 0.0), (2, 5.0)}
        time.sleep(10)  # the host is idle, and a batch without rows drops it
        put(("h", 3, 1.0))
        assert wait(3) == {(1, 0.0), (2, 5.0), (3, 0.0)}
    finally:
        run.stop()


def test_a_stream_that_failed_goes_on_where_it_was(spark, tmp_path):
    """A batch fails; the same call again does it, and what was finished before is neither lost nor done twice."""
    source, out, state, bad = (str(tmp_path / k) for k in ("in", "out", "state", "bad"))
    for k in range(4):
        spark.createDataFrame([(f"http://h.org/{k}",), (f"http://h.org/{k // 2}",)], "url string").coalesce(1).write.mode("append").parquet(source)

    def broken(batches):
        import os

        for pdf in batches:
            if os.path.exists(bad) and pdf["url"].str.endswith("/2").any():
                raise RuntimeError("the fetch died")
            yield pdf

    def once():
        rows = spark.readStream.schema("url string").option("maxFilesPerTrigger", 1).parquet(source)
        return st.drained(st.unseen(rows.mapInPandas(broken, "url string")), "restart", out, state)

    open(bad, "w").close()
    with pytest.raises(Exception, match="the fetch died"):
        once()
    before = spark.read.parquet(out).count()
    assert before < 4
    (tmp_path / "bad").unlink()
    assert sorted(r.url for r in once().collect()) == [f"http://h.org/{k}" for k in range(4)]


def beat(k, seq, **given):
    return (k, seq, *(given.get(x) for x in mo.COUNTERS))


def test_the_run_ends_at_the_first_verdict(spark, tmp_path):
    source = str(tmp_path / "beats")
    schema = "id long, seq long, " + ", ".join(f"{x} long" for x in mo.COUNTERS)
    start = dict(init=1, active_count=2, rcount=3, scount=3, failure=0, stop_order=0)
    batches = [[beat(k, 1, **start) for k in range(2)], [beat(0, 2, active_count=0)], [beat(1, 3, active_count=0, rcount=4)], [beat(0, 4, scount=4)], [beat(1, 5, failure=1)]]
    for rows in batches:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(source)
        time.sleep(0.05)
    read = lambda: spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(source)
    got = st.watched(read(), 2, 0).first()
    # Done at the fourth batch: the failure that the fifth reports is never seen.
    assert (got.active_count, got.rcount, got.scount, got.failure, got.verdict) == (0, 7, 7, 0, 0)
    assert st.watched(read(), 3, 0).first().verdict == 2
    assert st.watched(read(), 3, 1).first().verdict == 1
    none = str(tmp_path / "none")
    spark.createDataFrame([], schema).coalesce(1).write.parquet(none)
    assert st.watched(spark.readStream.schema(schema).parquet(none), 3, 1).first().verdict is None


def test_a_watch_that_failed_is_taken_up(spark, tmp_path):
    """A beat that cannot be read kills the watch; the next call goes on from the workers' table, and a verdict stays."""
    source, state = str(tmp_path / "beats"), str(tmp_path / "state")
    schema = "id long, seq long, " + ", ".join(f"{x} long" for x in mo.COUNTERS)
    beats = lambda rows: spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(source)
    fault = {"on": True}

    def watch():
        rows = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(source)
        broken = F.when((F.col("seq") == 4) & F.lit(fault["on"]), F.raise_error(F.lit("no beat"))).cast("long")
        return st.watched(rows.withColumn("rcount", F.coalesce(broken, F.col("rcount"))), 2, 0, state=state).first()

    start = dict(init=1, active_count=2, rcount=3, scount=3, failure=0, stop_order=0)
    beats([beat(k, 1, **start) for k in range(2)])
    got = watch()
    assert (got.init, got.active_count, got.rcount, got.verdict) == (2, 4, 6, None)
    beats([beat(0, 4, active_count=0, scount=4)])
    with pytest.raises(Exception, match="no beat"):
        watch()
    fault["on"] = False
    got = watch()
    assert (got.init, got.active_count, got.rcount, got.scount, got.verdict) == (2, 2, 6, 7, None)
    # A late beat: worker 0 told its rcount last with seq 1, its scount with seq 4.
    beats([beat(0, 3, rcount=4, scount=9)])
    got = watch()
    assert (got.rcount, got.scount, got.verdict) == (7, 7, None)
    beats([beat(1, 2, active_count=0)])
    assert watch().verdict == 0
    beats([beat(1, 9, active_count=5, failure=1)])
    got = watch()
    assert (got.active_count, got.failure, got.verdict) == (0, 0, 0)


def test_heartbeats_of_a_stream_and_of_a_table(spark, tmp_path):
    rows = spark.createDataFrame([(1, 5, "view"), (1, 9, "error"), (2, 1, "click")], "id long, event_id long, event_type string")
    path = str(tmp_path / "in")
    rows.coalesce(1).write.parquet(path)
    kept = {}
    run = st.heartbeats(spark.readStream.schema(rows.schema).parquet(path)).writeStream.outputMode("complete").foreachBatch(lambda df, _: kept.update({r.id: tuple(r) for r in df.collect()})).trigger(availableNow=True).start()
    run.awaitTermination()
    assert kept == {r.id: tuple(r) for r in mo.latest(rows).collect()} == {1: (1, 9, "error", 2), 2: (2, 1, "click", 1)}


def test_the_writer_stops_at_its_cap(spark, tmp_path):
    source = str(tmp_path / "in")
    for k in range(3):
        spark.range(k * 10, k * 10 + 10).coalesce(1).write.mode("append").parquet(source)
    for most, want in ((15, (15, 15, False)), (30, (30, 0, False)), (99, (30, 0, True))):
        stream = spark.readStream.schema("id long").option("maxFilesPerTrigger", 1).parquet(source)
        assert tuple(st.capped_writer(stream, str(tmp_path / f"out{most}"), most).first()) == want


def test_word_counts_in_a_row_are_those_of_a_table(spark):
    texts = ["", None, "lease lease apple this the aaaa", "zulu yankee zulu xray yankee zulu", "word " * 5000 + "other"]
    df = spark.createDataFrame(list(enumerate(texts)), "k long, t string")
    want = {}
    for r in tx.word_counts(df, "k", "t").collect():
        want.setdefault(r.k, []).append((-r.n, r.token))
    got = df.select("k", tx.counted(F.filter(tx.word_tokens("t"), tx.topical)).alias("c")).collect()
    assert {r.k: [(x.n, x.w) for x in r.c] for r in got} == {k: sorted(want.get(k, [])) for k in range(len(texts))}
    assert {r.k: r.words for r in tx.frequent_words(df, "k", "t", 2).collect()} == {k: [w for _, w in sorted(want.get(k, []))][:2] for k in range(len(texts))}


def test_a_shown_score_is_rounded_as_c_does(spark):
    """The number itself is rounded, half to even: 100 * 0.00125 is a tie, 100 * 0.01005 is less than 1.005 looks."""
    rows = spark.createDataFrame([(k, x) for k, x in enumerate([0.00125, 0.00375, 0.01005, -0.00125, -0.00001, 0.0, None])], "id int, score double")
    got = [r.shown for r in rows.select("id", ft.shown("score").alias("shown")).orderBy("id").collect()]
    assert got == ["0.12", "0.38", *(f"{100 * x:.2f}" for x in (0.01005, -0.00125, -0.00001, 0.0)), None]
    assert got[3] == "-0.12"


def test_a_shown_score_keeps_its_sign_at_0(spark, tmp_path):
    """What is left of words that cancel out, and scores that round to 0 from below, are shown as the SQL shows them."""
    rows = spark.createDataFrame([(k, x) for k, x in enumerate([-3e-17, 3e-17, -4e-10, -6e-10, 0.0, -0.0, float("inf")])], "id int, score double")
    got = [r.shown for r in rows.select("id", ft.shown("score").alias("shown")).orderBy("id").collect()]
    assert got == [duckdb.sql(f"SELECT printf('%.2f', 100 * round({x!r}::DOUBLE, 9))").fetchall()[0][0] for x in (-3e-17, 3e-17, -4e-10, -6e-10, 0.0, -0.0)] + ["inf"]
    assert got[0] == got[2] == "-0.00" and got[1] == "0.00"
    weight = lambda w: int(hashlib.md5(w.encode()).hexdigest()[:8], 16) % 1000
    words = {}
    for k in range(4000):
        words.setdefault(weight(w := "word" + "".join(chr(97 + k // 26**i % 26) for i in range(3))), w)
    # Two words have one sum in any order: for the SQL, these are never by chance.
    pairs = [f"{words[d]} {words[1000 - d]}" for d in sorted(words) if 1000 - d in words and d < 500][:60]
    spark.createDataFrame(list(enumerate(pairs)), "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    want = dict(con.sql(qs.ORACLE_SQL["t19_shown_score"]).fetchall())
    assert set(want.values()) == {"0.00", "-0.00"}
    assert {r.id: r.shown for r in qs.t19_shown_score(spark, str(tmp_path)).collect()} == want


def test_an_exact_sum_is_rounded_once(spark):
    draw = random.Random(9)
    rows = []
    for k in range(40):
        terms = [draw.gauss(0, 0.1) / 10 ** draw.randrange(5) for _ in range(60)]
        terms.append(-math.fsum(terms))
        rows += [(k, x) for x in draw.sample(terms, 61)]
    got = {r.k: r.s for r in spark.createDataFrame(rows, "k int, x double").repartition(7).groupBy("k").agg(ft.exact_sum(F.col("x")).alias("s")).collect()}
    want = {k: math.fsum(x for i, x in rows if i == k) for k in range(40)}
    assert any(want.values()) and {k: math.copysign(1, v) for k, v in got.items()} == {k: math.copysign(1, v) for k, v in want.items()}
    assert got == pytest.approx(want, rel=1e-6, abs=1e-24)


def test_pages_of_one_url_are_fetched_each_by_itself(spark, tmp_path):
    urls = ["http://a.com/x", "http://b.com/y#12", "http://a.com/x", "http://a.com/x", "http://c.com/"]
    pages = [(k, urls[k % 5], f"<p>{k}</p>") for k in range(1, 60)]
    spark.createDataFrame(pages, "page_id long, url string, html string").write.parquet(str(tmp_path / "pages.parquet"))
    con = duckdb.connect()
    con.sql(f"CREATE VIEW pages AS SELECT * FROM '{tmp_path}/pages.parquet/*.parquet'")
    df = qs.s4_fetch(spark, str(tmp_path))
    want = con.sql(f"SELECT {', '.join(df.columns)} FROM ({qs.ORACLE_SQL['s4_fetch']})").fetchall()
    assert sorted(map(repr, map(tuple, df.collect()))) == sorted(map(repr, want))
    assert len(want) == 59


def test_a_queue_asks_its_state_little():
    """Tasks in any order and in several pushes come out newest first, with far fewer calls to the state than tasks, and with few blocks in memory."""

    class State(dict):
        calls = 0

        def getValue(self, k):
            self.calls += 1
            return self.get(k)

        def updateValue(self, k, v):
            self.calls += 1
            self[k] = (list(v[0]), list(v[1]))

        def containsKey(self, k):
            return k in self

        def removeKey(self, k):
            self.calls += 1
            del self[k]

    state, draw, index, want, got = State(), random.Random(1), [], [], []
    numbers = list(range(20_000))
    draw.shuffle(numbers)
    for low in range(0, 20_000, 5000):
        tasks = st.Newest(state, index)
        tasks.push([(k, k / 2) for k in numbers[low : low + 5000]])
        want.extend(numbers[low : low + 5000])
        for _ in range(100):
            got.append(tasks.pull())
            assert got[-1] == (max(want), max(want) / 2)
            want.remove(got[-1][0])
        index = tasks.close()
    tasks = st.Newest(state, index)
    assert len(tasks) == len(want)
    while task := tasks.pull():
        got.append(task)
        assert len(tasks.held) <= st.HELD
    assert [k for k, _ in got[400:]] == sorted(want, reverse=True) and not state and not tasks.close()
    assert state.calls < 1000
