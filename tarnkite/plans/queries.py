"""The queries, by the capability that each shows, with their SQL where SQL has it."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import features as ft
from ..functions import text as tx
from ..functions import urls as u
from ..operators import frontier as fr
from ..operators import learn as ln
from ..operators import monitor as mo
from ..operators import seen as sn
from ..sources import bucketed as bk
from ..sources import tables as tb
from ..sources import web as wb
from ..streaming import frontier as st
from . import sql as q

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}
NODES = 5


def query(sql: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return keep


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """page_id, url, cleaned html; dealt out, for what follows is heavy on each page."""
    return tb.dealt(tb.read(spark, sf_dir, "pages")).select("page_id", "url", tx.ascii_clean("html").alias("html"))


# --- tables, queues, files -------------------------------------------------


@query("SELECT page_id, url FROM pages")
def s1_scan(spark, sf_dir):
    return tb.scan(tb.read(spark, sf_dir, "pages").select("page_id", "url"), "page_id")


@query("SELECT page_id, url FROM pages WHERE page_id = 17 UNION ALL SELECT page_id, url FROM pages WHERE page_id = (SELECT min(page_id) FROM pages)")
def s2_pick(spark, sf_dir):
    rows = tb.read(spark, sf_dir, "pages").select("page_id", "url")
    return tb.pick(rows, "page_id", 17).unionByName(tb.pick(rows, "page_id"))


@query("SELECT page_id, url FROM pages")
def s2_consume(spark, sf_dir):
    """All pages through a queue: each is taken once, though the queue is asked twice and grows in between."""
    rows, path = tb.read(spark, sf_dir, "pages").select("page_id", "url"), tb.new_path(spark, "consume")
    found = None
    for part in (0, 1):
        tb.append(rows.where(F.col("page_id") % 2 == part), f"{path}/queue")
        found = st.taken(spark, f"{path}/queue", "page_id long, url string", f"{path}/out", f"{path}/state")
    return found


UNBROKEN = """
WITH k AS (SELECT DISTINCT {key} AS k FROM {table}),
last AS (SELECT min(k) AS k FROM k WHERE k + 1 NOT IN (SELECT k FROM k))
"""


@query(UNBROKEN.format(key="doc_id // 3", table="labels") + "SELECT l.doc_id // 3 AS id, quality FROM labels l, last WHERE l.doc_id // 3 <= last.k")
def s3_unbroken(spark, sf_dir):
    rows = tb.read(spark, sf_dir, "labels").select(F.floor(F.col("doc_id") / 3).cast("long").alias("id"), "quality")
    return tb.unbroken(rows, "id")


SEEDS = ("http://h.com/a/b/c.html", "https://news.example.org/", "http://h.com/a/b/c.html")


def captures(spark, sf_dir) -> DataFrame:
    """page_id, url, html of pages, the page's number as a fragment of its URL: several pages may have one URL, and each is a capture of its own."""
    return tb.read(spark, sf_dir, "pages").select("page_id", F.concat("url", F.lit("#"), "page_id").alias("url"), "html")


def fetchable(rows: DataFrame) -> DataFrame:
    """Pages (page_id, url, html) as a fetch finds them (web.FETCHED); status and redirects are ours: three of ten lead on to the page after them, and one of ten is not found."""
    rows = rows.select("page_id", "url", "html")
    tenth, on = F.col("page_id") % 10, rows.select((F.col("page_id") - 1).alias("page_id"), F.col("url").alias("next"))
    rows = rows.join(on, "page_id", "left")
    moved = tenth.between(4, 6) | (F.col("page_id") % 100).between(40, 48)
    status = F.when(moved, 301).when(tenth == 8, 404).otherwise(200)
    return rows.select(u.host("url").alias("host"), "url", status.alias("status"), F.when(moved, F.coalesce("next", F.lit("http://nowhere.example/"))).alias("location"), F.when(status == 200, F.col("html")).alias("html"))


MOVED = "({x} % 10 BETWEEN 4 AND 6 OR {x} % 100 BETWEEN 40 AND 48)"


@query(f"""
WITH RECURSIVE f AS (
  SELECT page_id AS req, page_id AS spot, 0 AS redirects FROM pages
  UNION ALL SELECT req, spot + 1, redirects + 1 FROM f WHERE {MOVED.format(x='spot')} AND redirects < 5 AND spot IN (SELECT page_id FROM pages)),
last AS (SELECT req, max(spot) AS spot, max(redirects) AS redirects FROM f GROUP BY 1)
SELECT q.url, coalesce(p.url, 'http://nowhere.example/') AS final, redirects, CASE WHEN p.url IS NULL THEN NULL WHEN {MOVED.format(x='spot')} THEN 301 WHEN spot % 10 = 8 THEN 404 ELSE 200 END AS status,
       p.url IS NOT NULL AND NOT {MOVED.format(x='spot')} AND spot % 10 <> 8 AS ok,
       CASE WHEN p.url IS NOT NULL AND NOT {MOVED.format(x='spot')} AND spot % 10 <> 8 THEN md5(p.html) END AS body
FROM last JOIN pages q ON q.page_id = req LEFT JOIN pages p ON p.page_id = spot""")
def s4_fetch(spark, sf_dir):
    """Every page is fetched by its URL and number from an archive of all pages, over up to five redirects."""
    path, rows = tb.new_path(spark, "archive"), captures(spark, sf_dir)
    wb.write_archive(fetchable(rows), path)
    found = wb.fetched(rows.select("url"), wb.archive(spark, path))
    plain = lambda x: F.regexp_replace(x, r"#-?[0-9]+\z", "").alias(x)
    return found.select(plain("url"), plain("final"), "redirects", "status", "ok", F.md5(F.col("html").cast("binary")).alias("body"))


@query(f"""
WITH top AS (SELECT {q.host('url')} AS host FROM pages GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1)
SELECT url, CASE WHEN {MOVED.format(x='page_id')} THEN 301 WHEN page_id % 10 = 8 THEN 404 ELSE 200 END AS status FROM pages JOIN top ON top.host = {q.host('url')}
WHERE CASE WHEN {MOVED.format(x='page_id')} THEN 301 WHEN page_id % 10 = 8 THEN 404 ELSE 200 END < 400""")
def f7_archived_status(spark, sf_dir):
    """The answers below 400 of the host with the most pages, from an archive that is read for that host only."""
    path = tb.new_path(spark, "archive")
    wb.write_archive(fetchable(tb.read(spark, sf_dir, "pages")), path)
    top = tb.read(spark, sf_dir, "pages").groupBy(u.host("url").alias("host")).count().orderBy(F.desc("count"), "host").first()
    rows = wb.archive(spark, path).where(F.col("host") == (top["host"] if top else ""))
    return rows.where(F.col("status") < wb.FAILED).select("url", "status")


@query("SELECT * FROM (VALUES (0, 'http://h.com/a/b/c.html'), (1, 'https://news.example.org/'), (2, 'http://h.com/a/b/c.html')) t(seq, url)")
def s5_seeds(spark, sf_dir):
    return spark.createDataFrame(list(enumerate(SEEDS)), "seq int, url string")


@query("SELECT url, 0::BIGINT AS distance FROM pages")
def s6_restart(spark, sf_dir):
    path = tb.new_path(spark, "restart")
    tb.write_lines(tb.read(spark, sf_dir, "pages"), "url", path)
    return tb.read_lines(spark, path).select(F.col("value").alias("url"), F.lit(0).cast("long").alias("distance"))


@query("SELECT doc_id, CASE WHEN quality = 1 THEN 1 ELSE -1 END AS tc FROM labels")
def s8_feedback(spark, sf_dir):
    return tb.read(spark, sf_dir, "labels").select("doc_id", F.when(F.col("quality") == 1, 1).otherwise(-1).alias("tc"))


@query("SELECT page_id, url FROM pages")
def k1_append(spark, sf_dir):
    rows, path = tb.read(spark, sf_dir, "pages").select("page_id", "url"), tb.new_path(spark, "payload")
    tb.append(rows.where("page_id % 2 = 0"), path)
    tb.append(rows.where("page_id % 2 = 1"), path)
    return spark.read.parquet(path)


@query("SELECT page_id % 2 AS part, count(*)::BIGINT AS rows, sum(length(url))::BIGINT AS letters, true AS timed FROM pages GROUP BY 1")
def a9_observed_write(spark, sf_dir):
    """What two writes saw of themselves: rows, letters of URLs, and that time went by."""
    rows, path = tb.read(spark, sf_dir, "pages").select("page_id", "url"), tb.new_path(spark, "payload")
    seen = [(part, tb.counted_append(rows.where(F.col("page_id") % 2 == part), path, letters=F.length("url"))) for part in (0, 1)]
    return spark.createDataFrame([(part, x["rows"], x["letters"], x["seconds"] > 0) for part, x in seen], "part long, rows long, letters long, timed boolean")


@query("""
SELECT user_id AS id, arg_max(value, event_id) FILTER (event_type IN ('click', 'view')) AS value,
       arg_max(event_type, event_id) FILTER (event_type NOT IN ('click', 'view')) AS other
FROM events GROUP BY 1""")
def k2_upsert(spark, sf_dir):
    seen = F.col("event_type").isin("click", "view")
    log = tb.read(spark, sf_dir, "events").select(F.col("user_id").alias("id"), "event_id", F.when(seen, F.col("value")).alias("value"), F.when(~seen, F.col("event_type")).alias("other"))
    return mo.upserted(log, "id", "event_id")


@query("""
SELECT user_id AS id, arg_max(value, event_id) FILTER (event_type IN ('click', 'view') AND value IS NOT NULL) AS value,
       arg_max(event_type, event_id) FILTER (event_type NOT IN ('click', 'view')) AS other
FROM events GROUP BY 1""")
def k2_stored_upsert(spark, sf_dir):
    """The log of k2_upsert in three batches into a stored table, of which the second is done twice."""
    seen = F.col("event_type").isin("click", "view")
    log = tb.read(spark, sf_dir, "events").select(F.col("user_id").alias("id"), "event_id", F.when(seen, F.col("value")).alias("value"), F.when(~seen, F.col("event_type")).alias("other"))
    table = bk.BucketedTable(spark, tb.new_path(spark, "table"), "id long, event_id long, value double, other string", "id", "event_id")
    for batch in (0, 1, 1, 2):
        table.upsert(log.where(F.col("event_id") % 3 == batch), batch)
    return table.table()


@query("SELECT page_id, url FROM pages WHERE false")
def k3_clear(spark, sf_dir):
    rows, path = tb.read(spark, sf_dir, "pages").select("page_id", "url"), tb.new_path(spark, "cleared")
    tb.append(rows, path)
    tb.clear(rows, path)
    return spark.read.schema(rows.schema).parquet(path)


@query(f"SELECT node, page_id FROM (SELECT {q.node('url', NODES)} AS node, page_id, row_number() OVER (PARTITION BY {q.node('url', NODES)} ORDER BY page_id) AS n FROM pages) WHERE n <= 20")
def k4_capped_writer(spark, sf_dir):
    rows = tb.read(spark, sf_dir, "pages").select(u.node_of("url", NODES).alias("node"), "page_id")
    return tb.capped(rows, "node", "page_id", 20)


@query("SELECT event_id || ' ' || event_type AS value FROM events")
def k5_log_lines(spark, sf_dir):
    path = tb.new_path(spark, "log")
    lines = tb.read(spark, sf_dir, "events").select(F.concat_ws(" ", "event_id", "event_type").alias("line"))
    tb.write_lines(lines, "line", path)
    return tb.read_lines(spark, path)


PARENT = "lag({x}) OVER (PARTITION BY host ORDER BY page_id)"
METRICS = f"""
WITH {q.PAGES}, base AS (
  SELECT page_id, url, {q.host('url')} AS host, length({q.text('html')})::DOUBLE AS ptl, {q.links('html')}::DOUBLE AS nl, {q.longest('html')} AS lts FROM p),
rel AS (SELECT *, {PARENT.format(x='ptl')} AS p_ptl, {PARENT.format(x='nl')} AS p_nl FROM base)
SELECT url, ptl, round(coalesce(ptl / nullif(p_ptl, 0), 0), 9) AS rptl, round(CASE WHEN coalesce(p_ptl, 0) = 0 THEN 0 ELSE {q.squashed('ptl / p_ptl')} END, 9) AS rptl_norm,
       nl, round(coalesce(nl / nullif(p_nl, 0), 0), 9) AS rnl, round(CASE WHEN coalesce(p_nl, 0) = 0 THEN 0 ELSE {q.squashed('nl / p_nl')} END, 9) AS rnl_norm,
       lts, round({q.squashed('lts / 1000.0')}, 9) AS lts_norm
FROM rel"""


@query(METRICS)
def k7_page_metrics(spark, sf_dir):
    """The parent of a page is the page before it on its host, an invention of ours: the sample has no parents."""
    html = F.col("html")
    base = pages(spark, sf_dir).select("page_id", "url", u.host("url").alias("host"), F.length(tx.page_text(html)).cast("double").alias("ptl"), tx.link_count(html).cast("double").alias("nl"), tx.longest_text(html).alias("lts"))
    found = ft.page_metrics(ft.with_parents(base, "page_id", "ptl", "nl"))
    return found.select("url", "ptl", *(F.round(x, 9).alias(x) for x in ("rptl", "rptl_norm")), "nl", *(F.round(x, 9).alias(x) for x in ("rnl", "rnl_norm")), "lts", F.round("lts_norm", 9).alias("lts_norm"))


@query(METRICS)
def k7_metrics_csv(spark, sf_dir):
    """The same nine columns, written as CSV with a header and read back."""
    found, path = k7_page_metrics(spark, sf_dir), tb.new_path(spark, "metrics") + "/html_metrics.csv"
    tb.write_csv(found, path)
    return spark.read.schema(found.schema).csv(path, header=True)


@query("SELECT url FROM pages UNION ALL SELECT url FROM pages WHERE page_id % 2 = 0 UNION ALL SELECT url FROM pages WHERE page_id < 10")
def k8_restart_dump(spark, sf_dir):
    rows, path = tb.read(spark, sf_dir, "pages").select("page_id", "url"), tb.new_path(spark, "dump")
    tb.write_lines(tb.bag_union(rows, rows.where("page_id % 2 = 0"), rows.where("page_id < 10")), "url", path)
    return tb.read_lines(spark, path).select(F.col("value").alias("url"))


# --- projections and filters -----------------------------------------------


@query(f"SELECT page_id, {q.normal('url')} AS url FROM pages")
def f1_normal_url(spark, sf_dir):
    return tb.read(spark, sf_dir, "pages").select("page_id", u.normal_url("url").alias("url"))


@query(r"SELECT page_id FROM pages WHERE NOT regexp_matches(url, '(m|blog)\.[a-z]+\.example')")
def f2_block(spark, sf_dir):
    return tb.read(spark, sf_dir, "pages").where(~u.is_blocked("url", r"(m|blog)\.[a-z]+\.example")).select("page_id")


@query(f"WITH {q.LINKS} SELECT page_id, pos::INT AS pos, url, {q.safe('url')} AS safe FROM links")
def f3_safe(spark, sf_dir):
    return u.page_links(pages(spark, sf_dir)).select("page_id", "pos", "url", u.is_safe("url").alias("safe"))


DOCS = "('http://h.com/a.pdf'), ('http://h.com/a.docx/'), ('http://h.com/b.rtf?x=1'), ('http://h.com/c.txt'), ('http://h.com/d.html'), ('http://h.com/e.doc#p')"


@query(rf"SELECT url, CASE WHEN regexp_matches({q.path('url')}, '{u.DOCUMENT_PATH}') THEN '[' || regexp_extract({q.path('url')}, '{u.DOCUMENT_PATH}', 1) || ']' END AS marker FROM (SELECT url FROM pages UNION ALL SELECT url FROM (VALUES {DOCS}) t(url))")
def f4_document_marker(spark, sf_dir):
    """All pages' URLs, and some of documents, which the sample lacks."""
    rows = tb.read(spark, sf_dir, "pages").select("url").unionByName(spark.sql(f"SELECT * FROM VALUES {DOCS} AS t(url)"))
    return rows.select("url", u.document_marker("url").alias("marker"))


@query("SELECT s_suppkey, 'addr' || n_nationkey AS addr FROM supplier JOIN nation ON s_nationkey = n_nationkey WHERE n_regionkey < 3")
def f5_resolvable(spark, sf_dir):
    """Hosts with a known address; nations serve as hosts."""
    known = tb.read(spark, sf_dir, "nation").where("n_regionkey < 3").select(F.col("n_nationkey").alias("host"), F.concat(F.lit("addr"), "n_nationkey").alias("addr"), F.current_timestamp().alias("checked_at"))
    rows = tb.read(spark, sf_dir, "supplier").select("s_suppkey", F.col("s_nationkey").alias("host"))
    return fr.resolvable(fr.addresses(rows, known, F.current_timestamp())).select("s_suppkey", "addr")


@query(f"WITH {q.LINKS} SELECT page_id, pos::INT AS pos FROM links WHERE {q.host('url')} = {q.host('parent_url')}")
def f6_distance(spark, sf_dir):
    rows = u.page_links(pages(spark, sf_dir)).withColumn("d", fr.child_distance(u.host("url"), u.host("parent_url"), F.lit(0)))
    return rows.where("d <= 0").select("page_id", "pos")


@query("SELECT event_id, event_type FROM events WHERE CASE WHEN event_type = 'error' THEN 500 ELSE 200 END < 400")
def f7_status(spark, sf_dir):
    return tb.read(spark, sf_dir, "events").withColumn("status", F.when(F.col("event_type") == "error", 500).otherwise(200)).where("status < 400").select("event_id", "event_type")


@query(rf"SELECT page_id, regexp_matches({q.path('url')} || CASE WHEN page_id % 2 = 0 THEN '/page_' || page_id || '.csv' ELSE '' END, '{tb.CSV_PATH}') AS csv FROM pages")
def f13_csv_paths(spark, sf_dir):
    """Which pages' paths, every other one with a file's name after it, a CSV file may be written to."""
    name = F.when(F.col("page_id") % 2 == 0, F.concat(F.lit("/page_"), "page_id", F.lit(".csv"))).otherwise("")
    return tb.read(spark, sf_dir, "pages").select("page_id", tb.is_csv(F.concat(u.path("url"), name)).alias("csv"))


@query("SELECT p.page_id, p.url, p.html FROM pages p JOIN labels l ON l.doc_id = p.page_id WHERE l.quality = 1")
def f9_positives(spark, sf_dir):
    labels = s8_feedback(spark, sf_dir).where("tc = 1").select(F.col("doc_id").alias("page_id"))
    return tb.read(spark, sf_dir, "pages").join(labels, "page_id").select("page_id", "url", "html")


@query("SELECT p.page_id, p.url, CASE WHEN l.quality = 1 THEN 1 ELSE -1 END AS tc FROM pages p JOIN labels l ON l.doc_id = p.page_id")
def f10_to_batch_test(spark, sf_dir):
    labels = s8_feedback(spark, sf_dir).select(F.col("doc_id").alias("page_id"), "tc")
    return tb.read(spark, sf_dir, "pages").join(labels, "page_id").select("page_id", "url", "tc")


@query("SELECT page_id, url, -1 AS tc FROM pages")
def f11_populate(spark, sf_dir):
    return tb.unbroken(tb.read(spark, sf_dir, "pages").select("page_id", "url"), "page_id").withColumn("tc", F.lit(-1))


@query(f"WITH {q.LINKS} SELECT {q.node('url', NODES)} AS node, {q.node('url', NODES)}::INT AS part, url, parent_url FROM links")
def t17_routed(spark, sf_dir):
    """All links, those of node n in partition n and in no other; part is the partition in which each arrived."""
    return u.routed(u.page_links(pages(spark, sf_dir)).withColumn("node", u.node_of("url", NODES)), NODES).select("node", F.spark_partition_id().alias("part"), "url", "parent_url")


@query(f"WITH {q.LINKS} SELECT {q.node('url', NODES)} AS node, url, parent_url FROM links")
def f12_message(spark, sf_dir):
    rows = u.page_links(pages(spark, sf_dir)).withColumn("node", u.node_of("url", NODES))
    return u.routed(rows, NODES).select("node", "url", "parent_url")


# --- joins -------------------------------------------------------------------


@query(f"""
WITH {q.LINKS}, c AS (SELECT {q.normal('url')} AS url, page_id * 100000 + pos AS seq FROM links)
SELECT url, min(seq)::BIGINT AS seq FROM c WHERE url NOT IN (SELECT {q.normal('url')} FROM pages) GROUP BY url""")
def j1_unseen(spark, sf_dir):
    rows = u.page_links(pages(spark, sf_dir)).select(u.normal_url("url").alias("url"), (F.col("page_id") * 100000 + F.col("pos")).alias("seq"))
    return fr.unseen(rows, tb.read(spark, sf_dir, "pages").select(u.normal_url("url").alias("url")))


@query(f"""
WITH {q.LINKS}, c AS (SELECT {q.normal('url')} AS url, page_id * 100000 + pos AS seq FROM links UNION ALL SELECT {q.normal('url')}, 10000000000 + page_id FROM pages)
SELECT url, min(seq)::BIGINT AS seq FROM c WHERE url NOT IN (SELECT {q.normal('url')} FROM pages) GROUP BY url""")
def j1_seen_filter(spark, sf_dir):
    """Links and the pages' own URLs against all URLs seen, by a filter that one run made of half of the pages and the next one opened and added the others to."""
    seen, path = tb.read(spark, sf_dir, "pages").select("page_id", u.normal_url("url").alias("url")), tb.new_path(spark, "seen")
    sn.SeenFilter(spark, path, max(1000, seen.count())).add(seen.where("page_id % 2 = 0"))
    opened = sn.SeenFilter(spark, path)
    opened.add(seen.where("page_id % 2 = 1"))
    links = u.page_links(pages(spark, sf_dir)).select(u.normal_url("url").alias("url"), (F.col("page_id") * 100000 + F.col("pos")).alias("seq"))
    return fr.unseen(links.unionByName(seen.select("url", (F.col("page_id") + 10_000_000_000).alias("seq"))), seen, opened)


@query("""
SELECT s_suppkey, 'addr' || n_nationkey AS addr, coalesce(n_regionkey >= 3, true) AS stale
FROM supplier LEFT JOIN nation ON s_nationkey = n_nationkey AND n_regionkey < 4""")
def j2_addresses(spark, sf_dir):
    now = F.to_timestamp(F.lit("2024-01-02 00:00:00"))
    known = tb.read(spark, sf_dir, "nation").where("n_regionkey < 4")
    known = known.select(F.col("n_nationkey").alias("host"), F.concat(F.lit("addr"), "n_nationkey").alias("addr"), (now - F.expr("make_dt_interval(0, n_regionkey * 2 + 1)")).alias("checked_at"))
    rows = tb.read(spark, sf_dir, "supplier").select("s_suppkey", F.col("s_nationkey").alias("host"))
    return fr.addresses(rows, known, now).select("s_suppkey", "addr", "stale")


LOOKED_UP = """
looked AS (SELECT user_id AS host, ts, max(event_id) AS event_id, arg_max(event_type, event_id) AS event_type FROM events WHERE event_type IN ('purchase', 'error') GROUP BY 1, 2),
asked AS (
  SELECT e.event_id, e.user_id AS host, e.ts, CASE WHEN l.event_type = 'purchase' THEN 'addr' || l.event_id END AS addr,
         CASE WHEN l.event_type = 'purchase' THEN floor(epoch(e.ts)) - floor(epoch(l.ts)) > 21600 ELSE true END AS stale
  FROM (SELECT * FROM events WHERE event_type NOT IN ('purchase', 'error')) e ASOF LEFT JOIN looked l ON e.user_id = l.host AND e.ts >= l.ts)"""


def asked(spark, sf_dir) -> DataFrame:
    """Events as requests to hosts (users), at which purchases and errors are lookups of the host's address that went well or failed."""
    rows = tb.read(spark, sf_dir, "events").select(F.col("user_id").alias("host"), F.col("ts").alias("at"), "event_id", "event_type")
    lookup = F.col("event_type").isin("purchase", "error")
    found = F.when(F.col("event_type") == "purchase", F.concat(F.lit("addr"), "event_id")).alias("addr")
    return fr.addresses_then(rows.where(~lookup), rows.where(lookup).select("host", "at", F.col("event_id").alias("seq"), found))


@query(f"WITH {LOOKED_UP} SELECT event_id, addr, stale FROM asked")
def j2_addresses_then(spark, sf_dir):
    """Each request with the address that its host had at that time."""
    return asked(spark, sf_dir).select("event_id", "addr", "stale")


@query(f"WITH {LOOKED_UP} SELECT host, max(ts) AS at FROM asked GROUP BY 1 HAVING arg_max(stale, (ts, stale))")
def j2_refresh(spark, sf_dir):
    """Hosts whose address has to be looked up again after their last request."""
    return fr.to_refresh(asked(spark, sf_dir))


STATS = f"stats AS (SELECT page_id, url, length({q.text('html')})::DOUBLE AS text_length, {q.links('html')}::DOUBLE AS links, {q.title('html')} AS title FROM p)"


@query(f"""
WITH {q.LINKS}, {STATS}, {q.ranked('titles', 'stats', 'page_id', 'title')}
SELECT l.page_id, l.pos::INT AS pos, l.url, s.text_length, s.links, array_to_string(coalesce(t.words, []), ',') AS title_tokens, array_to_string(l.link_tokens, ',') AS link_tokens
FROM links l JOIN stats s ON s.page_id = l.page_id LEFT JOIN titles t ON t.page_id = l.page_id""")
def j3_carried_stats(spark, sf_dir):
    rows = pages(spark, sf_dir)
    stats = rows.select("page_id", *ft.passed_stats(F.col("html")))
    found = u.page_links(rows).join(stats, "page_id")
    return found.select("page_id", "pos", "url", "text_length", "links", F.array_join("title_tokens", ",").alias("title_tokens"), F.array_join("link_tokens", ",").alias("link_tokens"))


@query("SELECT page_id, url, quality FROM pages JOIN labels ON doc_id = page_id")
def j4_feedback_join(spark, sf_dir):
    return tb.read(spark, sf_dir, "pages").join(tb.read(spark, sf_dir, "labels").withColumnRenamed("doc_id", "page_id"), "page_id").select("page_id", "url", "quality")


WEIGHTED = f"""
x AS (SELECT doc_id AS id, token AS key, n / sqrt(sum(n * n) OVER (PARTITION BY doc_id)) AS value FROM (
  SELECT doc_id, token, count(*)::DOUBLE AS n FROM (SELECT doc_id, unnest({q.tokens('text')}) AS token FROM documents)
  WHERE length(token) > 3 AND token NOT IN {q.STOP} GROUP BY ALL)),
w AS (SELECT DISTINCT key, ({q.draw('key')} % 1000) / 500.0 - 1 AS weight FROM x)"""


def count_vectors(spark, sf_dir) -> DataFrame:
    """id, key, value: unit vectors of word counts, stored; each row is on its own, without a shuffle."""
    docs = tb.dealt(tb.read(spark, sf_dir, "documents").select("doc_id", "text"))
    words = F.filter(tx.word_tokens("text"), tx.topical)
    sized = tx.bound(tx.counted(words), lambda p: F.struct(p.alias("p"), F.sqrt(F.aggregate(p, F.lit(0.0), lambda acc, e: acc + (e["n"] * e["n"]).cast("double"))).alias("size")))
    rows = docs.select(F.col("doc_id").alias("id"), sized.alias("s"))
    rows = rows.select("id", F.col("s.size").alias("size"), F.explode("s.p").alias("e"))
    return tb.stored(rows.select("id", F.col("e.w").alias("key"), (-F.col("e.n") / F.col("size")).alias("value")), "vectors")


def weighted_terms(spark, sf_dir) -> DataFrame:
    """id, term: what each word of a document adds to its score."""
    x = count_vectors(spark, sf_dir)
    w = x.select("key").distinct().withColumn("weight", (F.floor(fr.fixed_draw(F.col("key")) * float(1 << 32)).cast("long") % 1000) / 500.0 - 1)
    return x.join(w, "key").select("id", (F.col("value") * F.col("weight")).alias("term"))


@query(f"WITH {WEIGHTED} SELECT id, round(sum(value * weight), 9) AS score FROM x JOIN w USING (key) GROUP BY id")
def j5_vector_weights(spark, sf_dir):
    return weighted_terms(spark, sf_dir).groupBy("id").agg(F.round(F.sum("term"), 9).alias("score"))


@query(f"WITH {q.LINKS} SELECT page_id, list(url ORDER BY pos)[1] AS first_url, count(*) AS n, list(url ORDER BY pos)[-1] AS last_url FROM links GROUP BY page_id")
def j6_zip(spark, sf_dir):
    rows = u.page_links(pages(spark, sf_dir)).groupBy("page_id").agg(F.array_sort(F.collect_list(F.struct("pos", "url"))).alias("l"))
    zipped = rows.select("page_id", F.arrays_zip(F.transform("l", lambda x: x["url"]).alias("url"), F.transform("l", lambda x: x["pos"]).alias("pos")).alias("z"))
    return zipped.select("page_id", F.element_at("z", 1)["url"].alias("first_url"), F.size("z").cast("long").alias("n"), F.element_at("z", -1)["url"].alias("last_url"))


@query("SELECT o_orderkey, CASE WHEN o_custkey % 7 = o_orderkey % 7 THEN 2 ELSE 3 END AS distance FROM orders")
def j7_child_distance(spark, sf_dir):
    return tb.read(spark, sf_dir, "orders").select("o_orderkey", fr.child_distance(F.col("o_custkey") % 7, F.col("o_orderkey") % 7, F.lit(2)).alias("distance"))


# --- aggregates ----------------------------------------------------------------


@query(f"SELECT doc_id, token, count(*) AS n FROM (SELECT doc_id, unnest({q.tokens('text')}) AS token FROM documents) WHERE length(token) > 3 AND token NOT IN {q.STOP} GROUP BY ALL")
def a1_word_counts(spark, sf_dir):
    return tx.word_counts(tb.read(spark, sf_dir, "documents"), "doc_id", "text")


BEATS = f"""
SELECT user_id % {NODES} AS id, 1 AS init, 0 AS active_count, count(*) FILTER (event_type = 'click') AS rcount, count(*) FILTER (event_type = 'click') AS scount,
       count(*) FILTER (event_type = 'error') AS failure, 0 AS stop_order FROM events GROUP BY 1"""


def beats(spark, sf_dir) -> DataFrame:
    """Heartbeats of NODES nodes, from events: clicks are messages, errors failures."""
    kind = lambda x: F.count(F.when(F.col("event_type") == x, 1))
    rows = tb.read(spark, sf_dir, "events").groupBy((F.col("user_id") % NODES).alias("id"))
    return rows.agg(F.lit(1).alias("init"), F.lit(0).alias("active_count"), kind("click").alias("rcount"), kind("click").alias("scount"), kind("error").alias("failure"), F.lit(0).alias("stop_order"))


@query(f"SELECT sum(init)::BIGINT AS init, sum(active_count)::BIGINT AS active_count, sum(rcount)::BIGINT AS rcount, sum(scount)::BIGINT AS scount, sum(failure)::BIGINT AS failure, sum(stop_order)::BIGINT AS stop_order FROM ({BEATS})")
def a2_totals(spark, sf_dir):
    return mo.totals(beats(spark, sf_dir))


CASES = "(5, 0, 7, 7, 0, 0, 0), (5, 0, 7, 7, 1, 1, 1), (5, 3, 7, 7, 1, 1, 0), (5, 3, 7, 7, 0, 1, 1), (5, 3, 7, 7, 0, 0, 1), (4, 0, 7, 7, 0, 0, 0), (5, 0, 6, 7, 0, 0, 0)"


@query(f"""
SELECT *, CASE WHEN active_count = 0 AND rcount = scount AND init = 5 THEN 0 WHEN own > 0 THEN 1 WHEN failure > 0 THEN 2 WHEN stop_order > 0 THEN 3 END AS verdict
FROM (VALUES {CASES}) t(init, active_count, rcount, scount, own, failure, stop_order)""")
def a3_verdict(spark, sf_dir):
    rows = spark.sql(f"SELECT * FROM VALUES {CASES} AS t(init, active_count, rcount, scount, own, failure, stop_order)")
    return rows.withColumn("verdict", mo.verdict(NODES, F.col("own")))


@query("SELECT count(*) AS total, count(*) FILTER (event_type = 'error') AS failed, count(*) FILTER (event_type <> 'error') AS written, count(DISTINCT user_id) AS hosts FROM events")
def a4_counters(spark, sf_dir):
    bad = F.col("event_type") == "error"
    return tb.read(spark, sf_dir, "events").agg(F.count("*").alias("total"), F.count(F.when(bad, 1)).alias("failed"), F.count(F.when(~bad, 1)).alias("written"), F.count_distinct("user_id").alias("hosts"))


@query(f"SELECT {q.host('url')} AS host, count(*) AS depth FROM pages GROUP BY 1")
def a5_queue_depth(spark, sf_dir):
    return mo.queue_depths(tb.read(spark, sf_dir, "pages").select(u.host("url").alias("host")))


@query("SELECT vec_id, round(sqrt(list_sum(list_transform(embedding, lambda v: v::DOUBLE * v::DOUBLE))), 9) AS norm, round(list_sum(list_transform(embedding, lambda v: v::DOUBLE)), 9) AS dot_one FROM embeddings")
def a6_norms(spark, sf_dir):
    fold = lambda f: F.aggregate("embedding", F.lit(0.0), lambda acc, v: acc + f(v.cast("double")))
    return tb.read(spark, sf_dir, "embeddings").select("vec_id", F.round(F.sqrt(fold(lambda v: v * v)), 9).alias("norm"), F.round(fold(lambda v: v), 9).alias("dot_one"))


@query(f"WITH {q.PAGES} SELECT page_id, {q.longest('html')} AS lts FROM p")
def a7_t5_longest_text(spark, sf_dir):
    return pages(spark, sf_dir).select("page_id", tx.longest_text("html").alias("lts"))


@query(f"WITH {q.PAGES} SELECT page_id, {q.links('html')} AS n FROM p")
def a8_link_count(spark, sf_dir):
    return pages(spark, sf_dir).select("page_id", tx.link_count("html").alias("n"))


# --- order and windows ---------------------------------------------------------


@query(f"SELECT page_id, row_number() OVER (PARTITION BY {q.host('url')} ORDER BY page_id DESC) AS turn FROM pages")
def w1_newest_first(spark, sf_dir):
    return fr.newest_first(tb.read(spark, sf_dir, "pages").select("page_id", u.host("url").alias("host"), F.col("page_id").alias("seq"))).select("page_id", "turn")


DELAY = f"CASE WHEN page_id % 5 <> 0 THEN 10.0 * (page_id % 7) / 10.0 + {q.draw('page_id::VARCHAR')} / 4294967296.0 * 60.0 ELSE (0.5 + {q.draw('page_id::VARCHAR')} / 4294967296.0) * 60.0 END"


def tasks(spark, sf_dir) -> DataFrame:
    """Fetch tasks with delays: every fifth fails; draws are fixed by page_id."""
    delay = fr.delay(F.col("page_id") % 5 != 0, (F.col("page_id") % 7) / 10.0, fr.fixed_draw(F.col("page_id")))
    return tb.read(spark, sf_dir, "pages").select("page_id", u.host("url").alias("host"), F.col("page_id").alias("seq"), delay.alias("delay"))


STARTS = f"SELECT page_id, {q.host('url')} AS host, coalesce(sum({DELAY}) OVER (PARTITION BY {q.host('url')} ORDER BY page_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start FROM pages"


@query(f"SELECT page_id, round(start, 6) AS start FROM ({STARTS})")
def w2_pull_times(spark, sf_dir):
    return fr.pull_times(tasks(spark, sf_dir)).select("page_id", F.round("start", 6).alias("start"))


TITLES = f"{q.PAGES}, t AS (SELECT page_id, {q.title('html')} AS title FROM p), toks AS (SELECT page_id, unnest(x) AS token, unnest(range(len(x))) AS pos FROM (SELECT page_id, {q.tokens('title')} AS x FROM t))"


@query(f"WITH {TITLES}, f AS (SELECT token, min(page_id * 100000 + pos) AS place FROM toks GROUP BY 1) SELECT token, row_number() OVER (ORDER BY place) - 1 AS idx FROM f")
def w3_feature_index(spark, sf_dir):
    rows = pages(spark, sf_dir).select(F.col("page_id").alias("id"), F.posexplode(tx.word_tokens(tx.title("html"))).alias("pos", "token"))
    return ln.feature_index(rows)


@query(UNBROKEN.format(key="doc_id // 2", table="labels") + "SELECT count(*) AS n, max(l.doc_id // 2) AS last FROM labels l, last WHERE l.doc_id // 2 <= last.k")
def w4_unbroken_count(spark, sf_dir):
    rows = tb.read(spark, sf_dir, "labels").select(F.floor(F.col("doc_id") / 2).cast("long").alias("id"))
    return tb.unbroken(rows, "id").agg(F.count("*").alias("n"), F.max("id").alias("last"))


@query(f"""
WITH h AS (SELECT {q.host('url')} AS host, min(page_id) AS place FROM pages GROUP BY 1), s AS (SELECT host, row_number() OVER (ORDER BY place, host) AS slot FROM h)
SELECT page_id, CASE WHEN slot <= 6 THEN slot END AS slot, slot <= 6 AS live FROM pages JOIN s ON s.host = {q.host('url')}""")
def w5_host_slots(spark, sf_dir):
    return fr.host_slots(tasks(spark, sf_dir)).select("page_id", "slot", "live")


@query(f"WITH {q.PAGES}, t AS (SELECT page_id, {q.text('html')} AS body FROM p), {q.ranked('top', 't', 'page_id', 'body', 'WHERE r <= 20')} SELECT t.page_id, array_to_string(coalesce(words, []), ' ') AS words FROM t LEFT JOIN top USING (page_id)")
def o1_t4_frequent_words(spark, sf_dir):
    found = tx.frequent_words(pages(spark, sf_dir).select("page_id", tx.page_text("html").alias("body")), "page_id", "body", 20)
    return found.select("page_id", F.array_join("words", " ").alias("words"))


@query(f"SELECT page_id, host, start, row_number() OVER (ORDER BY start, host, page_id) AS rank FROM (SELECT page_id, host, round(start, 6) AS start FROM ({STARTS}))")
def o2_task_queue(spark, sf_dir):
    """All tasks, with their rank in the queue."""
    rows = fr.pull_times(tasks(spark, sf_dir)).select("page_id", "host", F.round("start", 6).alias("start"))
    return fr.queue_order(rows, "start", "host", "page_id")


@query("SELECT doc_id, lang FROM documents ORDER BY doc_id LIMIT 10")
def o3_limit(spark, sf_dir):
    return tb.scan(tb.read(spark, sf_dir, "documents").select("doc_id", "lang"), "doc_id", 10)


@query(f"SELECT host, page_id FROM (SELECT {q.host('url')} AS host, page_id, row_number() OVER (PARTITION BY {q.host('url')} ORDER BY page_id) AS n FROM pages) WHERE n <= 3")
def o4_crawl_cap(spark, sf_dir):
    return tb.capped(tb.read(spark, sf_dir, "pages").select(u.host("url").alias("host"), "page_id"), "host", "page_id", 3)


@query(f"WITH {TITLES} SELECT page_id, array_to_string(list_sort(list_distinct(list(token))), ' ') AS tokens FROM toks GROUP BY 1")
def o5_sorted_tokens(spark, sf_dir):
    rows = pages(spark, sf_dir).select("page_id", tx.word_tokens(tx.title("html")).alias("t")).where(F.size("t") > 0)
    return rows.select("page_id", F.array_join(F.array_sort(F.array_distinct("t")), " ").alias("tokens"))


@query("SELECT url, count(*) AS n FROM (SELECT url FROM pages UNION ALL SELECT url FROM pages WHERE page_id % 3 = 0) GROUP BY 1")
def u1_bag_union(spark, sf_dir):
    rows = tb.read(spark, sf_dir, "pages")
    return tb.bag_union(rows, rows.where("page_id % 3 = 0")).groupBy("url").agg(F.count("*").alias("n"))


@query(f"SELECT page_id, array_to_string(list_filter({q.tokens('title')}, lambda t: t NOT IN {q.STOP}), ' ') AS kept FROM (WITH {q.PAGES} SELECT page_id, {q.title('html')} AS title FROM p)")
def u2_stop_words(spark, sf_dir):
    return pages(spark, sf_dir).select("page_id", F.array_join(F.filter(tx.word_tokens(tx.title("html")), lambda t: ~t.isin(*tx.STOP_WORDS)), " ").alias("kept"))


@query(f"WITH {q.LINKS} SELECT DISTINCT url FROM links WHERE url NOT IN (SELECT url FROM pages)")
def u3_frontier_minus_seen(spark, sf_dir):
    return u.page_links(pages(spark, sf_dir)).select("url").distinct().join(tb.read(spark, sf_dir, "pages").select("url"), "url", "left_anti")


# --- functions -------------------------------------------------------------------


@query(f"WITH {q.PAGES} SELECT page_id, md5(html) AS html FROM p")
def t1_clean(spark, sf_dir):
    return pages(spark, sf_dir).select("page_id", F.md5(F.col("html").cast("binary")).alias("html"))


@query(f"WITH {q.PAGES} SELECT page_id, md5({q.text('html')}) AS body, length({q.text('html')}) AS n FROM p")
def t2_page_text(spark, sf_dir):
    return pages(spark, sf_dir).select("page_id", tx.page_text("html").alias("t")).select("page_id", F.md5(F.col("t").cast("binary")).alias("body"), F.length("t").cast("long").alias("n"))


@query(f"WITH {TITLES} SELECT page_id, array_to_string(list(token ORDER BY pos), ' ') AS tokens FROM toks GROUP BY 1")
def t3_tokens(spark, sf_dir):
    rows = pages(spark, sf_dir).select("page_id", tx.word_tokens(tx.title("html")).alias("t")).where(F.size("t") > 0)
    return rows.select("page_id", F.array_join("t", " ").alias("tokens"))


@query(f"SELECT t, round({q.squashed('t')}, 12) AS v FROM (VALUES (0.0::DOUBLE), (-1.0), (0.1), (0.5), (1.0), (2.0), (10.0)) x(t)")
def t6_squashed(spark, sf_dir):
    return spark.sql("SELECT * FROM VALUES (0.0D), (-1.0D), (0.1D), (0.5D), (1.0D), (2.0D), (10.0D) AS x(t)").select("t", F.round(tx.squashed(F.col("t")), 12).alias("v"))


@query(f"WITH {q.PAGES}, t AS (SELECT page_id, {q.title('html')} AS title FROM p), {q.ranked('r', 't', 'page_id', 'title')} SELECT t.page_id, array_to_string(coalesce(words, []), ' ') AS words FROM t LEFT JOIN r USING (page_id)")
def t7_title_words(spark, sf_dir):
    return pages(spark, sf_dir).select("page_id", F.array_join(tx.ranked_words(tx.title("html")), " ").alias("words"))


@query("SELECT page_id, md5(regexp_replace(regexp_replace(html, '^.*?<body[^>]*>', '', 's'), '</body>.*$', '', 's')) AS body FROM pages")
def t8_body(spark, sf_dir):
    return tb.read(spark, sf_dir, "pages").select("page_id", F.md5(tx.body("html").cast("binary")).alias("body"))


@query(f"""
WITH {q.PAGES}, {STATS}, {q.ranked('titles', 'stats', 'page_id', 'title')}
SELECT page_id, text_length, links, len(coalesce(words, [])) AS title_n, 0 AS link_n, array_to_string(coalesce(words, []), ',') AS title_tokens
FROM stats s LEFT JOIN titles t USING (page_id)""")
def t9_stats_codec(spark, sf_dir):
    """The statistics that each page passes on, written as text and read back."""
    none = F.array().cast("array<string>").alias("link_tokens")
    rows = pages(spark, sf_dir).select("page_id", ft.stats_to_text(F.struct(*ft.passed_stats(F.col("html")), none)).alias("line"))
    back = rows.withColumn("b", ft.stats_from_text(F.col("line")))
    return back.select("page_id", "b.text_length", "b.links", F.size("b.title_tokens").cast("long").alias("title_n"), F.size("b.link_tokens").alias("link_n"), F.array_join("b.title_tokens", ",").alias("title_tokens"))


@query(f"SELECT page_id, {q.scheme('url')} AS scheme, {q.host('url')} AS host, {q.path('url')} AS path FROM pages")
def t10_url_parts(spark, sf_dir):
    return tb.read(spark, sf_dir, "pages").select("page_id", u.scheme("url").alias("scheme"), u.host("url").alias("host"), u.path("url").alias("path"))


@query(f"SELECT page_id, {q.scheme('url')} || '://10.0.0.1' || regexp_extract(url, '^(?:[^:/?#]+:)?(?://[^/?#]*)?(.*)$', 1) AS address FROM pages")
def t11_fetch_address(spark, sf_dir):
    return tb.read(spark, sf_dir, "pages").select("page_id", u.fetch_address("url", F.lit("10.0.0.1")).alias("address"))


LINK_CASES = ["http://x.org/a", "/go?u=http://x.org", "www.foo.com", "www.foo.com/a.html", "a.b.html", "foo.com/bar", "mailto:a@b.com", "/root.html", "./near.html", "../up.html", "../../up2.html", "page.html#s", "page.html?q=1", "about", "dir/page.html", "#top", "?q=1", "javascript:void(0)"]
REF_CASES = ["http://h.com/a/b/c.html", "http://h.com/", "http://h.com", "no-slashes"]
BASE_CASES = ["NULL", "'http://base.org/x/'"]
CROSS = "(VALUES " + ", ".join(f"('{x}')" for x in LINK_CASES) + ") l(link), (VALUES " + ", ".join(f"('{x}')" for x in REF_CASES) + ") r(ref), (VALUES " + ", ".join(f"({x})" for x in BASE_CASES) + ") b(base)"


@query(f"SELECT link, ref, base, {q.resolved('link', 'ref', 'base')} AS url FROM {CROSS}")
def t12_resolve(spark, sf_dir):
    rows = [(x, r, b) for x in LINK_CASES for r in REF_CASES for b in (None, "http://base.org/x/")]
    return spark.createDataFrame(rows, "link string, ref string, base string").select("link", "ref", "base", u.resolve("link", "ref", "base").alias("url"))


@query(f"WITH {q.LINKS} SELECT page_id, pos::INT AS pos, url, array_to_string(link_tokens, ' ') AS link_tokens FROM links")
def t13_links(spark, sf_dir):
    return u.page_links(pages(spark, sf_dir)).select("page_id", "pos", "url", F.array_join("link_tokens", " ").alias("link_tokens"))


BASES = ['<base href="http://b.org/">', '<base target="x" href="http://c.org/d">', "<p>none</p>"]


@query(f"""SELECT md5(html) AS html, nullif(regexp_extract(html, '{q.plain(u.BASE_TAG)}', 1), '') AS base FROM (SELECT html FROM pages UNION ALL SELECT * FROM (VALUES {', '.join(f"('{x}')" for x in BASES)}))""")
def t14_base(spark, sf_dir):
    """All pages, and some with a base, which the sample lacks."""
    rows = tb.read(spark, sf_dir, "pages").select("html").unionByName(spark.createDataFrame([(x,) for x in BASES], "html string"))
    return rows.select(F.md5(F.col("html").cast("binary")).alias("html"), u.base_href("html").alias("base"))


@query(f"WITH {q.PAGES}, {STATS}, {q.ranked('titles', 'stats', 'page_id', 'title')} SELECT s.page_id, text_length, links, array_to_string(coalesce(words, []), ',') AS title_tokens FROM stats s LEFT JOIN titles t ON t.page_id = s.page_id")
def t15_passed_stats(spark, sf_dir):
    return pages(spark, sf_dir).select("page_id", *ft.passed_stats(F.col("html"))).withColumn("title_tokens", F.array_join("title_tokens", ","))


FEATURES = f"""
WITH {q.PAGES}, base AS (
  SELECT page_id, {q.host('url')} AS host, {q.text('html')} AS body, {q.links('html')}::DOUBLE AS links, {q.title('html')} AS title, {q.longest('html')} AS run FROM p),
{q.ranked('titles', 'base', 'page_id', 'title')},
{q.ranked('tops', 'base', 'page_id', 'body', 'WHERE r <= 20')},
own AS (SELECT b.*, length(body)::DOUBLE AS n, coalesce(t.words, []) AS title_words, coalesce(o.words, []) AS top_words
  FROM base b LEFT JOIN titles t USING (page_id) LEFT JOIN tops o USING (page_id)),
rel AS (SELECT *, {PARENT.format(x='n')} AS p_n, {PARENT.format(x='links')} AS p_links, {PARENT.format(x='title_words')} AS p_title FROM own)
SELECT page_id, round(CASE WHEN coalesce(p_n, 0) = 0 THEN 0 ELSE {q.squashed('n / p_n')} END, 9) AS rel_text,
  round(CASE WHEN coalesce(p_links, 0) = 0 THEN 0 ELSE {q.squashed('links / p_links')} END, 9) AS rel_links, round({q.squashed('run / 1000.0')}, 9) AS longest,
  array_to_string(top_words, ' ') AS top_words, array_to_string(title_words, ' ') AS title_words, '' AS parent_link_words, array_to_string(coalesce(p_title, []), ' ') AS parent_title_words
FROM rel"""
# The same, as a replay of the pages that have a label.
JUDGED = (
    "WITH RECURSIVE "
    + FEATURES[FEATURES.index("p AS") : FEATURES.index("SELECT page_id, round(CASE")].rstrip()
    + f""",
tc AS (SELECT page_id AS id, CASE WHEN quality = 1 THEN 1 ELSE -1 END AS tc FROM pages JOIN labels ON doc_id = page_id),
raw AS (
  SELECT page_id AS id, '0' AS key, CASE WHEN coalesce(p_n, 0) = 0 THEN 0 ELSE {q.squashed('n / p_n')} END AS value FROM rel
  UNION ALL SELECT page_id, '1', CASE WHEN coalesce(p_links, 0) = 0 THEN 0 ELSE {q.squashed('links / p_links')} END FROM rel
  UNION ALL SELECT page_id, '2', {q.squashed('run / 1000.0')} FROM rel
  UNION ALL SELECT page_id, '3:' || unnest(top_words), 1.0 FROM rel UNION ALL SELECT page_id, '4:' || unnest(title_words), 1.0 FROM rel
  UNION ALL SELECT page_id, '6:' || unnest(p_title), 1.0 FROM rel),
x AS (SELECT id, key, value / sqrt(sum(value * value) OVER (PARTITION BY id)) AS value FROM raw),
{q.replay('x', 'tc')}"""
)


def features(spark, sf_dir) -> DataFrame:
    """Features of pages whose parent is the page before them on their host, with no link tokens (the sample has no parents)."""
    own = pages(spark, sf_dir).select("page_id", "url", u.host("url").alias("host"), *ft.page_measures(F.col("html")))
    own = own.withColumn("text_length", F.col("text.text_length")).withColumn("link_tokens", F.array().cast("array<string>"))
    own = ft.with_parents(own, "page_id", "text_length", "links", "title_tokens", "link_tokens")
    return ft.relative_features(own.drop("text_length", "link_tokens", "host"))


@query(FEATURES)
def t16_features(spark, sf_dir):
    return features(spark, sf_dir).select("page_id", *(F.round(x, 9).alias(x) for x in ft.NUMBERS), *(F.array_join(x, " ").alias(x) for x in ft.TOKENS))


@query(f"SELECT page_id, {q.node('url', NODES)} AS by_url, {q.node(q.host('url'), NODES)} AS by_host FROM pages")
def t17_node(spark, sf_dir):
    return tb.read(spark, sf_dir, "pages").select("page_id", u.node_of("url", NODES).alias("by_url"), u.node_of(u.host("url"), NODES).alias("by_host"))


@query(f"SELECT page_id, round({DELAY}, 6) AS delay FROM pages")
def t18_delay(spark, sf_dir):
    return tasks(spark, sf_dir).select("page_id", F.round("delay", 6).alias("delay"))


@query(f"WITH {WEIGHTED}, s AS (SELECT id, sum(value * weight) AS score FROM x JOIN w USING (key) GROUP BY id) SELECT id, printf('%.2f', 100 * round(score, 9)) AS shown FROM s")
def t19_shown_score(spark, sf_dir):
    """Words that cancel out leave ±1e-17 or so, and that sign is shown."""
    scored = weighted_terms(spark, sf_dir).groupBy("id").agg(ft.exact_sum(F.col("term")).alias("score"))
    return scored.select("id", ft.shown("score").alias("shown"))


@query("SELECT event_id, epoch(TIMESTAMP '2024-06-01 00:00:00') - floor(epoch(ts))::BIGINT AS age, epoch(TIMESTAMP '2024-06-01 00:00:00') - floor(epoch(ts))::BIGINT > 21600 AS stale FROM events")
def t20_age(spark, sf_dir):
    age = F.unix_timestamp(F.to_timestamp(F.lit("2024-06-01 00:00:00"))) - F.unix_timestamp("ts")
    return tb.read(spark, sf_dir, "events").select("event_id", age.cast("double").alias("age"), (age > fr.ADDRESS_AGE).alias("stale"))


# --- iteration, heartbeats, learning ------------------------------------------------

def graph(spark, sf_dir) -> DataFrame:
    """Edges with a cycle, orders -> customers -> nations <-> regions, in place of links (the sample's pages link to no other)."""
    rows = [("orders", "o", "o_orderkey", "c", "o_custkey"), ("customer", "c", "c_custkey", "n", "c_nationkey"), ("nation", "n", "n_nationkey", "r", "n_regionkey"), ("nation", "r", "n_regionkey", "n", "n_nationkey")]
    edges = [tb.read(spark, sf_dir, t).select(F.concat(F.lit(p), src).alias("src"), F.concat(F.lit(q), dst).alias("dst")) for t, p, src, q, dst in rows]
    return reduce(DataFrame.unionByName, edges)


@query("""
WITH c AS (SELECT DISTINCT o_custkey AS k FROM orders), n AS (SELECT DISTINCT c_nationkey AS k FROM customer JOIN c ON c_custkey = k),
r AS (SELECT DISTINCT n_regionkey AS k FROM nation JOIN n ON n_nationkey = k),
m AS (SELECT n_nationkey AS k FROM nation JOIN r ON n_regionkey = k WHERE n_nationkey NOT IN (SELECT k FROM n)),
all_nodes AS (SELECT DISTINCT 'o' || o_orderkey AS node, 0 AS hop FROM orders UNION ALL SELECT 'c' || k, 1 FROM c UNION ALL SELECT 'n' || k, 2 FROM n UNION ALL SELECT 'r' || k, 3 FROM r UNION ALL SELECT 'n' || k, 4 FROM m)
SELECT node, hop::BIGINT AS hop FROM all_nodes""")
def r1_expand(spark, sf_dir):
    """From all orders over all edges; the SQL names the layers, the tests also walk the graph."""
    edges = graph(spark, sf_dir)
    return fr.expand(edges, tb.read(spark, sf_dir, "orders").select(F.concat(F.lit("o"), "o_orderkey").alias("node")))


def linked_pages(spark, sf_dir) -> DataFrame:
    """page_id, url, html: pages, each with links to two others more, an invention of ours (the sample's link to no other): the k-th by id to the 2k-th and the next."""
    rows = tb.read(spark, sf_dir, "pages")
    placed = fr.queue_order(rows.select("page_id", "url"), "page_id").withColumnRenamed("rank", "k")
    child = placed.select(F.floor(F.col("k") / 2).alias("k"), F.struct(F.col("k").alias("n"), F.concat(F.lit('<a href="'), "url", F.lit('">next</a>')).alias("a")).alias("child"))
    child = child.groupBy("k").agg(F.array_sort(F.collect_list("child")).alias("c"))
    more = placed.join(child, "k", "left").select("page_id", F.coalesce(F.array_join(F.transform("c", lambda x: x["a"]), " "), F.lit("")).alias("more"))
    return tb.dealt(rows).join(more, "page_id").select("page_id", "url", tx.ascii_clean(F.concat("html", F.lit(" "), "more")).alias("html"))


WALKED = (
    """WITH RECURSIVE ranked AS (SELECT page_id, url, html, row_number() OVER (ORDER BY page_id) AS k FROM pages),
web AS (
  SELECT w.page_id, w.url, w.html || ' ' || coalesce(string_agg('<a href="' || c.url || '">next</a>', ' ' ORDER BY c.k), '') AS html
  FROM ranked w LEFT JOIN ranked c ON c.k // 2 = w.k GROUP BY w.page_id, w.url, w.html),
"""
    + q.LINKS.replace("FROM pages)", "FROM web)")
    + f""",
taken AS MATERIALIZED (
  SELECT DISTINCT page_id, {q.normal('url')} AS url FROM links WHERE NOT regexp_matches({q.normal('url')}, '{u.BLOCKED}') AND {q.safe(q.normal('url'))}),
keyed AS MATERIALIZED (SELECT min(page_id) AS page_id, {q.normal("regexp_replace(url, '#.*$', '')")} AS key FROM pages GROUP BY 2),
walk AS (
  SELECT {q.normal('url')} AS url, 0 AS hop FROM ranked WHERE k = 1
  UNION
  SELECT f.url, hop + 1 FROM walk w JOIN keyed ON key = {q.normal("regexp_replace(w.url, '#.*$', '')")} JOIN taken f ON f.page_id = keyed.page_id WHERE NOT regexp_matches({q.path('w.url')}, '{u.DOCUMENT_PATH}')),
first AS (SELECT url, min(hop) AS hop FROM walk GROUP BY 1)
SELECT first.url, hop, page_id FROM first LEFT JOIN keyed ON key = {q.normal("regexp_replace(first.url, '#.*$', '')")}"""
)


@query(WALKED)
def r1_crawl(spark, sf_dir):
    """The whole loop from the first page over all that it leads to, with no limit of distance."""
    web = linked_pages(spark, sf_dir)
    found = fr.crawl(web, tb.read(spark, sf_dir, "pages").orderBy("page_id").limit(1).select("url"), most=-1)
    return found.select("url", "hop", "page_id")


@query(f"""
WITH h AS (SELECT {q.host('url')} AS host, row_number() OVER (ORDER BY min(page_id), {q.host('url')}) AS n FROM pages GROUP BY 1)
SELECT page_id, n <= 6 AS at_once FROM pages JOIN h ON h.host = {q.host('url')}""")
def r3_first_queues(spark, sf_dir):
    """Which tasks are in the queues that open at once; the rest waits for a slot."""
    rows = fr.host_turns(tasks(spark, sf_dir))
    return rows.select("page_id", (F.col("opens") == 0).alias("at_once"))


@query(f"""
WITH RECURSIVE h AS MATERIALIZED (
  SELECT {q.host('url')} AS host, row_number() OVER (ORDER BY min(page_id), {q.host('url')}) AS n, sum({DELAY}) AS busy FROM pages GROUP BY 1),
fold AS (
  SELECT 0::BIGINT AS n, [0, 0, 0, 0, 0, 0]::DOUBLE[] AS free, NULL::VARCHAR AS host, 0::BIGINT AS slot, 0.0::DOUBLE AS opens
  UNION ALL
  SELECT h.n, list_transform(f.free, lambda v, i: CASE WHEN i = list_position(f.free, list_min(f.free)) THEN v + busy ELSE v END), h.host, list_position(f.free, list_min(f.free))::BIGINT, list_min(f.free)
  FROM fold f JOIN h ON h.n = f.n + 1)
SELECT page_id, s.host, slot, round(opens, 6) AS opens, round(opens + start, 6) AS start FROM ({STARTS}) s JOIN fold ON fold.host = s.host""")
def r3_host_turns(spark, sf_dir):
    """Every task's host queue: its slot, when it opens, and when the task starts."""
    return fr.host_turns(tasks(spark, sf_dir)).select("page_id", "host", "slot", F.round("opens", 6).alias("opens"), F.round("start", 6).alias("start"))


@query(f"""
WITH {q.LINKS}, c AS (
  SELECT {q.normal('url')} AS url, page_id * 100000 + pos AS seq, parent_url FROM links WHERE NOT regexp_matches({q.normal('url')}, '{u.BLOCKED}')),
f AS (SELECT url, min(seq)::BIGINT AS seq, arg_min(parent_url, seq) AS parent_url FROM c WHERE url NOT IN (SELECT {q.normal('url')} FROM pages) GROUP BY url)
SELECT url, seq, CASE WHEN {q.host('url')} = {q.host('parent_url')} THEN 0 ELSE 1 END AS distance, {q.safe('url')} AND {q.host('url')} = {q.host('parent_url')} AS admitted FROM f""")
def r1_admission_hop(spark, sf_dir):
    rows = u.page_links(pages(spark, sf_dir)).select("url", (F.col("page_id") * 100000 + F.col("pos")).alias("seq"), "parent_url", F.lit(0).alias("distance"))
    return fr.admitted(rows, tb.read(spark, sf_dir, "pages").select(u.normal_url("url").alias("url"))).select("url", "seq", "distance", "admitted")


@query("SELECT user_id AS id, max(event_id) AS last, arg_max(event_type, event_id) AS state, count(*) AS beats FROM events GROUP BY 1")
def r5_heartbeats(spark, sf_dir):
    return mo.latest(tb.read(spark, sf_dir, "events").select(F.col("user_id").alias("id"), "event_id", "event_type"))


@query(f"""
WITH b AS (
  SELECT user_id % {NODES} AS id, count(*) FILTER (event_type = 'click') AS clicks, count(*) FILTER (event_type = 'error') AS errors FROM events GROUP BY 1)
SELECT count(*) AS init, 0::BIGINT AS active_count, sum(clicks)::BIGINT AS rcount, sum(clicks)::BIGINT AS scount, sum(errors)::BIGINT AS failure, 0::BIGINT AS stop_order,
       coalesce(sum(errors) FILTER (id = 0), 0)::BIGINT AS own_failure, CASE WHEN count(*) = {NODES} THEN 0 WHEN coalesce(sum(errors) FILTER (id = 0), 0) > 0 THEN 1 WHEN sum(errors) > 0 THEN 2 END AS verdict FROM b""")
def r5_completion(spark, sf_dir):
    """Heartbeats of all workers as a stream, watched until their verdict; events are counted as beats() does."""
    path = tb.new_path(spark, "beats-in")
    beats(spark, sf_dir).select(F.col("id").cast("long").alias("id"), F.col("id").cast("long").alias("seq"), *(F.col(x).cast("long").alias(x) for x in mo.COUNTERS)).coalesce(1).write.parquet(path)
    return st.watched(spark.readStream.schema(spark.read.parquet(path).schema).parquet(path), NODES, 0)


@query(f"WITH {q.LINKS} SELECT DISTINCT {q.node('url', NODES)} AS node, url, parent_url FROM links")
def r6_exchange(spark, sf_dir):
    """All links as messages to their nodes, half of them sent twice for want of an answer, and each received once."""
    path = tb.new_path(spark, "messages")
    rows = tb.stored(f12_message(spark, sf_dir))
    st.send(rows, path)
    st.send(rows.where("crc32(url) % 2 = 0"), path)
    return st.drained(st.received(spark, path), "received")


@query("SELECT least(count(*), 120)::BIGINT AS written, greatest(count(*) - 120, 0)::BIGINT AS drained, count(*) < 120 AS active FROM pages")
def k4_counted_writer(spark, sf_dir):
    """A stream of pages into a table that takes 120; the rest is drained."""
    path = tb.new_path(spark, "payload")
    return st.capped_writer(st.source(spark, sf_dir, "pages").select("page_id", "url"), path + "/table", 120, path + "/state")


# Recursive: a seed at a time from the end until six hosts are there; then the others from the front.
@query(f"""
WITH RECURSIVE s AS MATERIALIZED (SELECT {q.host('url')} AS host, page_id AS seq, row_number() OVER (ORDER BY page_id DESC) AS n FROM pages WHERE NOT regexp_matches(url, '{u.BLOCKED}') AND {q.safe('url')}),
pops AS (
  SELECT 0::BIGINT AS n, []::VARCHAR[] AS hosts
  UNION ALL
  SELECT s.n, CASE WHEN list_contains(hosts, s.host) THEN hosts ELSE list_append(hosts, s.host) END FROM pops p JOIN s ON s.n = p.n + 1 WHERE len(hosts) < 6),
ended AS (SELECT n, hosts FROM pops ORDER BY n DESC LIMIT 1),
came AS (SELECT s.host, seq, CASE WHEN s.n <= e.n THEN -seq ELSE seq + 1 END AS came, nullif(list_position(e.hosts, s.host), 0)::BIGINT AS slot FROM s, ended e),
turns AS (
  SELECT host, seq, slot, CASE WHEN slot IS NULL THEN row_number() OVER (PARTITION BY slot ORDER BY came)
    WHEN came = min(came) OVER (PARTITION BY host) THEN 1 ELSE 1 + row_number() OVER (PARTITION BY host ORDER BY came DESC) END AS turn FROM came)
SELECT * FROM turns UNION ALL SELECT NULL, NULL, k, NULL FROM range(1, 7) r(k), ended WHERE k > len(hosts)""")
def r8_initialise(spark, sf_dir):
    """Which queue each seed comes into, and when it is pulled there; the pages' URLs are the seeds."""
    seeds = tb.read(spark, sf_dir, "pages").where(~u.is_blocked("url") & u.is_safe("url")).select(u.host("url").alias("host"), F.col("page_id").alias("seq"))
    return fr.initialised(seeds)


VECTORS = f"""
n AS (SELECT doc_id AS id, length(text) / 1000.0 AS num, list_distinct(regexp_extract_all(lower(text), '[a-z]+')) AS toks FROM documents),
raw AS (SELECT id, '0' AS key, num AS value FROM n UNION ALL SELECT id, '1:' || unnest(toks), 1.0 FROM n),
x AS (SELECT id, key, value / sqrt(sum(value * value) OVER (PARTITION BY id)) AS value FROM raw)"""


def vectors(spark, sf_dir) -> DataFrame:
    """id, x: a number and the words of each text, as unit vectors."""
    rows = tb.dealt(tb.read(spark, sf_dir, "documents").select("doc_id", "text"))
    return rows.select(F.col("doc_id").alias("id"), ft.sparse_vector([F.length("text") / 1000.0], [tx.word_tokens("text")]).alias("x"))


@query(f"WITH {VECTORS} SELECT id, key, round(value, 9) AS value FROM x")
def m1_encode(spark, sf_dir):
    return vectors(spark, sf_dir).select("id", F.explode("x").alias("key", "value")).withColumn("value", F.round("value", 9))


@query(f"WITH {VECTORS} SELECT id, round(sum(value * (({q.draw('key')} % 1000) / 500.0 - 1)), 9) AS score FROM x GROUP BY id")
def m3_classify(spark, sf_dir):
    rows = tb.stored(vectors(spark, sf_dir), "vectors")
    keys = rows.select(F.explode(F.map_keys("x")).alias("key")).distinct()
    weights = keys.withColumn("weight", (F.floor(fr.fixed_draw(F.col("key")) * float(1 << 32)).cast("long") % 1000) / 500.0 - 1)
    return ln.scores(rows, weights).withColumn("score", F.round("score", 9))


GOLDEN = [(0, {"0": 0.5, "3:lease": 1.0}, 1), (1, {"0": -0.5, "3:news": 1.0}, -1), (2, {"0": 0.5, "3:lease": 1.0}, 1), (3, {"0": 0.1, "3:lease": 1.0, "3:news": 1.0}, -1)]


def golden(spark) -> DataFrame:
    rows = spark.createDataFrame(GOLDEN, "id int, x map<string,double>, tc int")
    size = F.sqrt(F.aggregate(F.map_values("x"), F.lit(0.0), lambda acc, v: acc + v * v))
    return rows.withColumn("x", F.transform_values("x", lambda _, v: v / size))


@query("SELECT * FROM (VALUES (0, 0.0::DOUBLE, 1, 1.0::DOUBLE, true), (1, -0.2, -1, 0.8, true), (2, 1.16, 1, 0.0, false), (3, 0.182955, -1, 1.182955, true)) t(id, score, tc, loss, updated)")
def m4_golden_trace(spark, sf_dir):
    return ln.replay(golden(spark)).withColumn("score", F.round("score", 6)).withColumn("loss", F.round("loss", 6))


def labelled(spark, sf_dir) -> DataFrame:
    """id, x, tc of the labelled documents; only their texts are made vectors."""
    tc = s8_feedback(spark, sf_dir).withColumnRenamed("doc_id", "id")
    rows = tb.dealt(tb.read(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text").join(tc, "id"))
    return rows.select("id", ft.sparse_vector([F.length("text") / 1000.0], [tx.word_tokens("text")]).alias("x"), "tc")


# The replay is sequential; its SQL goes by dot products, and the tests also fold plainly.
LEARNED = f"WITH RECURSIVE {VECTORS}, tc AS (SELECT doc_id AS id, CASE WHEN quality = 1 THEN 1 ELSE -1 END AS tc FROM labels JOIN documents USING (doc_id)), {q.replay('x', 'tc')}"


@query(f"{LEARNED} SELECT id, round(score, 9) AS score, tc, round(loss, 9) AS loss, updated FROM steps")
def m5_replay(spark, sf_dir):
    """Every labelled document in id order."""
    return ln.replay(labelled(spark, sf_dir)).withColumns({"score": F.round("score", 9), "loss": F.round("loss", 9)})


@query(f"{LEARNED} SELECT id, NOT updated AS skipped FROM steps")
def m6_skipped(spark, sf_dir):
    return ln.replay(labelled(spark, sf_dir)).select("id", (~F.col("updated")).alias("skipped"))


@query(f"{LEARNED} SELECT key, round(weight, 9) AS weight FROM weights WHERE round(weight, 9) > 0")
def m7_readable_weights(spark, sf_dir):
    return ln.final_weights(labelled(spark, sf_dir)).withColumn("weight", F.round("weight", 9)).where("weight > 0")


@query(f"{LEARNED} SELECT id, round(score, 9) AS score FROM steps WHERE abs(score) > 0.5")
def f8_confidence_gate(spark, sf_dir):
    """Rows that are scored beyond the gate, from which nothing is learned."""
    return ln.replay(labelled(spark, sf_dir)).where(F.abs("score") > ln.GATE).select("id", F.round("score", 9).alias("score"))


# Weights of rows that were all skipped stand in no map.
@query(f"{LEARNED} SELECT key, round(sum(step * value), 9) AS weight FROM entries JOIN steps USING (t) WHERE updated GROUP BY 1")
def k6_weight_rows(spark, sf_dir):
    path = tb.new_path(spark, "weights") + "/weights.csv"
    tb.write_csv(ln.final_weights(labelled(spark, sf_dir)), path)
    return spark.read.schema("key string, weight double").csv(path, header=True).withColumn("weight", F.round("weight", 9))


def judged_pages(spark, sf_dir) -> DataFrame:
    """id, url, tc, x, slots: pages that have a label (a document's of the same number serves), with their features as a unit vector."""
    tc = s8_feedback(spark, sf_dir).withColumnRenamed("doc_id", "page_id")
    rows = features(spark, sf_dir).join(tc, "page_id")
    keys = [F.array(F.lit(str(k))) for k in range(len(ft.NUMBERS))]
    named = lambda slot, words: F.transform(words, lambda w: F.concat(F.lit(f"{slot}:"), w))
    keys += [named(k, F.col(x)) for k, x in enumerate(ft.TOKENS, len(ft.NUMBERS))]
    return rows.select(F.col("page_id").alias("id"), "url", "tc", ft.sparse_vector([F.col(x) for x in ft.NUMBERS], [F.col(x) for x in ft.TOKENS]).alias("x"), F.array(*keys).alias("slots"))


@query(f"""{JUDGED} SELECT s.id AS db_id, round(score, 9) AS score, tc, round(loss, 9) AS loss, (SELECT count(DISTINCT key) FROM entries)::INT AS n_weights,
  round(sum(step * total) OVER (ORDER BY s.t), 9) AS weight_sum FROM steps s JOIN (SELECT t, sum(value) AS total FROM entries GROUP BY 1) e ON e.t = s.t""")
def k6_batch_csv(spark, sf_dir):
    """The replay of all judged pages as a wide CSV: id, url, score, tc, loss and each weight after the row. The text is rows times keys, so it is compressed. Read back, with the number and the sum of its weights."""
    rows = tb.stored(judged_pages(spark, sf_dir), "judged")
    path = tb.new_path(spark, "batch") + "/batch.csv"
    index = tb.stored(ln.slot_index(rows), "index")
    tb.write_wide_csv(ln.trajectory_lines(rows, index), ["db_id", "url", "score", "tc", "LOSS", *(r["key"] for r in index.orderBy("col").toLocalIterator())], path, packed=True)
    read = tb.wide_sums(spark.read.text(path).where(~F.col("value").startswith("db_id,")), 5)
    cell = lambda k, kind: F.col("named")[k].cast(kind)
    return read.select(cell(0, "long").alias("db_id"), F.round(cell(2, "double"), 9).alias("score"), cell(3, "int").alias("tc"), F.round(cell(4, "double"), 9).alias("loss"), F.col("n").alias("n_weights"), F.round("total", 9).alias("weight_sum"))


@query(f"{JUDGED} SELECT id, e.key, round(value, 9) AS x, round(coalesce(weight, 0), 9) AS weight FROM entries e JOIN turns USING (t) LEFT JOIN weights w ON w.key = e.key")
def m7_explained(spark, sf_dir):
    """Each entry of each judged page's vector beside its final weight, line by line."""
    rows = tb.stored(judged_pages(spark, sf_dir), "judged")
    return ln.explained(rows, ln.final_weights(rows)).withColumns({"x": F.round("x", 9), "weight": F.round("weight", 9)})


@query(f"""{JUDGED} SELECT s.id, p.url, n_features::INT AS n_features, md5(regexp_replace(regexp_replace(p.html, '^.*?<body[^>]*>', '', 's'), '</body>.*$', '', 's')) AS body,
  printf('%.2f', 100 * round(score, 9)) AS shown, tc, round(loss, 9) AS loss, CASE WHEN tc = 1 THEN 'positive' ELSE 'negative' END AS route
FROM steps s JOIN pages p ON p.page_id = s.id JOIN (SELECT t, count(*) AS n_features FROM entries GROUP BY 1) e ON e.t = s.t""")
def m8_analysis(spark, sf_dir):
    """What the judge of each page sees, and what follows: the next page by id, how many features it has (k9_analysis lists them),
    its score with the weights so far, its body; then the label is learned and the page routed."""
    rows = tb.stored(judged_pages(spark, sf_dir), "judged")
    steps = ln.replay(rows)
    body = tb.read(spark, sf_dir, "pages").select(F.col("page_id").alias("id"), F.md5(tx.body("html").cast("binary")).alias("body"))
    shown = rows.select("id", "url", F.size("x").alias("n_features")).join(steps, "id").join(body, "id")
    return shown.select("id", "url", "n_features", "body", ft.shown("score").alias("shown"), "tc", F.round("loss", 9).alias("loss"), F.when(F.col("tc") == 1, "positive").otherwise("negative").alias("route"))


@query(f"""{JUDGED}, moved AS (
  SELECT id, e.key, value, coalesce(sum(CASE WHEN updated THEN step * value ELSE 0 END) OVER (PARTITION BY e.key ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS weight FROM entries e JOIN steps USING (t))
SELECT id, key, round(value, 9) AS x, round(weight, 9) AS w, printf('%.2f', 100 * round(score, 9)) AS shown FROM moved JOIN (SELECT id, score FROM steps) USING (id)""")
def k9_analysis(spark, sf_dir):
    """What the result page of each judged page shows, line by line: each of its features with its value and the weight that it had then, and the page's score."""
    done = ln.Replay(judged_pages(spark, sf_dir))
    shown = done.scored().select("id", ft.shown("score").alias("shown"))
    return done.explained().join(shown, "id").select("id", "key", F.round("x", 9).alias("x"), F.round("weight", 9).alias("w"), "shown")


@query(f"""WITH {q.PAGES}, {STATS}, {q.ranked('titles', 'stats', 'page_id', 'title')}, own AS (
  SELECT s.page_id, {q.host('s.url')} AS host, text_length, links, coalesce(words, []) AS words FROM stats s LEFT JOIN titles USING (page_id)),
before AS (
  SELECT page_id, lag(page_id) OVER w AS parent, lag(text_length) OVER w AS text_length, lag(links) OVER w AS links, lag(words) OVER w AS words FROM own WINDOW w AS (PARTITION BY host ORDER BY page_id))
SELECT b.page_id AS id, CASE WHEN parent IS NOT NULL THEN printf('%.1f;%.1f;', text_length, links) || array_to_string(words, ',') || ';;' END AS parent_line FROM before b JOIN labels l ON l.doc_id = b.page_id""")
def k9_parent_stats(spark, sf_dir):
    """The line of parent statistics that the result page of each judged page shows; null for a host's first page. The parent is the page before it on its host, as everywhere here."""
    own = pages(spark, sf_dir).select("page_id", u.host("url").alias("host"), *ft.passed_stats(F.col("html")), F.array().cast("array<string>").alias("link_tokens"))
    rows = ft.with_parents(own, "page_id", "text_length", "links", "title_tokens", "link_tokens").join(s8_feedback(spark, sf_dir).select(F.col("doc_id").alias("page_id")), "page_id")
    return rows.select(F.col("page_id").alias("id"), ft.stats_to_text(F.col("parent")).alias("parent_line"))


@query("SELECT p.page_id, p.url, p.html, CASE WHEN l.quality = 1 THEN 'positive' ELSE 'negative' END AS route FROM pages p JOIN labels l ON l.doc_id = p.page_id")
def m8_routes(spark, sf_dir):
    """Where the analysis step sends each judged page."""
    return tb.read(spark, sf_dir, "pages").join(m8_analysis(spark, sf_dir).select(F.col("id").alias("page_id"), "route"), "page_id").select("page_id", "url", "html", "route")


@query(f"WITH {q.LINKS}, {STATS}, {q.ranked('titles', 'stats', 'page_id', 'title')} SELECT l.page_id, l.pos::INT AS pos, array_to_string(list_concat(coalesce(t.words, []), l.link_tokens), ' ') AS carried FROM links l LEFT JOIN titles t ON t.page_id = l.page_id")
def u4_carried_tokens(spark, sf_dir):
    rows = pages(spark, sf_dir)
    titles = rows.select("page_id", tx.ranked_words(tx.title("html")).alias("title_tokens"))
    return u.page_links(rows).join(titles, "page_id").select("page_id", "pos", F.array_join(F.concat("title_tokens", "link_tokens"), " ").alias("carried"))


# --- streams ---------------------------------------------------------------------------


@query(f"SELECT page_id AS seq, host, round(start, 6) AS start FROM ({STARTS})")
def r2_stream_pull_times(spark, sf_dir):
    delay = fr.delay(F.col("page_id") % 5 != 0, (F.col("page_id") % 7) / 10.0, fr.fixed_draw(F.col("page_id")))
    rows = st.source(spark, sf_dir, "pages").select(u.host("url").alias("host"), F.col("page_id").alias("seq"), delay.alias("delay"))
    return st.drained(st.pull_times(rows), "pull-times").select("seq", "host", F.round("start", 6).alias("start"))


@query(f"""
WITH d AS (SELECT page_id, {q.host('url')} AS host, {DELAY} AS delay FROM pages)
SELECT page_id AS seq, host, row_number() OVER newest AS turn, round(coalesce(sum(delay) OVER (newest ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0), 6) AS start FROM d WINDOW newest AS (PARTITION BY host ORDER BY page_id DESC)""")
def r3_stream_queues(spark, sf_dir):
    """All pages come into their hosts' queues at once; each is pulled newest first when the delay of the pull before is over (start, in seconds)."""
    path, day = tb.new_path(spark, "queues"), 86_400_000
    rows = tasks(spark, sf_dir).where("host is not null").select("host", "seq", "delay", F.lit(day).cast("long").alias("at_ms"))
    # First all tasks; then a task of another host lets time go by, in a run that goes on with the state of the first.
    tick = spark.createDataFrame([("", -1, 0.0, 400 * day)], "host string, seq long, delay double, at_ms long")
    for come in (rows, tick):
        tb.append(come, f"{path}/in")
        stream = st.host_queues(spark.readStream.schema(rows.schema).parquet(f"{path}/in"))
        found = st.drained(stream, "pulls", f"{path}/out", f"{path}/state")
    return found.where("seq >= 0").select("seq", "host", "turn", F.round((F.col("pulled_ms") - day) / 1000, 6).alias("start"))


@query("SELECT url FROM pages WHERE page_id % 2 = 0 UNION ALL SELECT url FROM pages WHERE page_id % 3 = 0")
def r7_failure_dump(spark, sf_dir):
    """A run that fails at its first batch, over all pages: the URLs that its queues held, as the next start reads them."""
    path, rows = tb.new_path(spark, "failed"), tb.read(spark, sf_dir, "pages").select("page_id", "url")

    def fail(batch: DataFrame, number: int) -> None:
        raise RuntimeError(f"batch {number} of {batch.count()} rows was lost")

    stream = st.source(spark, sf_dir, "pages").select("url")
    well = st.recorded(lambda: stream.writeStream.foreachBatch(fail).option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start(), path, rows.where("page_id % 2 = 0"), rows.where("page_id % 3 = 0"))
    failures, urls = st.restarted(spark, path)
    if well or failures.where("failure = 1 and contains(error, 'was lost')").isEmpty():
        raise RuntimeError("the failure is not on record")
    return urls


@query(f"SELECT DISTINCT {q.normal('url')} AS url FROM pages")
def r4_stream_unseen(spark, sf_dir):
    return st.drained(st.unseen(st.source(spark, sf_dir, "pages").select(u.normal_url("url").alias("url"))), "unseen")


@query(f"SELECT DISTINCT {q.normal('url')} AS url FROM pages")
def r4_kept_unseen(spark, sf_dir):
    """The same in two runs, each over pages that came since the one before and some that it had; what was seen is a table and its filter."""
    rows, path = tb.read(spark, sf_dir, "pages").select("page_id", u.normal_url("url").alias("url")), tb.new_path(spark, "unseen")
    found = None
    for part in (F.col("page_id") % 3 < 2, F.col("page_id") % 3 > 0):
        tb.append(rows.where(part).select("url"), f"{path}/in")
        found = st.unseen_kept(spark.readStream.schema("url string").parquet(f"{path}/in"), f"{path}/seen")
    return found
