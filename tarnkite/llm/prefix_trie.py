"""The trie of conversations' common beginnings, summed up by heavy paths.

A turn counts by 128 bits of a hash of its role, text and depth; the sums of a
conversation's first d turns name its depth-d node, so each node is found by
running sums and no conversation need be in one task. Of a node's children the
largest, by members, is heavy, and chains of heavy children are paths: an array
of nodes each. A light child has at most half of its parent's members, so from
the root to any node there are at most log2(members) light edges. Subtree sums
go from the paths that are the most light edges away up to the root's: sums from
each place of a path's array to its end, and the sum of the whole path is
attached to the parent of its top, which is on a path one light edge less away.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import _common as c

#: Turns, or nodes of a path, that one task sums up at once; member ids that are joined to one text at once.
PART, CHUNK = 4096, 65_536
#: What a conversation takes of its group's first one: fewer turns than this.
DRAWS, GROUP = 6, 100
LANES = ("l0", "l1", "l2", "l3")


def lanes(depth: Column) -> list[Column]:
    """Four numbers of 32 bits from a turn's digest and its depth."""
    both = [F.xxhash64("digest", depth), F.xxhash64(depth, "digest", F.lit(1))]
    return [(F.shiftrightunsigned(x, s).bitwiseAND(F.lit((1 << 32) - 1))).alias(LANES[2 * k + s // 32]) for k, x in enumerate(both) for s in (0, 32)]


def node(depth: Column, *sums: Column) -> Column:
    return F.unhex(F.md5(F.concat_ws(",", depth.cast("string"), *(x.cast("string") for x in sums)).cast("binary")))


def numbered(turns: DataFrame) -> DataFrame:
    """conv, pos (from 1 in each conversation), digest, size of each turn; sorted in ranges, so that a long conversation is in many tasks."""
    role, text = (F.coalesce(x, F.lit("")) for x in ("role", "text"))
    rows = turns.where("conv_id is not null").select(F.col("conv_id").cast("long").alias("conv"), "turn", role.alias("role"), text.alias("text"))
    digest = F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), F.col("role"), F.col("text")).cast("binary"), 256)
    # A row's number is that of its range, shifted by 33 bits, plus its place there.
    rows = rows.orderBy("conv", "turn", "role", "text").select("conv", digest.alias("digest"), F.length("text").cast("long").alias("size"), F.monotonically_increasing_id().alias("at"))
    rows = c.staged(rows, "turns").withColumn("part", F.shiftright("at", 33))
    parts = rows.groupBy("conv", "part").agg(F.min("at").alias("low"), F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(W.partitionBy("conv").orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    parts = parts.select("conv", "part", (before - F.col("low") + 1).alias("shift"))
    return rows.join(parts, ["conv", "part"]).select("conv", (F.col("at") + F.col("shift")).alias("pos"), "digest", "size")


def rebuilt(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """conv, depth, digest, size, total of each turn of the rebuilt conversations; and conv, total of each of these.

    Of its group's first conversation each takes fewer than DRAWS turns; then its own turns follow after as many.
    """
    rows = c.staged(numbered(turns), "turns")
    convs = rows.groupBy("conv").agg(F.max("pos").alias("n"))
    taken = F.pmod(F.crc32(F.col("conv").cast("string").cast("binary")), F.lit(DRAWS))
    convs = convs.select("conv", "n", taken.alias("taken"), (F.col("conv") - F.col("conv") % GROUP).alias("base"))
    firsts = convs.where("conv = base").select("base", F.col("n").alias("there"))
    given = F.least("taken", F.coalesce("there", F.lit(0)))
    convs = convs.join(firsts, "base", "left").select("conv", "base", "taken", given.alias("given"), (given + F.greatest(F.col("n") - F.col("taken"), F.lit(0))).alias("total"))
    convs = c.staged(convs, "conversations")
    heads = rows.where((F.col("pos") < DRAWS) & (F.col("conv") % GROUP == 0)).withColumnRenamed("conv", "base")
    taken = convs.join(heads, "base").where("pos <= taken").select("conv", F.col("pos").alias("depth"), "digest", "size", "total")
    own = c.join_one(rows, convs.select("conv", "taken", "given", "total"), ["conv"], F.col("pos")).where("pos > taken")
    own = own.select("conv", (F.col("pos") - F.col("taken") + F.col("given")).alias("depth"), "digest", "size", "total")
    return taken.unionByName(own), convs.select("conv", "total")


def running(rows: DataFrame, key: str, order: str, values: dict[str, Column], descending: bool = False) -> DataFrame:
    """rows with the sums of values over their key's rows up to each, in the order of a number: inside ranges of PART, and over these."""
    by = F.desc if descending else F.asc
    rows = rows.select("*", F.floor(F.col(order) / PART).alias("_part"), *(v.alias(f"_{k}") for k, v in values.items()))
    sums = rows.groupBy(key, "_part").agg(*(F.sum(f"_{k}").alias(f"_far_{k}") for k in values))
    over = W.partitionBy(key).orderBy(by("_part")).rowsBetween(W.unboundedPreceding, -1)
    sums = sums.select(key, "_part", *(F.coalesce(F.sum(f"_far_{k}").over(over), F.lit(0)).alias(f"_far_{k}") for k in values))
    near = W.partitionBy(key, "_part").orderBy(by(order))
    rows = rows.select("*", *(F.sum(f"_{k}").over(near).alias(f"_near_{k}") for k in values)).join(sums, [key, "_part"])
    return rows.select(*(x for x in rows.columns if x not in (key, "_part") and not x.startswith("_")), key, *((F.col(f"_near_{k}") + F.col(f"_far_{k}")).alias(k) for k in values))


def members(turns: DataFrame) -> DataFrame:
    """conv, depth, node, up, size, last: each rebuilt conversation in each of its nodes, from the root on; up: the parent's node."""
    rows, convs = rebuilt(turns)
    own = rows.select("conv", "depth", "size", "total", *(x.alias(f"own_{x_name}") for x, x_name in zip(lanes(F.col("depth")), LANES, strict=True)))
    summed = running(own, "conv", "depth", {x: F.col(f"own_{x}") for x in LANES})
    here = node(F.col("depth"), *(F.col(x) for x in LANES))
    up = node(F.col("depth") - 1, *(F.col(x) - F.col(f"own_{x}") for x in LANES))
    last = (F.col("depth") == F.col("total")).alias("last")
    zero = F.lit(0).cast("long")
    root = convs.select("conv", zero.alias("depth"), node(zero, *[zero] * 4).alias("node"), F.lit(None).cast("binary").alias("up"), zero.alias("size"), (F.col("total") == 0).alias("last"))
    return summed.select("conv", F.col("depth").cast("long").alias("depth"), here.alias("node"), up.alias("up"), "size", last).unionByName(root)


def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Over (node, part, ids) sorted by node and part: the SHA-256 of each node's ids, read on from chunk to chunk."""
    key, state = None, None
    for batch in batches:
        nodes, found = [], []
        for here, ids in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), strict=True):
            if here != key:
                if key is not None:
                    nodes.append(key)
                    found.append(state.hexdigest())
                key, state = here, hashlib.sha256()
            else:
                state.update(b",")
            state.update(ids.encode())
        yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.binary()), pa.array(found, pa.string())], ["node", "ends_sha256"])
    if key is not None:
        yield pa.RecordBatch.from_arrays([pa.array([key], pa.binary()), pa.array([state.hexdigest()])], ["node", "ends_sha256"])


def ends(rows: DataFrame) -> DataFrame:
    """node, ends_sha256 of each node at which a conversation ends; ids are joined in chunks of CHUNK numbers, and only the chunks of a node pass through one task."""
    ids = rows.where("last").groupBy("node", F.floor(F.col("conv") / CHUNK).alias("part")).agg(F.array_join(F.transform(F.array_sort(F.collect_list("conv")), lambda x: x.cast("string")), ",").alias("ids"))
    return ids.repartition("node").sortWithinPartitions("node", "part").select("node", "part", "ids").mapInArrow(digests, "node binary, ends_sha256 string")


def paths(rows: DataFrame, nodes: DataFrame) -> DataFrame:
    """node, head, light: the top of the heavy path that each node is on, and how many light edges it is away from the root.

    nodes: node, conv_id, heavy. Both are told along each conversation, whose nodes are a way down from the root; of a node's members the least one tells.
    """
    told = c.join_one(rows.select("conv", "depth", "node"), nodes.select("node", "conv_id", "heavy"), ["node"], F.col("conv"))
    told = running(told, "conv", "depth", {"light": F.when(F.col("heavy"), 0).otherwise(1)})
    told = c.staged(told, "ways")
    heads = told.where("not heavy").select("conv", "light", F.col("node").alias("head"))
    # Along a conversation, the nodes with as many light edges are one stretch of a path, and its first is the path's top.
    return told.where("conv = conv_id").join(heads, ["conv", "light"]).select("node", "head", (F.col("light") - 1).alias("light"))


def prefix_trie(turns: DataFrame) -> DataFrame:
    """A row for each node of the trie of the rebuilt conversations: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.

    turns: conv_id, turn, role, text; further columns are ignored. Turns go by
    turn (null first), those of one turn by role and text; null roles and texts
    are empty; rows without a conv_id belong to no conversation and go, and an
    empty table gives no row. Conversation c becomes the first h turns of
    conversation c - c % 100 (all if fewer, none if that is absent) and its own
    turns after its first h, h = crc32(c in decimals) % 6; it may become
    turnless, and then ends at the root. Each distinct sequence of first turns
    (role, text) is a node: conv_id is the least conversation that begins so,
    n_convs how many do; leaves and saved_tokens count over the subtree, the
    node included; ends_sha256 is of the ids that end there, in order.
    """
    rows = c.staged(members(turns), "members")
    nodes = rows.groupBy("node", "up", "depth").agg(F.min("conv").alias("conv_id"), F.count("*").alias("n_convs"), F.max("size").alias("size"))
    nodes = c.staged(nodes, "nodes")
    children = nodes.where("up is not null").groupBy(F.col("up").alias("node")).agg(F.count("*").alias("n_children"), F.max(F.struct("n_convs", "node"))["node"].alias("largest"))
    nodes = c.staged(nodes.join(children, "node", "left"), "nodes")
    parents = nodes.where("largest is not null").select(F.col("node").alias("up"), F.col("conv_id").alias("parent_conv_id"), "largest")
    below = c.join_one(nodes.drop("largest").where("up is not null"), parents, ["up"], F.col("node"))
    root = nodes.where("up is null").withColumn("parent_conv_id", F.lit(None).cast("long"))
    columns = ["node", "up", "depth", "conv_id", "n_convs", F.coalesce("n_children", F.lit(0)).alias("n_children"), "size", "parent_conv_id"]
    nodes = below.select(*columns, (F.col("node") == F.col("largest")).alias("heavy")).unionByName(root.select(*columns, F.lit(False).alias("heavy")))
    nodes = c.staged(nodes, "nodes")
    nodes = c.staged(nodes.join(paths(rows, nodes), "node"), "nodes")
    leaf, saved = F.when(F.col("n_children") == 0, 1).otherwise(0), (F.col("n_convs") - 1) * F.col("size")
    most = nodes.agg(F.max("light")).first()[0]
    done, attached = [], None
    for light in range(most if most is not None else -1, -1, -1):
        level = nodes.where(F.col("light") == light).select("node", "up", "head", "depth", leaf.alias("leaf"), saved.alias("saved"))
        if attached is not None:
            level = level.join(attached, "node", "left").select("node", "up", "head", "depth", *((F.col(x) + F.coalesce(f"more_{x}", F.lit(0))).alias(x) for x in ("leaf", "saved")))
        level = c.staged(running(level, "head", "depth", {"n_leaves": F.col("leaf"), "saved_tokens": F.col("saved")}, descending=True).select("node", "up", "head", "n_leaves", "saved_tokens"), "level")
        attached = level.where("node = head").groupBy(F.col("up").alias("node")).agg(F.sum("n_leaves").alias("more_leaf"), F.sum("saved_tokens").alias("more_saved"))
        done.append(level.select("node", "n_leaves", "saved_tokens"))
    if not done:
        done = [turns.sparkSession.createDataFrame([], "node binary, n_leaves long, saved_tokens long")]
    out = nodes.join(c.union(done), "node").join(ends(rows), "node", "left")
    nothing = F.lit(hashlib.sha256(b"").hexdigest())
    return out.select("conv_id", "depth", "parent_conv_id", "n_convs", F.col("n_children").cast("long").alias("n_children"), "n_leaves", "saved_tokens", F.coalesce("ends_sha256", nothing).alias("ends_sha256"))


def op13_prefix_trie(spark, sf_dir: str) -> DataFrame:
    """prefix_trie() of all conversations; it says what holds for nulls, ties, empty texts and turnless conversations."""
    return prefix_trie(c.table(spark, sf_dir, "conversations"))


OP13_SQL = r"""
WITH t AS (
  SELECT conv_id AS c, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS p, coalesce(role, '') AS role, coalesce(text, '') AS text
  FROM conversations WHERE conv_id IS NOT NULL),
ids AS (SELECT c, count(*) AS n FROM t GROUP BY 1),
v AS (
  SELECT c, n, c - c % 100 AS base, xor(list_reduce(list_concat([4294967295::BIGINT], list_transform(string_split(c::VARCHAR, ''), lambda x: ascii(x)::BIGINT)),
    lambda crc, x: list_reduce([xor(crc, x), 0, 0, 0, 0, 0, 0, 0, 0], lambda y, i: xor(y >> 1, 3988292384::BIGINT * (y & 1)))), 4294967295::BIGINT) % 6 AS h
  FROM ids),
g AS (SELECT v.*, least(v.h, coalesce(b.n, 0)) AS m FROM v LEFT JOIN ids b ON b.c = v.base),
r AS (
  SELECT g.c, t.p AS d, role, text FROM g JOIN t ON t.c = g.base AND t.p <= g.h
  UNION ALL SELECT g.c, t.p - g.h + g.m, role, text FROM g JOIN t ON t.c = g.c AND t.p > g.h),
k AS (
  SELECT c, d, length(text) AS size, md5(array_to_string(list(md5(length(role) || ':' || role || text)) OVER (PARTITION BY c ORDER BY d), ',')) AS k,
         d = count(*) OVER (PARTITION BY c) AS last FROM r
  UNION ALL SELECT c, 0, 0, 'root', c NOT IN (SELECT c FROM r) FROM g),
u AS (SELECT *, lag(k) OVER (PARTITION BY c ORDER BY d) AS up FROM k),
nodes AS (SELECT k, any_value(up) AS up, d, min(c) AS c, count(*) AS n, max(size) AS size, string_agg(c::VARCHAR, ',' ORDER BY c) FILTER (last) AS ends FROM u GROUP BY k, d),
kids AS (SELECT up, count(*) AS n FROM nodes WHERE up IS NOT NULL GROUP BY 1),
own AS (SELECT nodes.*, coalesce(kids.n, 0) AS n_children FROM nodes LEFT JOIN kids ON kids.up = nodes.k),
sums AS (
  SELECT a.k, sum(CASE WHEN n_children = 0 THEN 1 ELSE 0 END)::BIGINT AS n_leaves, sum((o.n - 1) * o.size)::BIGINT AS saved_tokens
  FROM own o JOIN k a ON a.c = o.c AND a.d <= o.d GROUP BY 1)
SELECT own.c AS conv_id, own.d AS depth, p.c AS parent_conv_id, own.n AS n_convs, own.n_children, n_leaves, saved_tokens, sha256(coalesce(own.ends, '')) AS ends_sha256
FROM own JOIN sums USING (k) LEFT JOIN own p ON p.k = own.up
"""
