"""Connected components of any size by alternating large and small stars; a node with very many neighbours is in no one task."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _common as c


def large_star(edges: DataFrame) -> DataFrame:
    """Each larger neighbour of a node is linked with the least of the node and its neighbours."""
    both = edges.select(F.explode(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))).alias("e")).select("e.a", "e.b")
    led = c.with_first(both, ["a"], F.col("b"), F.col("b")).where("b > a")
    return led.select(F.least("first", "a").alias("a"), "b").where("a <> b").distinct()


def small_star(edges: DataFrame) -> DataFrame:
    """Each smaller neighbour of a node, and the node, are linked with the least of them."""
    down = edges.select(F.greatest("a", "b").alias("b"), F.least("a", "b").alias("a"))
    led = c.with_first(down, ["b"], F.col("a"), F.col("a"))
    return led.select(F.col("first").alias("a"), F.explode(F.array("a", "b")).alias("b")).where("a <> b").distinct()


def components(edges: DataFrame) -> DataFrame:
    """node, component (its least node) of every node that has an edge. edges: a, b (long, not null)."""
    edges = c.staged(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a <> b").distinct(), "edges")
    seen = None
    while True:
        # Done when each node has one edge, to its component's least node, which has none above it.
        state = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if state == seen or not state[0]:
            break
        seen = state
        # Stored in between, as each star uses its edges several times, and plans would multiply.
        edges = c.staged(small_star(c.staged(large_star(edges), "edges")), "edges")
    return edges.select(F.col("b").alias("node"), F.col("a").alias("component")).union(edges.select("a", "a").distinct())
