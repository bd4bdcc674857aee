"""Connected components by alternating large-star and small-star steps, as joins on stored tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scoreflow.llm.common import stored


class Forest:
    """Union-find over the ids that one task meets."""

    def __init__(self):
        self.up: dict[int, int] = {}

    def root(self, x: int) -> int:
        up = self.up
        while up.setdefault(x, x) != x:
            up[x] = x = up[up[x]]
        return x

    def join(self, a: int, b: int) -> bool:
        a, b = self.root(a), self.root(b)
        self.up[max(a, b)] = min(a, b)
        return a != b


def _with_least(rows: DataFrame) -> DataFrame:
    """Rows (u, v) with the least neighbour of u. The text key makes both sides shuffle for this
    join, so the planner can split a node with very many neighbours."""
    least = rows.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").cast("string").alias("k"), "m")
    return rows.withColumn("k", F.col("u").cast("string")).join(least, "k")


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).union(edges.select("b", "a"))
    found = _with_least(both).where("v > u").select(F.col("v").alias("a"), F.least("u", "m").alias("b"))
    return found.where("a <> b").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    found = _with_least(edges.select(F.col("a").alias("u"), F.col("b").alias("v")))
    pairs = F.array(F.struct(F.col("v").alias("a"), F.col("m").alias("b")), F.struct(F.col("u").alias("a"), F.col("m").alias("b")))
    return found.select(F.inline(pairs)).where("a <> b").distinct()


def _mark(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first())


def components(links: DataFrame) -> DataFrame:
    """(node, component) for every node in ``links`` (a, b); the component is its least node.

    Each round is stored in the shared folder; the rounds end when one changes nothing. Links of a
    node to itself are ignored; without links the result is empty.
    """
    edges = links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct()
    edges, before = stored(edges), None
    while (now := _mark(edges)) != before and now[0]:
        edges, before = stored(_small_star(_large_star(edges))), now
    roots = edges.select(F.col("b").alias("node")).distinct()
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).union(
        roots.select("node", F.col("node").alias("component"))
    )
