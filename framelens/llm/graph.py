"""Connected components of a table of links, without bringing links to the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F
import pyarrow as pa

from framelens.llm import common


def _local_forest(batches):
    """Union-find over the links of one task: at most one link per node leaves it.

    The forest is emptied when it holds a million nodes, so memory stays bounded; links that
    meet only afterwards are left to the rounds over the whole table.
    """
    parent: dict[bytes, bytes] = {}

    def find(x: bytes) -> bytes:
        root = x
        while (up := parent.get(root, root)) != root:
            root = up
        while (up := parent.get(x, x)) != root and up != x:
            parent[x], x = root, up
        return root

    def flush():
        nodes = [x for x in parent if find(x) != x]
        return pa.RecordBatch.from_arrays(
            [pa.array(nodes, pa.binary()), pa.array([find(x) for x in nodes], pa.binary())], names=["a", "b"])

    for batch in batches:
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            parent.setdefault(a, a)
            parent.setdefault(b, b)
            ra, rb = find(a), find(b)
            if ra != rb:
                parent[max(ra, rb)] = min(ra, rb)
        if len(parent) > 1_000_000:
            yield flush()
            parent.clear()
    yield flush()


def components(links: DataFrame) -> DataFrame:
    """Links ``a``, ``b`` (binary) -> every linked node with the smallest node it can reach.

    Rounds of large and small stars hook nodes to the smallest neighbour until nothing moves.
    Each round is stored, so a lost executor repeats one round at most. Minima are taken before
    the shuffle and the neighbours of one node are never gathered in one place.
    """
    edges = common.stored(links.select("a", "b").mapInArrow(_local_forest, "a binary, b binary"))
    before = None
    while True:
        seen = Observation()
        small = common.stored(_small_star(_large_star(edges)).distinct().observe(
            seen, F.count(F.lit(1)).alias("n"), F.sum(F.crc32(F.concat("a", "b"))).alias("sum")))
        state = (seen.get["n"], seen.get["sum"])
        if state == before:
            return small.select(F.col("a").alias("node"), F.col("b").alias("root"))
        before, edges = state, small


def _large_star(edges: DataFrame) -> DataFrame:
    """Every larger neighbour of a node is linked to the smallest node around it."""
    both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    return common.lookup(both, least, ["a"]).where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))


def _small_star(edges: DataFrame) -> DataFrame:
    """Every smaller neighbour of a node, and the node, are linked to the smallest of them."""
    least = edges.groupBy("a").agg(F.min("b").alias("m"))
    hooked = common.lookup(edges, least, ["a"]).where("b != m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return hooked.union(least.select("a", F.col("m").alias("b")))
