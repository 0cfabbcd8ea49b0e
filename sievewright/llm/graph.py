"""Connected components over an edge table, by alternating star contractions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import dealt_join, written


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Link neighbours of each node to the least of them; large: those above the node, else those below and itself.

    The least neighbour comes from an aggregate with map-side partials, so a node with very many neighbours
    is summed up before it is shuffled; its edges meet that value by a broadcast (``dealt_join``).
    """
    if large:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("m"))
        # edges have a > b, so the neighbours above a node are those whose edges end in it
        met = dealt_join(edges.select(F.col("b").alias("a"), F.col("a").alias("b")), least, "a")
        out = met.select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        least = edges.groupBy("a").agg(F.min("b").alias("m"))
        out = dealt_join(edges, least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b")))
    return out.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()


def components(edges: DataFrame, limit: int = 60) -> DataFrame:
    """(node, root) for every node of ``edges`` (a, b: long); root is the least node of its component.

    Each round is written to the shared folder, so lineage stays short and a lost
    executor costs one round. The number of rounds grows with the logarithm of the
    longest chain; ``limit`` guards against a bug, and reaching it raises.
    """
    now = written(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    for _ in range(limit):
        if now.isEmpty():
            return now.select(F.col("a").alias("node"), F.col("b").alias("root"))
        after = written(_star(written(_star(now, True), "edges"), False), "edges")
        # the same edges as before: no edge is only on one side
        changed = now.withColumn("n", F.lit(1)).unionByName(after.withColumn("n", F.lit(-1))).groupBy("a", "b").agg(F.sum("n").alias("n")).where("n <> 0")
        if changed.isEmpty():
            return now.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("root"))).distinct()
        now = after
    raise RuntimeError("components did not converge")
