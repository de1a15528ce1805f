"""Connected components of an undirected graph of long ids."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from amity.llm.common import written


def components(edges: DataFrame, jumps: int = 2) -> DataFrame:
    """(node, root) for every node that occurs in ``edges`` (a, b): root is one
    node of the component, the same for all of its nodes.

    Contraction in rounds: every node points at its smallest neighbour (itself
    included), pointers are doubled ``jumps`` times, and the edges are rewritten
    to what their ends point at, until none joins two nodes. Stars
    collapse in two rounds, chains by a factor of 2^jumps or more a round.
    Minima are pre-aggregated before the shuffle, and
    every join reads written tables on both sides, so a node with a large
    share of all edges is split by the adaptive skew join. Self loops and
    repeated edges are harmless; an empty table gives an empty result."""
    both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    left = written(both.where("a <> b").distinct(), "cc-edges")
    out = written(edges.select(F.explode(F.array("a", "b")).alias("node")).distinct()
                  .withColumn("root", F.col("node")), "cc-nodes")
    while not left.isEmpty():
        point = written(left.groupBy(F.col("a").alias("node"))
                        .agg(F.least(F.min("b"), F.first("a")).alias("to")), "cc-point")
        for _ in range(jumps):
            up = point.select(F.col("node").alias("to"), F.col("to").alias("up"))
            point = written(point.join(up, "to").select("node", F.col("up").alias("to")), "cc-jump")
        pa = point.select(F.col("node").alias("a"), F.col("to").alias("ta"))
        pb = point.select(F.col("node").alias("b"), F.col("to").alias("tb"))
        half = written(left.join(pa, "a").select("ta", "b").distinct(), "cc-half")
        left = written(half.join(pb, "b").where("ta <> tb")
                       .select(F.col("ta").alias("a"), F.col("tb").alias("b")).distinct(), "cc-edges")
        out = written(out.join(point.select(F.col("node").alias("root"), "to"), "root", "left")
                      .select("node", F.coalesce("to", "root").alias("root")), "cc-nodes")
    return out
