"""Connected components by alternating large-star and small-star steps.

Each step is one grouping and one join on a node, so a hub is pre-aggregated map-side and the join's large side can be
split by adaptive execution. The edges of every round are written to the shared folder, which bounds the lineage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    return both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    # every edge comes as (a, b) with a > b
    least = edges.groupBy("a").agg(F.min("b").alias("m"))
    linked = edges.join(least, "a").where("b != m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return linked.unionByName(least.select("a", F.col("m").alias("b"))).distinct()


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, root) for each node of the undirected `edges` (a, b: long); root is the smallest node reachable.

    Self-loops and repeated edges are ignored; an empty table gives an empty one. Nodes without edges don't appear.
    Stops when a round changes nothing; the number of rounds grows with the logarithm of the number of nodes, and
    exceeding `rounds` is an error, never a silent cut.
    """
    now = written(
        edges.where("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges"
    )

    def mark(df: DataFrame) -> tuple:
        return tuple(
            df.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        )

    before = mark(now)
    for _ in range(rounds):
        if before[0] == 0:
            break
        now = written(_small_star(_large_star(now)), "stars")
        after = mark(now)
        if after == before:
            break
        before = after
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(
        now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
    )
