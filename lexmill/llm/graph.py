"""Connected components by alternating stars over a DataFrame of edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexmill.llm.common import Workspace, spread


def _both(edges: DataFrame) -> DataFrame:
    return edges.select(F.inline(F.array(F.struct(F.col("a").alias("u"), F.col("b").alias("v")), F.struct(F.col("b").alias("u"), F.col("a").alias("v")))))


def _large_star(edges: DataFrame, work: Workspace, name: str) -> DataFrame:
    """Each node sends its larger neighbours to the least of its neighbourhood."""
    pairs = _both(edges)
    least = work.write(pairs.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"), F.sum((F.col("v") > F.col("u")).cast("int")).alias("n")), name)
    return spread(pairs.where("v > u"), least, "u", "v").where("v <> m").select(F.col("v").alias("a"), F.col("m").alias("b"))


def _small_star(edges: DataFrame) -> DataFrame:
    """Each node sends its smaller neighbours and itself to the least of them. Edges come as a > b."""
    least = edges.groupBy("a").agg(F.min("b").alias("m"))
    moved = edges.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.unionByName(least.select("a", F.col("m").alias("b")))


def components(edges: DataFrame, work: Workspace, name: str = "components", rounds: int = 60) -> DataFrame:
    """(node, component): for every node on an edge, the least node it reaches.

    edges: columns a and b, any order, repeats and loops allowed. Minima are partial aggregates, and a node with many
    neighbours is dealt over several tasks. Each round is written to the
    shared folder. Raises if the given number of rounds (logarithmic in practice) is not enough."""
    e = edges.where("a is not null and b is not null and a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    e = work.write(e, f"{name}-0")
    mark = None
    for i in range(1, rounds + 1):
        e = work.write(_small_star(_large_star(e, work, f"{name}-least-{i}")).distinct(), f"{name}-{i}")
        work.drop(f"{name}-{i - 1}")
        work.drop(f"{name}-least-{i}")
        now = e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == mark:
            break
        mark = now
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    roots = e.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    return e.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(roots)
