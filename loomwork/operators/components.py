"""Connected components of an edge list, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomwork.session import shared_dir


def _large_star(e: DataFrame) -> DataFrame:
    both = e.unionAll(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")


def _small_star(e: DataFrame) -> DataFrame:
    down = e.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    moved = down.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionAll(least.select("u", F.col("m").alias("v"))).distinct()


def _state(e: DataFrame) -> tuple:
    return tuple(e.agg(F.count("*"), F.expr("bit_xor(xxhash64(u, v))")).first())


def connected_components(edges: DataFrame, left: str = "u", right: str = "v", rounds: int = 60) -> DataFrame:
    """(node, component) for every node of an undirected edge list; component is the smallest node reached.

    Null ends and self loops are no edges. Each round is cut by checkpoint() in the shared folder, so that a lost
    executor costs one round. Rounds grow with the logarithm of the longest path; a hot node is one row of its
    neighbours' minimum (partial aggregation), and adaptive execution splits its join.
    """
    shared_dir(edges.sparkSession)
    e = edges.select(F.col(left).alias("u"), F.col(right).alias("v")).where("u <> v")
    e = e.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct().checkpoint()
    before = _state(e)
    for _ in range(rounds):
        if not before[0]:
            break
        e = _small_star(_large_star(e)).checkpoint()
        now = _state(e)
        if now == before:
            break
        before = now
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    roots = e.select(F.col("v").alias("node")).distinct().withColumn("component", F.col("node"))
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).unionAll(roots)
