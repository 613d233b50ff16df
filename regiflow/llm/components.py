"""Connected components of an edge table by alternating large-star and
small-star rounds (Kiveris et al., "Connected Components in MapReduce and
Beyond", 2014).

Every round is two joins of the edge table with one minimum per node.  The
minima are written before they are joined, so both join inputs are plain
shuffles and AQE can split a node with very many edges.  Nothing is collected
but one row of counts per round.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import drop_written, materialize


def _large_star(spark: SparkSession, edges: DataFrame) -> DataFrame:
    """(u, v) with u > v -> every larger neighbour of u linked to the
    smallest node around u."""
    both = edges.select("u", "v").unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = materialize(
        spark, both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "star-min")
    out = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return out.distinct(), least


def _small_star(spark: SparkSession, edges: DataFrame) -> DataFrame:
    """(u, v) with u > v -> u and its smaller neighbours linked to the
    smallest of them."""
    least = materialize(spark, edges.groupBy("u").agg(F.min("v").alias("m")), "star-min")
    moved = edges.join(least, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionAll(least.select("u", F.col("m").alias("v"))).distinct(), least


def connected_components(spark: SparkSession, edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """``(node, root)`` for every node of ``edges (u, v)``: root is the
    smallest node reachable, the node itself included.

    Self edges, repeated edges and either direction are accepted; rows with a
    null end are ignored; an empty edge table gives an empty result.
    ``max_rounds`` only guards against a defect (rounds grow with the
    logarithm of the graph's diameter); reaching it raises.
    """
    step = materialize(
        spark,
        edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"), (F.col("u") != F.col("v")).alias("k"))
        .filter("k").select("u", "v").distinct(),
        "star-edges")
    seen = None
    for _ in range(max_rounds):
        large, a = _large_star(spark, step)
        large = materialize(spark, large, "star-large")
        small, b = _small_star(spark, large)
        after = materialize(spark, small, "star-edges")
        for old in (step, large, a, b):
            drop_written(spark, old)
        step = after
        now = step.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == seen:
            return (step.select(F.col("u").alias("node"), F.col("v").alias("root"))
                    .unionAll(step.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()))
        seen = now
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")
