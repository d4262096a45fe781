"""Connected components of an undirected graph, as DataFrame rounds of large-star and small-star.

Edges and labels stay in Spark. Each round is cut by checkpoint() into the shared folder, so a lost
executor costs a round at most; rounds end when the edges no longer change.
"""

from __future__ import annotations

import gc

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def let_go(spark: SparkSession) -> None:
    """Collects the driver's garbage, upon which Spark's cleaner drops shuffles, broadcasts and code of jobs that are done."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())


def components(links: DataFrame, most: int = 50) -> DataFrame:
    """links: a, b of one type that has an order -> node, component: the smallest node it is connected with. Loops and repeats are ignored."""
    edges = links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a > b").distinct().checkpoint()
    state = _state(edges)
    for _ in range(most):
        ways = F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))  # no union: the optimizer may fail on one of checkpointed edges
        both = edges.select(F.explode(ways).alias("e")).select("e.a", "e.b")
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a > b").checkpoint()
        down = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(down, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(down.select("a", F.col("m").alias("b")))
        edges = small.where("a > b").distinct().checkpoint()
        after = _state(edges)
        if after == state:
            break
        state = after
    else:
        raise RuntimeError(f"components didn't settle in {most} rounds")
    let_go(links.sparkSession)
    # Now every edge leads to the least node of its component.
    return edges.groupBy("a").agg(F.min("b").alias("component")).select(F.col("a").alias("node"), "component")
