"""Counting operators on DataFrames: distributions, histograms, shares, firsts and tops."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def value_counts(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))


def merge_counts(parts: list[DataFrame], keys: list[str]) -> DataFrame:
    """Partial counts added up."""
    return reduce(DataFrame.unionByName, parts).groupBy(*keys).agg(F.sum("n").alias("n"))


def log_edges(low: float, high: float, bins: int) -> list[float]:
    """Edges of `bins` bins of equal width in log10 from low to high, rounded to whole numbers, each once. From 0 on a bin up to 1 comes first."""
    if high <= 0:
        return []
    start = 0.0 if low <= 0 else np.log10(low)
    spaced = np.power(10.0, np.linspace(start, np.log10(high), bins + 1))
    return np.unique(np.round(np.append(0.0, spaced) if low <= 0 else spaced)).tolist()


def geometric_edges(high: float, edges: int) -> list[float]:
    """`edges` edges from 1 to high in one ratio."""
    return np.geomspace(1.0, float(high), edges).tolist() if high > 1 else []


def bin_of(x: Column, edges: Sequence[float]) -> Column:
    """The number of the bin [edge, next edge) that holds x, by halving; the last bin holds its upper edge, too. Null outside."""
    def search(low: int, high: int) -> Column:
        if high - low == 1:
            return F.lit(low)
        middle = (low + high) // 2
        return F.when(x < edges[middle], search(low, middle)).otherwise(search(middle, high))

    return F.when((x >= edges[0]) & (x <= edges[-1]), search(0, len(edges) - 1))


def histogram(df: DataFrame, x: str, edges: Sequence[float]) -> DataFrame:
    """lo, hi, n, share of every bin between edges, empty ones too; rows outside belong to none. share is of the rows inside."""
    spark = df.sparkSession
    bins = spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(zip(edges[:-1], edges[1:]))], "bin int, lo double, hi double")
    if len(edges) < 2:
        return bins.select("lo", "hi", F.lit(0).cast("long").alias("n"), F.lit(None).cast("double").alias("share"))
    n = df.groupBy(bin_of(F.col(x), edges).alias("bin")).agg(F.count(F.lit(1)).alias("n")).where("bin is not null")
    held = F.broadcast(bins).join(n, "bin", "left").fillna(0, ["n"])
    return held.select("lo", "hi", "n", F.try_divide("n", F.sum("n").over(Window.partitionBy())).alias("share"))  # a row a bin


def log_histogram(df: DataFrame, x: str, bins: int = 20) -> DataFrame:
    """histogram() between log_edges() of the least and the largest value, which one row tells the driver."""
    low, high = df.agg(F.min(x), F.max(x)).first()
    return histogram(df, x, [] if high is None else log_edges(low, high, bins))


def geometric_histogram_to_max(df: DataFrame, x: str, edges: int = 100) -> DataFrame:
    """histogram() between geometric_edges() up to the largest value."""
    high = df.agg(F.max(x)).first()[0]
    return histogram(df, x, [] if high is None else geometric_edges(high, edges))


def geometric_histogram(df: DataFrame, x: str, ratio: float, by: list[str] | None = None) -> DataFrame:
    """Bins [ratio**i, ratio**(i+1)) of values from 1 on."""
    return df.where(F.col(x) >= 1).groupBy(*(by or []), F.floor(F.ln(x) / F.ln(F.lit(ratio))).alias("bin")).agg(F.count(F.lit(1)).alias("n"))


def linear_histogram(df: DataFrame, x: str, bins: int) -> DataFrame:
    """Equal bins from 0 to the largest value, the last one closed."""
    most = df.agg(F.max(x).alias("m"))
    bin_ = F.least(F.floor(F.col(x) * float(bins) / F.col("m")), F.lit(bins - 1))
    return df.crossJoin(F.broadcast(most)).groupBy(bin_.cast("long").alias("bin")).agg(F.count(F.lit(1)).alias("n"))


def shares(df: DataFrame, keys: list[str], hit: Column, gate: int = 50) -> DataFrame:
    """total, share of hits, and whether the total is large enough to publish."""
    out = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("total"), F.round(F.avg(F.when(hit, 1.0).otherwise(0.0)), 4).alias("share"))
    return out.withColumn("significant", F.col("total") >= gate)


def with_share(counts: DataFrame, within: list[str]) -> DataFrame:
    """n as a share of all n within a group, for counts that are already small."""
    return counts.withColumn("share", F.round(F.col("n") / F.sum("n").over(Window.partitionBy(*within)), 4))


def keep_first(df: DataFrame, keys: list[str], order: list) -> DataFrame:
    """The row of each key with the least values of `order`; one row a key and task is shuffled."""
    rest = [x for x in df.columns if x not in keys]
    first = df.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("_row"))
    return first.select(*[x if x in keys else F.col("_row")[x].alias(x) for x in df.columns])


def top_k(df: DataFrame, order: list, k: int) -> DataFrame:
    return df.orderBy(*order).limit(k)


def sketches(df: DataFrame, slices: list[str], x: str, k: int = 14) -> DataFrame:
    """slices, sketch: a HyperLogLog sketch of the distinct values of x in each slice, with 2**k registers (a standard error of 0.83 / 2**(k/2))."""
    return df.groupBy(*slices).agg(F.hll_sketch_agg(x, F.lit(k)).alias("sketch"))


def distinct_of(held: DataFrame, by: list[str] | None = None) -> DataFrame:
    """by, distinct: an estimate over the union of all sketches, of any set of slices, that share `by`; the rows themselves aren't read again."""
    return held.groupBy(*(by or [])).agg(F.hll_sketch_estimate(F.hll_union_agg("sketch")).alias("distinct"))


def timeline(df: DataFrame, at: str, step: int, **counts: Column) -> DataFrame:
    """at, counts of every interval of `step` seconds from the first to the last one, 0 where nothing is."""
    start = (F.floor(F.col(at) / step) * step).alias("at")
    n = df.where(F.col(at).isNotNull()).groupBy(start).agg(*[e.alias(name) for name, e in counts.items()])
    ends = n.agg(F.min("at").alias("a"), F.max("at").alias("b")).where("a is not null")
    # The whole span is dealt out in blocks, as one row can't hold it.
    block = step * 10_000
    blocks = ends.select("b", F.explode(F.sequence("a", "b", F.lit(block).cast("long"))).alias("a"))
    grid = blocks.select(F.explode(F.sequence("a", F.least(F.col("a") + (block - step), F.col("b")), F.lit(step).cast("long"))).alias("at"))
    return grid.join(n, "at", "left").fillna(0, [*counts])


def extrapolated(per: DataFrame, hour: str, minute: str, sampled: int, whole: DataFrame) -> DataFrame:
    """hour, estimate: 60 times each hour's sampled minute, corrected by how the mean minute of a whole hour relates to its sampled one. Counts are in n."""
    factor = whole.agg((F.avg("n") / F.max(F.when(F.col(minute) == sampled, F.col("n")))).alias("_f"))
    return per.where(F.col(minute) == sampled).crossJoin(F.broadcast(factor)).select(hour, (F.col("n") * 60 * F.col("_f")).alias("estimate"))
