"""How much of an identifier space is known, and which accounts act alike."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import ids

#: The shares of hits of the curve.
SHARES = (0.9, 0.95, 0.99, 0.995, 0.999, 1.0)
#: Rows or pairs of groups that one task joins or counts.
TASK_ROWS = 1_000_000


def N():
    return F.count(F.lit(1))


def split_counts(df: DataFrame, tags: Column, inside: Column) -> DataFrame:
    """tag, at_zero, rest: occurrences where `inside` holds and elsewhere, in one pass."""
    rows = df.select(inside.alias("i"), F.explode(tags).alias("tag"))
    return rows.groupBy("tag").agg(F.count_if("i").alias("at_zero"), F.count_if(~F.col("i")).alias("rest"))


def blocks(df: DataFrame, member: str, author: str) -> DataFrame:
    """Members grouped by the identical set of authors: authors, members."""
    sets = df.groupBy(member).agg(F.array_join(F.array_sort(F.collect_set(author)), ",").alias("s"))
    keyed = sets.select(F.md5("s").alias("k"), "s")  # sets meet by 128 bits; one text a set and task is shuffled
    return keyed.groupBy("k").agg(F.first("s").alias("authors"), N().alias("members")).drop("k")


def shared_members(edges: DataFrame, group: str, member: str, least_size: int, least_shared: int, hot: int = 1000) -> DataFrame:
    """Pairs of groups with at least least_shared members in common, among groups of least_size or more.

    A member of over `hot` groups isn't paired by itself: it counts in pairs that have another one or
    least_shared hot ones in common, and only such can be in the result. There are few hot members
    (edges / hot at most), so a group keeps its own as an array. The pairs are counted from the members' sizes
    first and dealt to as many tasks as TASK_ROWS asks for, so a task's memory doesn't grow with the edges.
    """
    large = edges.groupBy(group).agg(N().alias("n")).where(F.col("n") >= least_size)
    kept = edges.join(large, group, "left_semi").select(F.col(group).alias("g"), F.col(member).alias("m")).distinct().checkpoint()
    size = kept.groupBy("m").agg(N().alias("n"))
    busy = size.where(F.col("n") > hot).select("m")
    own = kept.join(busy, "m", "left_semi").groupBy("g").agg(F.array_sort(F.collect_set("m")).alias("h")).checkpoint()
    some = F.array(F.array().cast("array<bigint>"))
    for _ in range(least_shared):  # all sets of least_shared hot members of a group
        some = F.flatten(F.transform(some, lambda s: F.transform(F.filter("h", lambda x: (F.size(s) == 0) | (x > F.try_element_at(s, F.lit(-1)))), lambda x: F.array_append(s, x))))
    few = size.where(F.col("n") <= hot)
    counted = few.agg(F.sum("n").alias("rows"), F.sum(F.col("n") * (F.col("n") - 1) / 2).alias("pairs")).first()
    parts = [max(1, math.ceil((x or 0) / TASK_ROWS)) for x in counted]
    holders = own.select("g", F.lit(True).alias("w"))
    by_few = kept.join(busy, "m", "left_anti").join(holders, "g", "left").select("g", "m", F.col("w").isNotNull().alias("w")).repartition(parts[0], "m")
    by_hot = own.select("g", F.explode(some).alias("m"), F.lit(True).alias("w"))
    side = lambda d, g: d.select(F.col("g").alias(g), "m", F.col("w").alias(f"w{g}"))
    pair = lambda d: side(d, "a").join(side(d, "b"), "m").where("a < b")
    one = pair(by_few).select("a", "b", (F.col("wa") & F.col("wb")).alias("w"), F.lit(1).cast("long").alias("n"))
    none = pair(by_hot).select("a", "b", F.lit(True).alias("w"), F.lit(0).cast("long").alias("n")).distinct()
    sums = one.unionByName(none).repartition(parts[1], "a", "b").groupBy("a", "b").agg(F.sum("n").alias("n"), F.max("w").alias("w"))
    # Only where both groups have hot members can these add to the pair's own.
    with_hot = sums.where(F.col("w") | (F.col("n") >= least_shared)).join(own.toDF("a", "x"), "a", "left").join(own.toDF("b", "y"), "b", "left")
    shared = F.col("n") + F.coalesce(F.size(F.array_intersect("x", "y")), F.lit(0))
    return with_hot.select("a", "b", F.when(F.col("x").isNull() | F.col("y").isNull(), F.col("n")).otherwise(shared).alias("shared")).where(F.col("shared") >= least_shared)


def entropy(df: DataFrame, x: str) -> DataFrame:
    """Distinct values and entropy in nats, from one count a value."""
    per = df.groupBy(x).agg(N().alias("n"))
    total = per.agg(F.sum("n").alias("t"))
    p = F.col("n") / F.col("t")
    return per.crossJoin(F.broadcast(total)).agg(N().alias("values"), F.round(-F.sum(p * F.ln(p)), 4).alias("entropy"))


def interval_counts(df: DataFrame, word: str, intervals: Sequence[tuple[int, int]]) -> DataFrame:
    """segment, x, n: how often each value of each interval of bits occurs, in one pass."""
    places = F.array(*[F.struct(F.lit(f"{a}-{b}").alias("segment"), ids.segment(F.col(word), a, b).alias("x")) for a, b in intervals])
    return df.select(F.inline(places)).groupBy("segment", "x").agg(N().alias("n"))


def interval_stats(n: DataFrame) -> DataFrame:
    """segment, values, entropy in nats: ln T - sum(n ln n) / T over counts n that add up to T."""
    total = F.sum("n")
    return n.groupBy("segment").agg(N().alias("values"), F.round(F.ln(total) - F.sum(F.col("n") * F.ln("n")) / total, 4).alias("entropy"))


def needed_values(n: DataFrame, share: int, of: int) -> DataFrame:
    """segment, needed: how many of a segment's values, the most frequent first, reach share / of of all; a window holds the values of one interval of bits."""
    w = Window.partitionBy("segment")
    before = F.sum("n").over(w.orderBy(F.desc("n"), "x").rowsBetween(Window.unboundedPreceding, 0)) - F.col("n")
    rows = n.withColumn("_before", before).withColumn("_total", F.sum("n").over(w))
    return rows.where(F.col("_before") * of < F.col("_total") * share).groupBy("segment").agg(N().alias("needed"))


def missing(df: DataFrame, keys: list[str], x: str, most: float) -> DataFrame:
    """Values between a group's least and largest that it lacks, if they are few for what it has."""
    g = df.groupBy(*keys).agg(F.collect_set(x).alias("seen"), F.min(x).alias("a"), F.max(x).alias("b"))
    gone = g.withColumn("gone", F.array_except(F.sequence("a", "b"), "seen")).where(F.size("gone") / F.size("seen") < most)
    return gone.select(*keys, F.explode("gone").alias(x))


def proposals(df: DataFrame, place: str, at: list[str], counter: str, known: DataFrame, most: float) -> DataFrame:
    """place, at, counter of missing() counters whose pair with the place no request has tried, so that they are worth one; `known` has place and counter."""
    return missing(df, [place, *at], counter, most).join(known.select(place, counter).distinct(), [place, counter], "left_anti").select(place, *at, counter)


def hits_by(df: DataFrame) -> DataFrame:
    """s, hit -> s, hits, requests."""
    return df.groupBy("s").agg(F.count_if("hit").alias("hits"), N().alias("requests"))


def cumulative(per: DataFrame) -> DataFrame:
    """Running hits from the best value on; one row a dictionary value, so one task holds them."""
    return per.withColumn("cum", F.sum("hits").over(Window.orderBy(F.desc("hits"), "s").rowsBetween(Window.unboundedPreceding, 0)))


def hit_rate_curve(df: DataFrame) -> DataFrame:
    """For each share of hits: what the fewest values keep, their hit rate and their number."""
    per = hits_by(df)
    total = per.agg(F.sum("hits").alias("total"))
    rows = cumulative(per).crossJoin(F.broadcast(total)).withColumn("share", F.explode(F.array(*map(F.lit, SHARES))))
    kept = rows.where(F.col("cum") <= F.floor(F.col("total") * F.col("share")))
    return kept.groupBy("share").agg(F.round(F.sum("hits") / F.max("total"), 4).alias("kept"), F.round(F.sum("hits") / F.sum("requests"), 4).alias("hit_rate"), N().alias("suffixes"))


def counts_of_counts(df: DataFrame, x: str) -> DataFrame:
    """r, species: how many values occur r times."""
    return df.groupBy(x).agg(N().alias("r")).groupBy("r").agg(N().alias("species"))


def _f(r: int) -> Column:
    return F.coalesce(F.sum(F.when(F.col("r") == r, F.col("species"))), F.lit(0))


def unseen_mass(cc: DataFrame) -> DataFrame:
    return cc.agg(F.round(_f(1) / F.sum(F.col("r") * F.col("species")), 6).alias("p0"))


def chao1(cc: DataFrame) -> DataFrame:
    """Bias-corrected."""
    return cc.agg(F.round(F.sum("species") + _f(1) * (_f(1) - 1) / (2 * (_f(2) + 1)), 4).alias("chao1"))
