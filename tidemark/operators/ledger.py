"""The request ledger as DataFrames: one row an identifier, with its attempts and whether it is done."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import ids

def milliseconds(starts: DataFrame, start: str, n: int) -> DataFrame:
    """ms: n milliseconds from each start (since the epoch) on."""
    return starts.select(F.explode(F.sequence(F.col(start), F.col(start) + n - 1)).alias("ms"))


def candidates(milliseconds: DataFrame, dictionary: DataFrame) -> DataFrame:
    """ms (since the epoch) x suffix -> id; the dictionary is cut to distinct numbers of 22 bits, so what is broadcast is bounded."""
    sec, ms = F.floor(F.col("ms") / 1000), F.col("ms") % 1000
    few = dictionary.select(ids.suffix(F.col("suffix")).alias("suffix")).distinct()
    both = milliseconds.crossJoin(F.broadcast(few))
    return both.select((ids.compose(sec, ms, F.lit(0), F.lit(0)) + F.col("suffix")).alias("id"), "ms", "suffix")


def schedule(day: DataFrame) -> DataFrame:
    """Seconds of hour 19 and of minute 42 of every hour, for each day (epoch seconds)."""
    hour = day.select(F.explode(F.sequence(F.col("day") + 68400, F.col("day") + 71999)).alias("at"), F.lit("hour").alias("slice"))
    starts = day.select(F.explode(F.sequence(F.col("day") + 2520, F.col("day") + 23 * 3600 + 2520, F.lit(3600))).alias("s"))
    minutes = starts.select(F.explode(F.sequence(F.col("s"), F.col("s") + 59)).alias("at"), F.lit("minutes").alias("slice"))
    return hour.unionByName(minutes)


def load(rows: DataFrame) -> DataFrame:
    """id, found, status_code -> args, completed: answered by a post or a status."""
    return rows.select(F.col("id").alias("args"), (F.col("found").isNotNull() | F.col("status_code").isNotNull()).alias("completed"))


def resume(done: DataFrame, wanted: DataFrame) -> DataFrame:
    """The ledger with wanted args that it hasn't got."""
    return done.unionByName(wanted.distinct().join(done.select("args"), "args", "left_anti").withColumn("completed", F.lit(False)))


def apply(held: DataFrame, news: DataFrame, most: int) -> DataFrame:
    """News (args, exception or null) applied: a failure adds an attempt; done at success or `most` attempts."""
    both = held.join(news.select("args", "exception", F.lit(True).alias("_new")), "args", "left")
    tries = F.when(F.col("exception").isNotNull(), F.array_append("exceptions", F.col("exception"))).otherwise(F.col("exceptions"))
    success = F.coalesce(F.col("_new"), F.lit(False)) & F.col("exception").isNull()
    return both.select("args", tries.alias("exceptions"), (F.col("completed") | success | (F.size(tries) >= most)).alias("completed"))


def upsert(held: DataFrame, news: DataFrame, key: str, value: str) -> DataFrame:
    return held.join(news.withColumnRenamed(value, "_v"), key, "left").select(key, F.coalesce("_v", value).alias(value))


def split_mismatched(rows: DataFrame, asked: str, echoed: str, by: str, kept: str, quarantine: str) -> None:
    """Writes the rows whose answer has the id that was asked for, and apart from them all rows of every slice with an answer of another id or of none."""
    wrong = ~F.col(asked).eqNullSafe(F.col(echoed))
    rows.where(F.col(asked) == F.col(echoed)).write.parquet(kept)
    bad = rows.where(wrong).select(by).distinct()
    rows.join(bad, by, "left_semi").select(*rows.columns).write.parquet(quarantine)
