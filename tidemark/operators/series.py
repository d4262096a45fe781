"""Series of accounts, in which one account may hold a third of all rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

DAY = 86_400


def with_gaps(rows: DataFrame, by: str, at: str, tie: str, block_s: int = DAY) -> DataFrame:
    """rows with block and gap: the seconds since the row before of the same `by`, in the order of `at` and `tie`; null for its first.

    Rows are sorted within blocks of `block_s` seconds, so no task has an account's whole series. A block's first row comes after
    the last one of the account's block before, which a row a block tells. Rows without a time have no block and no gap.
    """
    cut = rows.withColumn("block", F.floor(F.col(at) / block_s))
    inside = F.lag(at).over(Window.partitionBy(by, "block").orderBy(at, tie))
    ends = cut.where(F.col(at).isNotNull()).groupBy(by, "block").agg(F.max(at).alias("_end"))
    before = ends.select(F.col(by).alias("_by"), F.col("block").alias("_block"), F.lag("_end").over(Window.partitionBy(by).orderBy("block")).alias("_before"))
    joined = cut.withColumn("_inside", inside).join(before, F.col(by).eqNullSafe(F.col("_by")) & (F.col("block") == F.col("_block")), "left")
    return joined.withColumn("gap", F.col(at) - F.coalesce("_inside", "_before")).drop("_inside", "_before", "_by", "_block")


def run_lengths(rows: DataFrame, by: str, at: str, tie: str, value: str, block_s: int = DAY) -> DataFrame:
    """by, block, series: each block's values in order, before each of them -(gap - 1) where over a second has passed since the row before. The blocks of an account, one after another, are its series."""
    step = F.when(F.col("gap") > 1, F.array(-(F.col("gap") - 1), F.col(value))).otherwise(F.array(value))
    held = with_gaps(rows, by, at, tie, block_s).select(by, "block", F.struct(at, tie, step.alias("v")).alias("x"))
    return held.groupBy(by, "block").agg(F.flatten(F.transform(F.array_sort(F.collect_list("x")), lambda x: x["v"])).alias("series"))
