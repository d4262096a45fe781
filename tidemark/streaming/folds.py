"""Structured Streaming forms of the folds over arriving files."""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def N():
    return F.count(F.lit(1))


def read(spark: SparkSession, path: str) -> DataFrame:
    """A parquet file or folder as a stream, a few files a trigger."""
    schema = spark.read.parquet(path).schema
    folder, _, name = path.rpartition("/")
    rows = spark.readStream.schema(schema).option("maxFilesPerTrigger", 4).option("pathGlobFilter", "*.parquet")
    if spark.read.parquet(path).inputFiles()[0].rstrip("/").endswith(name):  # one file: watch its folder
        rows = rows.option("pathGlobFilter", name)
        return rows.parquet(folder)
    return rows.parquet(path)


def folder_for(spark: SparkSession) -> str:
    """A new folder in the shared checkpoint folder."""
    return f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/drained-{uuid.uuid4().hex}"


def run(stream: DataFrame, mode: str, folder: str, each: Callable[[DataFrame, int], None]) -> list[dict]:
    """Runs a stream over what has arrived, hands every batch on, and gives the progress of each."""
    q = stream.writeStream.outputMode(mode).foreachBatch(each).option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start()
    q.awaitTermination()
    return [json.loads(p.json) for p in q.recentProgress]


def drain(stream: DataFrame, mode: str) -> DataFrame:
    """Runs a stream over what has arrived and returns its result table, kept as Parquet in the shared checkpoint folder."""
    spark, folder = stream.sparkSession, folder_for(stream.sparkSession)
    parts: list[str] = []

    def keep(rows: DataFrame, k: int) -> None:
        rows.write.mode("overwrite").parquet(f"{folder}/rows/{k}")
        parts.append(f"{folder}/rows/{k}")

    run(stream, mode, folder, keep)
    if not parts:
        return spark.createDataFrame([], stream.schema)
    return spark.read.schema(stream.schema).parquet(*(parts[-1:] if mode == "complete" else parts))


def value_counts(rows: DataFrame, key: str) -> DataFrame:
    return rows.groupBy(key).agg(F.count(F.lit(1)).alias("n"))


def second_counts(rows: DataFrame, ts: str, delay: str = "10 minutes") -> DataFrame:
    """at, n: rows of each second, in append mode: a second comes out, and leaves the state, when the watermark has passed it."""
    return rows.withWatermark(ts, delay).groupBy(F.window(ts, "1 second").alias("w")).agg(N().alias("n")).select(F.col("w.start").alias("at"), "n")


class Closed(NamedTuple):
    """closed: seconds that the watermark has passed, as they were then. open: those it hasn't, from the state. late: rows that came after their second was
    closed, with all their columns. progress: of each batch."""

    closed: DataFrame
    open: DataFrame
    late: DataFrame
    progress: list[dict]


def drain_seconds(rows: DataFrame, ts: str, delay_s: int = 600) -> Closed:
    """second_counts() over what has arrived, with what its state still holds and with the rows that it had to leave out.

    Late rows are told in a pass of their own over the same batches by the same rule: a batch's rows are held against the watermark that the
    batch before it had, the latest time of all earlier batches less the delay; a row whose second ends no later is late. That time is kept
    for each batch, so a restarted run goes on from it.
    """
    spark, folder = rows.sparkSession, folder_for(rows.sparkSession)
    counted = second_counts(rows, ts, f"{delay_s} seconds")
    closed: list[str] = []
    late: list[str] = []

    def keep(out: DataFrame, k: int) -> None:
        out.write.mode("overwrite").parquet(f"{folder}/closed/{k}")
        closed.append(f"{folder}/closed/{k}")

    progress = run(counted, "append", f"{folder}/counts", keep)
    seen = f"{folder}/seen"

    def split(batch: DataFrame, k: int) -> None:
        before = spark.read.schema("k long, latest timestamp").parquet(seen).where(F.col("k") < k - 1).agg(F.max("latest")).first()[0] if k > 1 else None
        if before is not None:
            ends = F.date_trunc("second", ts) + F.make_interval(secs=F.lit(1))
            batch.where(ends <= F.lit(before) - F.make_interval(secs=F.lit(delay_s))).write.mode("overwrite").parquet(f"{folder}/late/{k}")
            late.append(f"{folder}/late/{k}")
        batch.agg(F.max(ts).alias("latest")).write.mode("overwrite").parquet(f"{seen}/k={k}")

    run(rows, "append", f"{folder}/late-pass", split)
    held = lambda parts, schema: spark.read.schema(schema).parquet(*parts) if parts else spark.createDataFrame([], schema)
    still = held([], counted.schema)
    if closed:
        state = spark.read.format("statestore").load(f"{folder}/counts/state")
        window, n = (state.schema[x].dataType.names[0] for x in ("key", "value"))
        still = state.select(F.col("key")[window]["start"].alias("at"), F.col("value")[n].alias("n"))
    return Closed(held(closed, counted.schema), still, held(late, rows.schema), progress)


def dedup(rows: DataFrame, key: str, ts: str | None = None, delay: str = "10 minutes") -> DataFrame:
    """The first row of each key in whatever order rows come, so the state holds every key.

    With ts the state is bounded instead: rows older than the watermark go, and repeats further apart than `delay` stay.
    """
    if ts is None:
        return rows.dropDuplicates([key])
    return rows.withWatermark(ts, delay).dropDuplicatesWithinWatermark([key])
