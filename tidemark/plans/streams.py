"""The streaming folds, run over the given tables until they are drained."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..streaming import folds
from .registry import query


def events(v):
    return folds.read(v.spark, f"{v.folder}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))


@query("stream_value_counts", "SELECT event_type, count(*) AS n FROM events GROUP BY event_type")
def _(v):
    return folds.drain(folds.value_counts(events(v), "event_type"), "complete")


@query("stream_second_counts", "SELECT epoch_us(date_trunc('second', ts)) // 1000000 AS at, count(*) AS n FROM events GROUP BY 1")
def _(v):
    """Seconds that the watermark has closed, those still open, and late rows, added up: the same in whatever order files come."""
    got = folds.drain_seconds(events(v).select("ts"), "ts")
    late = got.late.groupBy(F.date_trunc("second", "ts").alias("at")).agg(F.count(F.lit(1)).alias("n"))
    rows = got.closed.unionByName(got.open).unionByName(late)
    return rows.groupBy(F.unix_timestamp("at").alias("at")).agg(F.sum("n").alias("n"))


@query("stream_dedup_ids", "SELECT DISTINCT event_id FROM events")
def _(v):
    return folds.drain(folds.dedup(events(v).select("event_id"), "event_id"), "append")
