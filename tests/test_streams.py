"""Streaming folds over folders of many files, whose result must not hang on how rows are dealt to files."""

import os
import random
from collections import Counter

import pandas as pd
from pyspark.sql import functions as F

from tidemark.plans import registry
from tidemark.streaming import folds


def test_ids_and_counts_of_a_dozen_files_in_shuffled_time_order(spark, tmp_path):
    """Twelve files an hour apart arrive in shuffled order; some ids come again hours later."""
    rng, folder = random.Random(4), tmp_path / "events.parquet"
    folder.mkdir()
    hours, ids, kinds = list(range(12)), [], Counter()
    rng.shuffle(hours)
    for k, h in enumerate(hours):
        own = [100 * h + i for i in range(20)] + [100 * rng.randrange(12) + i for i in range(5)]
        kind = [f"t{i % 3}" for i in own]
        at = pd.to_datetime(1_700_000_000 + 3600 * h + pd.Series(range(len(own))), unit="s").astype("datetime64[us]")
        pd.DataFrame({"event_id": own, "event_type": kind, "ts": at}).to_parquet(folder / f"{k}.parquet", index=False)
        os.utime(folder / f"{k}.parquet", (1_700_000_000 + k, 1_700_000_000 + k))
        ids += own
        kinds.update(kind)
    run = lambda name: registry.queries()[name](spark, str(tmp_path)).collect()
    assert sorted(r["event_id"] for r in run("stream_dedup_ids")) == sorted(set(ids))
    assert {r["event_type"]: r["n"] for r in run("stream_value_counts")} == kinds
    assert sum(r["n"] for r in run("stream_second_counts")) == len(ids)


def write(folder, k, starts, n=50):
    at = pd.to_datetime(pd.Series([s + i // 2 for s in starts for i in range(n)]), unit="s").astype("datetime64[us]")
    pd.DataFrame({"event_id": range(len(at)), "ts": at}).to_parquet(folder / f"{k:02}.parquet", index=False)
    os.utime(folder / f"{k:02}.parquet", (1_700_000_000 + k, 1_700_000_000 + k))


def test_seconds_close_as_the_watermark_passes(spark, tmp_path):
    """In-order files of an hour each: all but the last delay's seconds come out, the state holds no more than a batch's and a delay's, nothing is late."""
    folder = tmp_path / "events.parquet"
    folder.mkdir()
    for k in range(12):
        write(folder, k, [1_700_000_000 + 3600 * k])
    rows = folds.read(spark, str(folder)).withColumn("ts", F.col("ts").cast("timestamp"))
    got = folds.drain_seconds(rows, "ts")
    closed, open_ = ({r["at"].timestamp(): r["n"] for r in part.collect()} for part in (got.closed, got.open))
    assert {*open_} == {1_700_000_000 + 3600 * 11 + i for i in range(25)} and {*closed} == {1_700_000_000 + 3600 * k + i for k in range(11) for i in range(25)}
    assert {*closed.values(), *open_.values()} == {2} and got.late.count() == 0
    assert max(p["stateOperators"][0]["numRowsTotal"] for p in got.progress) <= 4 * 25 + 25  # four files a batch
    assert got.progress[-1]["stateOperators"][0]["numRowsTotal"] == len(open_)


def test_late_rows_are_counted_apart(spark, tmp_path):
    """A file of an hour that has long been closed: its rows are late, but for those within the delay, and closed seconds stay as they came out."""
    folder = tmp_path / "events.parquet"
    folder.mkdir()
    hour = lambda h: 1_700_000_000 + 3600 * h
    for k, starts in enumerate([*([hour(h)] for h in range(8)), [hour(0), hour(7) - 300], [hour(9)]]):
        write(folder, k, starts)
    rows = folds.read(spark, str(folder)).withColumn("ts", F.col("ts").cast("timestamp"))
    got = folds.drain_seconds(rows, "ts")
    assert Counter(int(r["ts"].timestamp()) for r in got.late.collect()) == {hour(0) + i: 2 for i in range(25)} and got.late.columns == rows.columns
    on_time = Counter()
    for r in got.closed.unionByName(got.open).collect():
        on_time[int(r["at"].timestamp())] += r["n"]
    assert on_time == {s + i: 2 for s in (*map(hour, range(8)), hour(7) - 300, hour(9)) for i in range(25)}
    total = registry.queries()["stream_second_counts"](spark, str(tmp_path)).collect()
    assert {r["at"]: r["n"] for r in total}[hour(0)] == 4 and sum(r["n"] for r in total) == 11 * 50
