"""Histograms against NumPy, sketches against exact counts, attempts against Python's own notation."""

import datetime
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.functions import attempts
from tidemark.operators import counts


@pytest.mark.parametrize("values", [[0, 0, 1, 2, 5, 9, 10, 99, 1000], [3, 3, 4, 700], [7], [0], [1, 1], [0, 1], list(range(1, 400)), []])
def test_histograms_follow_numpy(spark, values):
    df = spark.createDataFrame([(v,) for v in values] + [(None,)], "x long")
    got = [tuple(r)[:3] for r in counts.log_histogram(df, "x", 6).orderBy("lo").collect()]
    edges = counts.log_edges(min(values), max(values), 6) if values else []
    if len(edges) < 2:
        assert got == [] and (not values or max(values) in (0, 1, 7))
    else:
        n, _ = np.histogram(values, edges)
        assert got == [*zip(edges[:-1], edges[1:], n.tolist())] and n.sum() == len(values)
    got = counts.geometric_histogram_to_max(df, "x", 30).orderBy("lo").collect()
    if values and max(values) > 1:
        n, e = np.histogram(values, np.geomspace(1, max(values), 30))
        assert [r["n"] for r in got] == n.tolist() and np.allclose([r["lo"] for r in got], e[:-1]) and abs(sum(r["share"] for r in got) - 1) < 1e-9
    else:
        assert got == []


def test_edges_are_whole_and_distinct():
    assert counts.log_edges(0, 1000, 20)[:4] == [0, 1, 2, 3] and counts.log_edges(0, 1000, 20)[-1] == 1000
    assert counts.log_edges(20, 20_000, 3) == [20, 200, 2000, 20_000]


def test_sketches_unite(spark):
    """Any set of slices is within five standard errors, and a value in several slices counts once."""
    df = spark.range(60_000).select((F.col("id") % 40_000).alias("x"), (F.col("id") % 7).alias("slice"))
    held = counts.sketches(df, ["slice"], "x", 12).persist()
    error = 5 * 0.83 / 2**6
    for slices in ([0], [1, 4], [0, 1, 2, 3, 4, 5, 6]):
        exact = df.where(F.col("slice").isin(slices)).select("x").distinct().count()
        assert abs(counts.distinct_of(held.where(F.col("slice").isin(slices))).first()["distinct"] / exact - 1) < error
    each = {r["slice"]: r["distinct"] for r in counts.distinct_of(held, ["slice"]).collect()}
    assert len(each) == 7 and all(abs(n / 8571 - 1) < error for n in each.values())


def test_attempts_as_python_writes_them(spark):
    rng = random.Random(3)
    def moment():
        return rng.choice([None, datetime.datetime(2024, 4, 10, 19, rng.randrange(60), rng.choice([0, 5]), rng.choice([0, 7, 123456]))])
    lists = [[{"exception": rng.choice([None, "", "plain", "it's", 'say "x"', "both ' and \"", "back\\slash \\' \\\\", "line\nfeed\ttab\r", "\x00\x1b[0m", "é文🎉", "}, {'exception': 'no'", "'", '"', "\\", "x" * 300]), "pre_time": moment(), "post_time": moment()}
              for _ in range(rng.randrange(5))] for _ in range(200)]
    df = spark.createDataFrame([(i, repr(x)) for i, x in enumerate(lists)] + [(900, None), (901, ""), (902, "no list")], "i int, t string")
    got = {r["i"]: r["a"] for r in df.select("i", attempts.parse(F.col("t")).alias("a")).collect()}
    assert [[r.asDict() for r in got[i]] for i in range(len(lists))] == lists
    assert got[900] is None and got[901] == [] and got[902] == []
    short = df.select(attempts.truncate(attempts.parse(F.col("t")), 3)["exception"].alias("e")).collect()
    assert [r["e"] for r in short[: len(lists)]] == [[None if a["exception"] is None else a["exception"][:3] for a in x] for x in lists]


def test_timelines_hold_empty_intervals(spark):
    """By the second, over more intervals than a block of the grid holds."""
    df = spark.createDataFrame([(t,) for t in (5, 5, 7, 25_007, None)], "t long")
    got = counts.timeline(df, "t", 1, n=F.count(F.lit(1))).collect()
    assert len(got) == 25_003 and {r["at"]: r["n"] for r in got if r["n"]} == {5: 2, 7: 1, 25_007: 1} and {r["at"] for r in got} == {*range(5, 25_008)}
    assert {tuple(r) for r in counts.timeline(df.where("t < 10"), "t", 3, n=F.count(F.lit(1))).collect()} == {(3, 2), (6, 1)}
    assert counts.timeline(df.where("t is null"), "t", 3, n=F.count(F.lit(1))).count() == 0


def test_extrapolation_follows_the_whole_hour(spark):
    per = spark.createDataFrame([(19, m, 10 + (m == 42) * 10) for m in range(60)] + [(3, 42, 6), (4, 41, 9)], "h int, m int, n long")
    got = {r["h"]: r["estimate"] for r in counts.extrapolated(per, "h", "m", 42, per.where("h = 19")).collect()}
    assert set(got) == {3, 19} and abs(got[19] - 610) < 1e-9 and abs(got[3] - 6 * 60 * (610 / 60) / 20) < 1e-9


def test_attempts_with_very_long_messages(spark):
    """Their length costs no stack, and no text is scanned once more for each part of a time."""
    long = ["x" * 200_000, "it's " * 40_000, '\\"\'' * 30_000]
    log = repr([{"exception": e, "pre_time": None, "post_time": None} for e in long])
    got = spark.createDataFrame([(log,)], "t string").select(attempts.parse(F.col("t")).alias("a")).first()["a"]
    assert [r["exception"] for r in got] == long
    plan = spark.createDataFrame([("None",)], "t string").select(attempts.time(F.col("t")).alias("a"))._jdf.queryExecution().analyzed().toString()
    assert plan.count("regexp_extract_all") == 1
