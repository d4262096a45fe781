"""Series cut into blocks against whole ones."""

import random

from pyspark.sql import Window
from pyspark.sql import functions as F

from tidemark.operators import series


def test_gaps_reach_over_blocks(spark):
    rng = random.Random(6)
    rows = [(a, rng.choice([None, rng.randrange(4000), rng.randrange(40) * 100]), i, i % 9) for i, a in enumerate([1] * 300 + [2] * 40 + [3] + [None] * 30)]
    df = spark.createDataFrame(rows, "a long, t long, i long, v long").repartition(4)
    got = {r["i"]: r["gap"] for r in series.with_gaps(df, "a", "t", "i", 100).collect()}
    whole = df.where("t is not null").withColumn("gap", F.col("t") - F.lag("t").over(Window.partitionBy("a").orderBy("t", "i")))
    want = {r["i"]: r["gap"] for r in whole.collect()}
    assert len(got) == len(rows) and all(got[i] == want.get(i) for i in got)


def test_run_lengths_join_to_the_whole_series(spark):
    rng = random.Random(2)
    rows = [(rng.randrange(3), rng.randrange(3000), i, i % 7) for i in range(400)]
    parts: dict[int, list] = {}
    for r in series.run_lengths(spark.createDataFrame(rows, "a long, t long, i long, v long"), "a", "t", "i", "v", 250).orderBy("a", "block").collect():
        parts.setdefault(r["a"], []).extend(r["series"])
    for a in range(3):
        want, last = [], None
        for t, _, v in sorted((t, i, v) for b, t, i, v in rows if b == a):
            want += ([-(t - last - 1)] if last is not None and t - last > 1 else []) + [v]
            last = t
        assert parts[a] == want
