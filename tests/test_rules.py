"""Hand fixtures with known answers."""

import math

from pyspark.sql import functions as F

from tidemark.functions import ids, rules
from tidemark.operators import coverage, ledger


def one(df):
    return df.first()[0]


def test_id_round_trip(spark):
    df = spark.createDataFrame([(1712775688, 5, 3, 7)], "s long, m long, c long, g long")
    i = ids.compose(*map(F.col, "smcg"))
    got = df.select(i.alias("i")).select(ids.second(F.col("i")), ids.millisecond(F.col("i")), ids.counter(F.col("i")), ids.geo(F.col("i"))).first()
    assert tuple(got) == (1712775688, 5, 3, 7)


def test_unicode_hashtag(spark):
    df = spark.createDataFrame([("#été",)], "t string")
    assert one(df.select(rules.hashtags(F.col("t")))) == []
    assert one(df.select(rules.hashtags(F.col("t"), True))) == ["#été"]


def test_success_is_kleene(spark):
    df = spark.createDataFrame([(None, None), (None, 1), (rules.GONE, None), ("x", None)], "s string, i long")
    assert [r[0] for r in df.select(rules.success(F.col("s"), F.col("i"))).collect()] == [None, True, False, True]


def test_unseen_mass(spark):
    df = spark.createDataFrame([("a",), ("b",), ("c",), ("c",)], "x string")
    assert one(coverage.unseen_mass(coverage.counts_of_counts(df, "x"))) == 0.5


def test_missing_counters(spark):
    df = spark.createDataFrame([(1, x) for x in (10, 11, 13, 14, 15, 16, 17)], "g long, c long")
    assert [tuple(r) for r in coverage.missing(df, ["g"], "c", 0.2).collect()] == [(1, 12)]


def test_ledger_resume_then_apply_leaves_nothing(spark):
    held = ledger.resume(spark.createDataFrame([(1, True)], "args long, completed boolean"), spark.range(1, 4).toDF("args"))
    assert held.where("not completed").count() == 2
    news = spark.range(1, 4).select(F.col("id").alias("args"), F.lit(None).cast("string").alias("exception"))
    after = ledger.apply(held.withColumn("exceptions", F.array().cast("array<string>")), news, 3)
    assert after.where("not completed").count() == 0


def test_entropy_of_two_equal_values(spark):
    df = spark.createDataFrame([(0,), (1,)], "x int")
    assert coverage.entropy(df, "x").first()["entropy"] == round(math.log(2), 4)
