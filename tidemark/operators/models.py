"""Classifiers and regressions by MLlib, with folds, and representatives of topics."""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.ml import Estimator
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import stats


def fold(key: str, folds: int, seed: int = 7):
    """A fold from 0 of each key, by its hash, so that it is the same in every run and costs no shuffle."""
    return F.pmod(F.xxhash64(F.col(key), F.lit(seed)), F.lit(folds)).cast("int")


def balanced(rows: DataFrame, label: str) -> DataFrame:
    """rows with weight: both labels weigh the same together."""
    share = rows.agg(F.avg(label).alias("_p"))
    weight = F.when(F.col(label) == 1, 0.5 / F.col("_p")).otherwise(0.5 / (1 - F.col("_p")))
    return rows.crossJoin(F.broadcast(share)).withColumn("weight", weight).drop("_p")


def scored(model, rows: DataFrame, name: str = "probability") -> DataFrame:
    """rows with the model's probability of label 1."""
    added = ("rawPrediction", "prediction", "probability")
    out = model.transform(rows)
    return out.withColumn("_p", vector_to_array("probability")[1]).drop(*added).withColumnRenamed("_p", name)


def out_of_fold(rows: DataFrame, learner: Estimator, folds: int, name: str = "probability") -> DataFrame:
    """rows (with a column fold) and the probability by a model of the other folds; one fit a fold."""
    parts = [scored(learner.fit(rows.where(F.col("fold") != k)), rows.where(F.col("fold") == k), name) for k in range(folds)]
    return reduce(DataFrame.unionByName, parts)


def cross_validate(rows: DataFrame, learner: Estimator, label: str, folds: int, threshold: float = 0.5) -> DataFrame:
    """metric, mean, sd (of the population) of accuracy, precision, recall and f1 over the folds."""
    made = out_of_fold(rows, learner, folds)
    each = stats.measures(stats.confusion(made, F.col(label) == 1, F.col("probability") > threshold, ["fold"]), ["fold"])
    names = ("accuracy", "precision", "recall", "f1")
    flat = each.select(F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).alias("v")) for m in names])).alias("x")).select("x.*")
    return flat.groupBy("metric").agg(F.avg("v").alias("mean"), F.stddev_pop("v").alias("sd"))


def stack(train: DataFrame, rows: DataFrame, learners: dict[str, Estimator], last: Estimator, key: str, label: str, folds: int) -> DataFrame:
    """rows' key, label and probability by `last` over the learners' probabilities, which it learned out of fold."""
    from pyspark.ml.feature import VectorAssembler

    gather = VectorAssembler(inputCols=list(learners), outputCol="features")

    def beside(parts: list[DataFrame]) -> DataFrame:
        joined = reduce(lambda a, b: a.join(b, key), [p.select(key, name) for name, p in zip(learners, parts)])
        return joined

    inner = beside([out_of_fold(train, one, folds, name) for name, one in learners.items()]).join(train.select(key, label), key)
    top = last.fit(gather.transform(inner))
    outer = beside([scored(one.fit(train), rows, name) for name, one in learners.items()]).join(rows.select(key, label), key)
    return scored(top, gather.transform(outer)).select(key, label, "probability")


def least_squares(rows: DataFrame, features: list[str], y: str) -> DataFrame:
    """feature, value: coefficients by the normal equations, the intercept, and r2."""
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import LinearRegression

    made = VectorAssembler(inputCols=features, outputCol="_x").transform(rows.dropna(subset=[*features, y]))
    fit = LinearRegression(featuresCol="_x", labelCol=y, solver="normal").fit(made)
    values = [*zip(features, map(float, fit.coefficients)), ("intercept", float(fit.intercept)), ("r2", float(fit.summary.r2))]
    return rows.sparkSession.createDataFrame(values, "feature string, value double")


def bit_dependence(words: DataFrame, word: str, bits: int, at_once: int = 8) -> DataFrame:
    """bit, other, coefficient of logistic regressions of each bit (0: the lowest) on all others; 0 for bits that don't vary.

    Words are counted first, so a fit reads distinct words with their counts as weights. `at_once` fits run side by side, as their
    rounds are short jobs.
    """
    from pyspark import inheritable_thread_target
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import VectorAssembler

    spark = words.sparkSession
    bit = lambda i: F.shiftrightunsigned(F.col(word), i).bitwiseAND(F.lit(1).cast("long")).cast("double")
    counted = words.groupBy(word).agg(F.count(F.lit(1)).cast("double").alias("n")).select("n", *[bit(i).alias(f"b{i}") for i in range(bits)]).checkpoint()
    share = counted.agg(*[F.avg(f"b{i}").alias(f"b{i}") for i in range(bits)]).first().asDict()
    varying = [i for i in range(bits) if 0 < (share[f"b{i}"] or 0) < 1]

    @inheritable_thread_target(spark)
    def fit(i: int) -> dict[tuple[int, int], float]:
        others = [j for j in varying if j != i]
        if not others:
            return {}
        rows = VectorAssembler(inputCols=[f"b{j}" for j in others], outputCol="x").transform(counted).select("x", "n", F.col(f"b{i}").alias("y"))
        model = LogisticRegression(featuresCol="x", labelCol="y", weightCol="n", maxIter=10, regParam=1e-3).fit(rows)
        return {(i, j): float(v) for j, v in zip(others, model.coefficients)}

    with ThreadPoolExecutor(at_once) as pool:
        found = {k: v for part in pool.map(fit, varying) for k, v in part.items()}
    values = [(i, j, found.get((i, j), 0.0)) for i in range(bits) for j in range(bits) if i != j]
    return spark.createDataFrame(values, "bit int, other int, coefficient double")


def unit_vectors(rows: DataFrame, vector: str):
    x = F.transform(F.col(vector), lambda v: v.cast("double"))
    length = F.sqrt(F.aggregate(x, F.lit(0.0), lambda s, v: s + v * v))
    return rows.withColumn(vector, x).withColumn("_l", length).where("_l > 0").withColumn(vector, F.transform(vector, lambda v: v / F.col("_l"))).drop("_l")


def centroids(rows: DataFrame, topic: str, vector: str) -> DataFrame:
    """topic, centroid: the mean vector of each topic."""
    flat = rows.select(topic, F.posexplode(vector).alias("_i", "_x"))
    mean = flat.groupBy(topic, "_i").agg(F.avg(F.col("_x").cast("double")).alias("_m"))
    return mean.groupBy(topic).agg(F.transform(F.array_sort(F.collect_list(F.struct("_i", "_m"))), lambda s: s["_m"]).alias("centroid"))


def diverse_representatives(rows: DataFrame, topic: str, key: str, vector: str, top: int, diversity: float = 0.1, most: int = 20_000) -> DataFrame:
    """topic, rank, key: representatives by maximal marginal relevance to the topic's mean; ties go to the smaller key, a number.

    A member's value is (1 - d) * near - d * alike, with alike from -1 to 1. One of the `top` nearest is always left, so whoever is nearer
    by less than 2 d / (1 - d) than the last of these can't be picked, and the others hold the whole answer. Topics with up to `most` of
    them are picked each in a task; in larger ones Spark looks for the best member of all topics in each of `top` rounds, of which
    the driver keeps a row a topic.
    """
    from ..functions import rules

    names = F.col(topic).cast("long").alias("topic"), F.col(key).cast("long").alias("key"), F.col(vector).alias("v")
    unit = unit_vectors(rows.select(topic, key, vector), vector)
    mean = centroids(rows, topic, vector)
    held = unit.join(F.broadcast(mean), topic).select(*names, F.round(rules.cosine(F.col(vector), F.col("centroid")), 9).alias("near"))  # a row a topic
    place = F.row_number().over(Window.partitionBy("topic").orderBy(F.desc("near"), "key"))
    last = held.select("topic", "key", "near").withColumn("_r", place).where(F.col("_r") <= top).groupBy("topic").agg(F.min("near").alias("_last"))
    able = held.join(F.broadcast(last), "topic").where(F.col("near") >= F.col("_last") - 2 * diversity / (1 - diversity) - 1e-6).drop("_last").checkpoint()
    size = able.groupBy("topic").agg(F.count(F.lit(1)).alias("_n"))
    few = able.join(F.broadcast(size.where(F.col("_n") <= most)), "topic", "left_semi")
    many = able.join(F.broadcast(size.where(F.col("_n") > most)), "topic", "left_semi")

    def pick(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values("key", ignore_index=True)
        v, near = np.stack(g["v"].to_numpy()), g["near"].to_numpy()
        chosen: list[int] = []
        alike = np.full(len(g), -1.0)
        while len(chosen) < min(top, len(g)):
            value = (1 - diversity) * near - (diversity * alike if chosen else 0.0)
            value[chosen] = -np.inf
            chosen.append(int(np.argmax(np.round(value, 9))))
            alike = np.maximum(alike, v @ v[chosen[-1]])
        return pd.DataFrame({"topic": g["topic"].iloc[0], "rank": range(1, len(chosen) + 1), "key": g["key"].to_numpy()[chosen]})

    return few.groupBy("topic").applyInPandas(pick, "topic long, rank long, key long").unionByName(_picked_in_rounds(many, top, diversity))


def _picked_in_rounds(members: DataFrame, top: int, diversity: float) -> DataFrame:
    """diverse_representatives() of topics too large for a task: members has topic, key, v, near."""
    from ..functions import rules

    spark, out = members.sparkSession, []
    chosen: dict[int, tuple[list[int], list[list[float]]]] = {}
    for r in range(1, top + 1):
        if r == 1:
            left, value = members, (1 - diversity) * F.col("near")
        else:
            told = spark.createDataFrame([(t, *c) for t, c in chosen.items()], "topic long, keys array<long>, vs array<array<double>>")
            left = members.join(F.broadcast(told), "topic").where(~F.array_contains("keys", F.col("key")))
            value = (1 - diversity) * F.col("near") - diversity * F.array_max(F.transform("vs", lambda u: rules.dot(F.col("v"), u)))
        best = left.groupBy("topic").agg(F.max_by(F.struct("key", "v"), F.struct(F.round(value, 9), -F.col("key"))).alias("b"))
        picks = best.select("topic", "b.key", "b.v").collect()  # a row a topic
        if not picks:
            break
        for p in picks:
            keys, vs = chosen.setdefault(p["topic"], ([], []))
            keys.append(p["key"])
            vs.append(p["v"])
            out.append((p["topic"], r, p["key"]))
    return spark.createDataFrame(out, "topic long, rank long, key long")


#: Over how many rows a cluster needs how many members.
LEAST_MEMBERS = ((1_000_000, 200), (100_000, 50), (0, 10))


def cluster_topics(rows: DataFrame, key: str, vector: str, topics: int, sample: int = 100_000, seed: int = 7) -> DataFrame:
    """key, topic: topics numbered from 0 by falling size; -1 for rows in no topic.

    A sample of at most `sample` rows, the least hashes of their keys, is split in two again and again, the largest divisible cluster
    first, up to `topics` leaves; all rows then go to the leaf they are nearest to. By the number of all rows a leaf needs so
    many members (LEAST_MEMBERS), else its rows are in no topic, as are rows without a direction (null, empty or zero vectors).
    """
    from pyspark.ml.clustering import BisectingKMeans
    from pyspark.ml.functions import array_to_vector

    unit = unit_vectors(rows.select(key, vector), vector).select(key, array_to_vector(vector).alias("features"))
    n = unit.count()
    none = F.lit(-1).cast("long").alias("topic")
    if not n:
        return rows.select(key, none)
    fitted = (unit if n <= sample else unit.orderBy(F.md5(F.concat_ws(":", F.col(key), F.lit(seed))), key).limit(sample)).checkpoint()  # read again in every split
    least = next(members for total, members in LEAST_MEMBERS if n > total)
    share = min(1.0, sample / n)  # of a cluster's rows, in the sample
    model = BisectingKMeans(k=topics, seed=seed, maxIter=20, minDivisibleClusterSize=max(1.0, 2 * least * share)).fit(fitted)
    made = model.transform(unit).select(key, "prediction")
    size = made.groupBy("prediction").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least)
    rank = size.select("prediction", (F.row_number().over(Window.orderBy(F.desc("n"), "prediction")) - 1).cast("long").alias("topic"))  # a row a leaf
    told = made.join(F.broadcast(rank), "prediction", "left").select(key, F.coalesce("topic", F.lit(-1)).alias("topic"))
    return rows.select(key).join(told, key, "left").select(key, F.coalesce("topic", F.lit(-1)).alias("topic"))


def align_vectors(ids: DataFrame, vectors: DataFrame, batch: str, key: str) -> tuple[DataFrame, DataFrame]:
    """ids with their vectors, joined by batch and key, of batches that hold as many of both; and batch, ids, vectors of all others."""
    one = F.count(F.lit(1))
    both = ids.groupBy(batch).agg(one.alias("ids")).join(vectors.groupBy(batch).agg(one.alias("vectors")), batch, "full").fillna(0, ["ids", "vectors"])
    equal = F.col("ids") == F.col("vectors")
    return ids.join(both.where(equal).select(batch), batch, "left_semi").join(vectors, [batch, key]), both.where(~equal)
