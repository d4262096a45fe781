"""Classifiers and regressions with held-out scores, representatives of topics."""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StringType, StructField, StructType

from ..functions import rules
from ..operators import models
from .registry import query

c = F.col
FOLDS = 5


def examples(v):
    """vec_id, y, features and fold; y is whether two components together are positive, as the given labels don't depend on the vectors."""
    from pyspark.ml.functions import array_to_vector

    e = v.table("embeddings")
    rows = e.select("vec_id", (c("embedding")[0] + c("embedding")[1] > 0.1).cast("double").alias("y"), array_to_vector(c("embedding").cast("array<double>")).alias("features"))
    return rows.withColumn("fold", models.fold("vec_id", FOLDS))


def logistic(**more):
    from pyspark.ml.classification import LogisticRegression

    return LogisticRegression(labelCol="y", regParam=0.01, maxIter=30, **more)


def forest():
    """A random forest, the nearest that MLlib has to extremely random trees."""
    from pyspark.ml.classification import RandomForestClassifier

    return RandomForestClassifier(labelCol="y", numTrees=20, maxDepth=5, seed=7)


def boosting():
    from pyspark.ml.classification import GBTClassifier

    return GBTClassifier(labelCol="y", maxIter=8, maxDepth=3, seed=7)


def held_out(v, learner, weigh=False):
    """Probabilities of rows of fold 0 by a model of the others."""
    rows = examples(v)
    train = rows.where("fold <> 0")
    model = learner.fit(models.balanced(train, "y") if weigh else train)
    return models.scored(model, rows.where("fold = 0")).select("vec_id", "y", "probability")


@query("train_logistic")
def _(v):
    """Class-balanced logistic regression, on rows that it hasn't seen."""
    return held_out(v, logistic(weightCol="weight"), True)


@query("train_forest")
def _(v):
    return held_out(v, forest())


@query("train_boosting")
def _(v):
    return held_out(v, boosting())


@query("train_stacking")
def _(v):
    """Logistic regression over out-of-fold probabilities of three learners, on rows that none of them has seen."""
    rows = examples(v)
    train = rows.where("fold <> 0").withColumn("fold", models.fold("vec_id", 3, 11))
    return models.stack(train, rows.where("fold = 0"), {"logistic": logistic(), "forest": forest(), "boosting": boosting()}, logistic(), "vec_id", "y", 3)


@query("cross_validate")
def _(v):
    return models.cross_validate(examples(v), logistic(), "y", FOLDS)


@query("batch_score")
def _(v):
    """A model of one fold's rows applied to all rows."""
    rows = examples(v)
    return models.scored(logistic().fit(rows.where("fold = 0")), rows).select("vec_id", "probability", (c("probability") > 0.43).cast("int").alias("predicted"))


@query("bit_dependence")
def _(v):
    return models.bit_dependence(v.posts.select((c("id").bitwiseAND(F.lit((1 << 32) - 1).cast("long"))).alias("w")), "w", 32)


@query("mmr_representatives")
def _(v):
    return models.diverse_representatives(v.table("embeddings"), "label", "vec_id", "embedding", 40)


#: Words of all classes up to which their values are broadcast.
MOST_WORDS = 1_000_000


@F.arrow_udf(ArrayType(StructType([StructField("t", StringType()), StructField("tf", LongType())])))
def word_counts(texts: pa.Array) -> pa.Array:
    """Each word of a-z in a text, and how often it is there."""
    each = [Counter(re.findall("[a-z]+", t or "")) for t in texts.to_pylist()]
    ends = np.cumsum([0, *map(len, each)])
    words = pa.array([t for x in each for t in x], pa.string())
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.StructArray.from_arrays([words, pa.array([n for x in each for n in x.values()], pa.int64())], ["t", "tf"]))


@query("representative_docs", """WITH w AS (SELECT doc_id, lang, unnest(regexp_extract_all(lower(text), '[a-z]+')) AS t FROM documents WHERE text IS NOT NULL), n AS (SELECT doc_id, lang, t, count(*) AS tf FROM w GROUP BY 1, 2, 3),
 k AS (SELECT lang, t, sum(tf) AS tf FROM n GROUP BY 1, 2), f AS (SELECT t, sum(tf) AS f FROM k GROUP BY t), a AS (SELECT avg(z) AS a FROM (SELECT sum(tf) AS z FROM k GROUP BY lang)),
 s AS (SELECT k.lang, k.t, k.tf * ln(1 + a / f) AS s FROM k JOIN f USING (t), a), d AS (SELECT n.doc_id, n.lang, round(sum(n.tf * s) / sqrt(sum(n.tf * n.tf)), 3) AS score FROM n JOIN s ON n.lang = s.lang AND n.t = s.t GROUP BY 1, 2)
 SELECT lang, doc_id, score FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, doc_id) AS rn FROM d) WHERE rn <= 3""")
def _(v):
    """The three documents of each language whose words lie closest to its class TF-IDF vector."""
    docs = v.table("documents").where("text is not null").select("doc_id", "lang", F.explode(word_counts(F.lower("text"))).alias("w")).select("doc_id", "lang", "w.t", "w.tf")
    k = docs.groupBy("lang", "t").agg(F.sum("tf").alias("ctf")).checkpoint()  # the words of each class, from one pass over the texts
    f = k.groupBy("t").agg(F.sum("ctf").alias("f"))
    a = k.groupBy("lang").agg(F.sum("ctf").alias("z")).agg(F.avg("z").alias("a"))
    s = k.join(f, "t").crossJoin(F.broadcast(a)).select("lang", "t", (c("ctf") * F.ln(1 + c("a") / c("f"))).alias("s"))
    s = F.broadcast(s) if k.count() <= MOST_WORDS else s
    n = docs.groupBy("doc_id", "lang", "t").agg(F.sum("tf").alias("tf"))
    d = n.join(s, ["lang", "t"]).groupBy("doc_id", "lang").agg(F.round(F.sum(c("tf") * c("s")) / F.sqrt(F.sum(c("tf") * c("tf"))), 3).alias("score"))
    rn = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("score"), "doc_id"))
    return d.withColumn("rn", rn).where("rn <= 3").select("lang", "doc_id", "score")
