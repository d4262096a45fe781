"""The chain from hashtags to a regression: vocabulary, sparse vectors, pruning, collinear pairs, coefficients."""

from __future__ import annotations

import functools

from pyspark.sql import functions as F

from ..functions import rules
from ..operators import features
from .registry import query

c = F.col
#: Hashtags that occur no more often are left out; so are columns that add up to less.
LEAST, LEAST_SUM, COLLINEAR = 50, 100, 0.8
#: Posts' tags, with some that always, nearly always and never go with others.
TAGS_SQL = f"""WITH d AS (SELECT event_id, descr || CASE WHEN k < 30 THEN ' #twin' || k ELSE '' END || CASE WHEN k = 3 AND event_id % 10 > 0 THEN ' #near3' ELSE '' END
  || CASE WHEN event_type <> 'click' THEN ' #rest #rest' ELSE '' END AS t FROM posts),
 tags AS (SELECT event_id, unnest(regexp_extract_all(t, '#[a-zA-Z0-9_]+')) AS feature FROM d),
 vocab AS (SELECT feature, n, row_number() OVER (ORDER BY n DESC, feature) - 1 AS idx FROM (SELECT feature, count(*) AS n FROM tags GROUP BY feature HAVING count(*) > {LEAST})),
 cells AS (SELECT event_id, idx, feature, count(*) AS x FROM tags JOIN vocab USING (feature) GROUP BY ALL),
 sums AS (SELECT idx, feature, sum(x) AS s, sum(x * x) AS q FROM cells GROUP BY ALL HAVING sum(x) >= {LEAST_SUM}) """


class Chain:
    """The steps over one scale's posts; what later steps read several times is kept in the shared checkpoint folder."""

    def __init__(self, v):
        self.v = v

    @functools.cached_property
    def tagged(self):
        more = F.concat(F.when(c("k") < 30, F.concat(F.lit(" #twin"), "k")).otherwise(""), F.when((c("k") == 3) & (c("event_id") % 10 > 0), " #near3").otherwise(""),
                        F.when(c("event_type") != "click", " #rest #rest").otherwise(""))
        return self.v.posts.select("event_id", "plays", "k", rules.hashtags(F.concat("descr", more)).alias("tags"))

    @functools.cached_property
    def vocab(self):
        return features.vocabulary(self.tagged, "tags", LEAST).checkpoint()

    @functools.cached_property
    def matrix(self):
        return features.matrix(self.tagged, "event_id", "tags", self.vocab)

    @functools.cached_property
    def pruned(self):
        m, kept = features.prune(self.matrix.checkpoint(), self.vocab, LEAST_SUM)
        return m.checkpoint(), kept.checkpoint()


def shown(m):
    """idx:x of each entry."""
    each = F.transform(F.arrays_zip("indices", "values"), lambda e: F.concat(e["indices"].cast("string"), F.lit(":"), e["values"].cast("long").cast("string")))
    return F.array_join(each, " ").alias("features")


@query("one_hot_hashtags", TAGS_SQL + """SELECT posts.event_id, coalesce(string_agg(idx || ':' || x, ' ' ORDER BY idx), '') AS features FROM posts LEFT JOIN cells ON posts.event_id = cells.event_id GROUP BY posts.event_id""")
def _(v):
    m = Chain(v).matrix
    return m.select("event_id", shown(m))


@query("one_hot_topics", """WITH t AS (SELECT vec_id, CASE WHEN vec_id % 11 > 0 THEN label END AS topic FROM embeddings), n AS (SELECT topic, row_number() OVER (ORDER BY count(*) DESC, CAST(topic AS VARCHAR)) - 1 AS idx FROM t WHERE topic IS NOT NULL GROUP BY topic)
 SELECT vec_id, coalesce(idx || ':1', '') AS features FROM t LEFT JOIN n ON t.topic = n.topic""")
def _(v):
    """A column for each topic there is, none for rows without one."""
    topic = F.when(c("vec_id") % 11 > 0, c("label").cast("string"))
    rows = v.table("embeddings").select("vec_id", F.filter(F.array(topic), lambda x: x.isNotNull()).alias("topics"))
    m = features.matrix(rows, "vec_id", "topics", features.vocabulary(rows, "topics", 0))
    return m.select("vec_id", shown(m))


@query("drop_rare_features", TAGS_SQL + "SELECT feature, row_number() OVER (ORDER BY idx) - 1 AS idx, CAST(s AS DOUBLE) AS total FROM sums")
def _(v):
    m, vocab = Chain(v).pruned
    return features.column_sums(m).select("idx", "total").join(vocab.select("idx", "feature"), "idx").select("feature", c("idx").cast("long").alias("idx"), "total")


@query("collinear_pairs", TAGS_SQL + f""", n AS (SELECT count(*) AS n FROM posts),
 dots AS (SELECT a.idx AS i, b.idx AS j, sum(a.x * b.x) AS dot FROM cells a JOIN cells b ON a.event_id = b.event_id AND a.idx < b.idx GROUP BY ALL),
 r AS (SELECT a.feature AS a, b.feature AS b, (n * coalesce(dot, 0) - a.s * b.s) / sqrt((n * a.q - a.s * a.s) * CAST(n * b.q - b.s * b.s AS DOUBLE)) AS r FROM n, sums a JOIN sums b ON a.idx < b.idx LEFT JOIN dots ON i = a.idx AND j = b.idx WHERE n * a.q > a.s * a.s AND n * b.q > b.s * b.s)
 SELECT a, b, round(r, 4) AS r FROM r WHERE abs(r) > {COLLINEAR}""")
def _(v):
    m, vocab = Chain(v).pruned
    name = lambda i: vocab.select(c("idx").alias(i), c("feature").alias({"i": "a", "j": "b"}[i]))
    pairs = features.correlated(m, COLLINEAR)
    return pairs.join(name("i"), "i").join(name("j"), "j").select("a", "b", F.round("r", 4).alias("r"))


@query("ols_engagement")
def _(v):
    """Standardised log plays on the standardised log of k and on all hashtags that are left; feature and value, the intercept and r2 among them."""
    chain = Chain(v)
    m, vocab = chain.pruned
    logs = chain.tagged.select("event_id", F.log1p("plays").alias("p"), F.log1p("k").alias("k"))
    mean = logs.agg(*[f(x).alias(f"{n}{x}") for x in ("p", "k") for n, f in (("m", F.avg), ("s", F.stddev_pop))])
    z = lambda x: ((c(x) - c(f"m{x}")) / c(f"s{x}")).alias(x)
    rows = m.join(logs.crossJoin(F.broadcast(mean)).select("event_id", z("p"), z("k")), "event_id")  # one row
    names = ["log k", *(r["feature"] for r in vocab.orderBy("idx").select("feature").collect())]  # columns of the system that the driver solves
    values, intercept, r2 = features.least_squares(features.with_dense(rows.where("k is not null"), {"k": c("k")}), "p", len(names))
    out = [*zip(names, map(float, values)), ("intercept", intercept), ("r2", r2)]
    return v.spark.createDataFrame(out, "feature string, value double").select("feature", F.round("value", 6).alias("value"))
