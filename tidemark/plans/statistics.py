"""Overlap, significance, regression, classifier and topic queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import rules
from ..operators import counts, estimators, models, stats
from .registry import query

c = F.col
R = lambda x, n=4: F.round(x, n)


def one():
    return F.count(F.lit(1))


def seeded(key: str, seed: int = 7):
    """An order of keys that is random and the same in every run."""
    return F.md5(F.concat_ws(":", key, F.lit(seed)))


CENTROIDS = """WITH m AS (SELECT label, i, avg(x) AS x FROM (SELECT label, CAST(unnest(embedding) AS DOUBLE) AS x, unnest(range(len(embedding))) AS i FROM embeddings) GROUP BY 1, 2),
 t AS (SELECT label AS topic, list(x ORDER BY i) AS e FROM m GROUP BY label)"""


@query("overlap_jaccard", """WITH s AS (SELECT DISTINCT loc, k FROM posts), n AS (SELECT loc, count(*) AS n FROM s GROUP BY loc), p AS (SELECT a.loc AS a, b.loc AS b, count(*) AS shared FROM s a JOIN s b ON a.k = b.k AND a.loc < b.loc GROUP BY 1, 2)
 SELECT a, b, round(shared / (x.n + y.n - shared), 4) AS jaccard FROM p JOIN n x ON a = x.loc JOIN n y ON b = y.loc""")
def _(v):
    s = v.posts.select("loc", "k").distinct()
    n = counts.value_counts(s, ["loc"])
    a, b = s.select(c("loc").alias("a"), "k"), s.select(c("loc").alias("b"), "k")
    p = a.join(b, "k").where("a < b").groupBy("a", "b").agg(one().alias("both"))
    return p.join(n.toDF("a", "x"), "a").join(n.toDF("b", "y"), "b").select("a", "b", R(c("both") / (c("x") + c("y") - c("both"))).alias("jaccard"))


@query("overlap_jensen_shannon", """WITH n AS (SELECT loc, k, count(*) AS n FROM posts GROUP BY 1, 2), p AS (SELECT loc, k, n / sum(n) OVER (PARTITION BY loc) AS p FROM n),
 g AS (SELECT x.loc AS a, y.loc AS b, x.p AS p, q.p AS q FROM p x JOIN (SELECT DISTINCT loc FROM p) y ON x.loc < y.loc LEFT JOIN p q ON q.loc = y.loc AND q.k = x.k
  UNION ALL SELECT x.loc, y.loc, NULL, y.p FROM p y JOIN (SELECT DISTINCT loc FROM p) x ON x.loc < y.loc ANTI JOIN p q ON q.loc = x.loc AND q.k = y.k)
 SELECT a, b, round(1 - sqrt(greatest(sum(coalesce(p * ln(p / ((coalesce(p, 0) + coalesce(q, 0)) / 2)), 0) + coalesce(q * ln(q / ((coalesce(p, 0) + coalesce(q, 0)) / 2)), 0)) / 2, 0)), 4) AS overlap FROM g GROUP BY a, b""")
def _(v):
    n = counts.value_counts(v.posts, ["loc", "k"])
    p = n.join(n.groupBy("loc").agg(F.sum("n").alias("t")), "loc").select("loc", "k", (c("n") / c("t")).alias("p"))
    names = p.select("loc").distinct()
    pairs = names.select(c("loc").alias("a")).join(F.broadcast(names.select(c("loc").alias("b"))), c("a") < c("b"))  # countries only
    both = p.select(c("loc").alias("a"), "k", "p").join(p.select(c("loc").alias("b"), "k", c("p").alias("q")), "k").where("a < b")
    m = (c("p") + c("q")) / 2
    shared = both.groupBy("a", "b").agg(F.sum(c("p") * F.ln(c("p") / m) + c("q") * F.ln(c("q") / m)).alias("s"), F.sum(c("p") + c("q")).alias("mass"))
    apart = (2 - F.coalesce("mass", F.lit(0.0))) * F.ln(F.lit(2.0))  # what only one of two has adds its share times ln 2
    divergence = F.greatest((F.coalesce("s", F.lit(0.0)) + apart) / 2, F.lit(0.0))
    return pairs.join(shared, ["a", "b"], "left").select("a", "b", R(1 - F.sqrt(divergence)).alias("overlap"))


@query("error_category_share", "SELECT m AS message, count(*) FILTER (WHERE contains(status_msg, m)) AS n, round(count(*) FILTER (WHERE contains(status_msg, m)) * 100.0 / count(*), 4) AS percent FROM posts, (SELECT unnest(['status', 'item', 'self']) AS m) GROUP BY m")
def _(v):
    rows = v.posts.select("status_msg", F.explode(F.array(*map(F.lit, ("status", "item", "self")))).alias("message"))
    n = F.count_if(c("status_msg").contains(c("message")))
    return rows.groupBy("message").agg(n.alias("n"), R(n * 100.0 / one()).alias("percent"))


GROUPS = "avg(plays) FILTER (WHERE {0}) AS m{1}, var_samp(plays) FILTER (WHERE {0}) AS v{1}, count(plays) FILTER (WHERE {0}) AS n{1}"


def p_value_sql(t: str, dof: str) -> str:
    """stats.t_p_value() in SQL."""
    end, n = f"least(pi() / 2, 40 / sqrt({dof}))", stats.STEPS
    start = f"least(atan(abs({t}) / sqrt({dof})), {end})"
    part = lambda low: (f"(({end}) - ({low})) * list_sum(list_transform(range(0, {n + 1}), lambda i: CASE WHEN i IN (0, {n}) THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END"  # noqa: E731
                        f" * pow(greatest(cos(({low}) + i * ((({end}) - ({low})) / {n})), 0), ({dof}) - 1)))")
    return f"round({part(start)} / ({part('0')}), 6)"


@query("ttest_welch", f"""WITH a AS (SELECT {GROUPS.format('k < 10', 'a')}, {GROUPS.format('TRUE', 'b')} FROM posts),
 r AS (SELECT (ma - mb) / sqrt(va / na + vb / nb) AS t, pow(va / na + vb / nb, 2) / (pow(va / na, 2) / (na - 1) + pow(vb / nb, 2) / (nb - 1)) AS dof FROM a)
 SELECT round(t, 4) AS t, round(dof, 4) AS dof, {p_value_sql('t', 'dof')} AS p FROM r""")
def _(v):
    return stats.t_test(v.posts, c("plays"), c("k") < 10, F.lit(True))


@query("ttest_pooled", f"""WITH a AS (SELECT {GROUPS.format('minute(ts) = 0', 'a')}, {GROUPS.format('minute(ts) <> 0', 'b')} FROM posts),
 r AS (SELECT (ma - mb) / sqrt(((na - 1) * va + (nb - 1) * vb) / (na + nb - 2) * (1.0 / na + 1.0 / nb)) AS t, CAST(na + nb - 2 AS DOUBLE) AS dof FROM a)
 SELECT round(t, 4) AS t, round(dof, 4) AS dof, {p_value_sql('t', 'dof')} AS p FROM r""")
def _(v):
    zero = F.minute("ts") == 0
    return stats.t_test(v.posts, c("plays"), zero, ~zero, True)


LOCS = "WITH g AS (SELECT loc, count(*) AS n, max(population) AS population, max(young_share) AS young, max(coverage) AS coverage FROM posts JOIN countries USING (loc) GROUP BY loc) "


def by_country(v):
    return counts.value_counts(v.posts, ["loc"]).join(F.broadcast(v.countries), "loc")


@query("regress_loglog", LOCS + "SELECT round(regr_slope(ln(n), ln(population)), 6) AS slope, round(regr_intercept(ln(n), ln(population)), 6) AS intercept, round(regr_r2(ln(n), ln(population)), 6) AS r2 FROM g")
def _(v):
    return stats.regress(by_country(v), F.ln("n"), F.ln("population"))


@query("regress_linear", LOCS + "SELECT round(regr_slope(n, young), 6) AS slope, round(regr_intercept(n, young), 6) AS intercept, round(regr_r2(n, young), 6) AS r2 FROM g WHERE n >= 50")
def _(v):
    return stats.regress(by_country(v).where("n >= 50"), c("n"), c("young_share"))


@query("regress_log_x", "SELECT round(regr_slope(k, ln(plays)), 6) AS slope, round(regr_intercept(k, ln(plays)), 6) AS intercept, round(regr_r2(k, ln(plays)), 6) AS r2 FROM posts WHERE plays > 0")
def _(v):
    return stats.regress(v.posts.where("plays > 0"), c("k"), F.ln("plays"))


@query("residual_outliers", LOCS + ", l AS (SELECT regr_slope(ln(n), ln(population)) AS s, regr_intercept(ln(n), ln(population)) AS i FROM g), r AS (SELECT loc, round(ln(n) - s * ln(population) - i, 4) AS residual FROM g, l) (SELECT * FROM r ORDER BY residual DESC, loc LIMIT 3) UNION (SELECT * FROM r ORDER BY residual, loc LIMIT 3)")
def _(v):
    r = stats.residuals(by_country(v), F.ln("n"), F.ln("population")).select("loc", R(c("residual")).alias("residual"))
    return counts.top_k(r, [F.desc("residual"), "loc"], 3).union(counts.top_k(r, ["residual", "loc"], 3)).distinct()


@query("per_capita", LOCS + "SELECT loc, round(n / coverage * 60 / population, 8) AS per_head FROM g")
def _(v):
    return by_country(v).select("loc", R(c("n") / c("coverage") * 60 / c("population"), 8).alias("per_head"))


@query("demographic_ratio", "SELECT loc, round(avg(CASE WHEN k < 20 THEN 1.0 ELSE 0.0 END) / max(young_share), 4) AS ratio FROM posts JOIN countries USING (loc) GROUP BY loc")
def _(v):
    share = v.posts.groupBy("loc").agg(F.avg(F.when(c("k") < 20, 1.0).otherwise(0.0)).alias("s"))
    return share.join(F.broadcast(v.countries), "loc").select("loc", R(c("s") / c("young_share")).alias("ratio"))


@query("fetch_cost", "SELECT (max(create_s) - min(create_s)) AS span_s, round((max(create_s) - min(create_s)) / 3600 * 4 * 0.013368 + (max(create_s) - min(create_s)) / 3600 * 8 * 0.0014595, 4) AS cost FROM posts")
def _(v):
    hours = (F.max("create_s") - F.min("create_s")) / 3600
    return v.posts.agg((F.max("create_s") - F.min("create_s")).alias("span_s"), R(hours * 4 * 0.013368 + hours * 8 * 0.0014595).alias("cost"))


@query("predictor_confusion", "SELECT a, b, l, count(x) AS n FROM (SELECT unnest([FALSE, TRUE]) AS a), (SELECT unnest([FALSE, TRUE]) AS b), (SELECT unnest([FALSE, TRUE]) AS l) LEFT JOIN (SELECT prob > 0.5 AS pa, prob2 > 0.5 AS pb, label = 1 AS pl, 1 AS x FROM predictions) ON a = pa AND b = pb AND l = pl GROUP BY 1, 2, 3")
def _(v):
    grid = v.spark.range(8).select(*[(F.floor(c("id") / d) % 2 == 1).alias(x) for x, d in (("a", 1), ("b", 2), ("l", 4))])
    n = v.predictions.select((c("prob") > 0.5).alias("a"), (c("prob2") > 0.5).alias("b"), (c("label") == 1).alias("l")).groupBy("a", "b", "l").agg(one().alias("n"))
    return grid.join(n, ["a", "b", "l"], "left").fillna(0, ["n"])


CONF = "count(*) FILTER (WHERE label = 1 AND {0}) AS tp, count(*) FILTER (WHERE label <> 1 AND {0}) AS fp, count(*) FILTER (WHERE label = 1 AND NOT {0}) AS fn, count(*) FILTER (WHERE label <> 1 AND NOT {0}) AS tn"


@query("classification_metrics", f"WITH m AS (SELECT {CONF.format('(prob > 0.43)')} FROM predictions) SELECT round((tp + tn) / (tp + fp + fn + tn), 4) AS accuracy, round(tp / (tp + fp), 4) AS precision, round(tp / (tp + fn), 4) AS recall, round(2 * tp / (2 * tp + fp + fn), 4) AS f1 FROM m")
def _(v):
    return stats.measures(stats.confusion(v.predictions, c("label") == 1, c("prob") > 0.43))


@query("threshold_sweep", f"WITH t AS (SELECT unnest(range(20)) AS i), m AS (SELECT i, {CONF.format('(prob > CAST(0.3 AS DOUBLE) + i * CAST(0.03 AS DOUBLE))')} FROM predictions, t GROUP BY i) SELECT i, round(2 * tp / (2 * tp + fp + fn), 4) AS f1 FROM m")
def _(v):
    rows = v.predictions.withColumn("i", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(19).cast("long"))))
    return stats.measures(stats.confusion(rows, c("label") == 1, c("prob") > F.lit(0.3) + c("i") * 0.03, ["i"]), ["i"]).select("i", "f1")


@query("misclassified", "SELECT doc_id, CASE WHEN label = 1 THEN 'false negative' ELSE 'false positive' END AS kind FROM predictions WHERE (label = 1) <> (prob > 0.43)")
def _(v):
    wrong = (c("label") == 1) != (c("prob") > 0.43)
    return v.predictions.where(wrong).select("doc_id", F.when(c("label") == 1, "false negative").otherwise("false positive").alias("kind"))


@query("label_annotations", "SELECT d.doc_id, coalesce(l.toxic, -1) AS y FROM documents d LEFT JOIN (SELECT doc_id, max(toxic) AS toxic FROM labels WHERE quality IN (0, 1) GROUP BY doc_id) l ON d.doc_id = l.doc_id")
def _(v):
    valid = v.table("labels").where(c("quality").isin(0, 1)).groupBy("doc_id").agg(F.max("toxic").alias("y"))
    return v.table("documents").select("doc_id").join(valid, "doc_id", "left").fillna({"y": -1})


@query("expand_frames", "SELECT doc_id, unnest(range(1 + doc_id % 4)) AS frame FROM labels")
def _(v):
    return v.table("labels").select("doc_id", F.explode(F.sequence(F.lit(0).cast("long"), c("doc_id") % 4)).alias("frame"))


#: Topics are the labels of vectors; a description is a nation's name and those of the two after it.
TOPICS_SQL = """WITH d AS (SELECT CAST(a.n_nationkey AS BIGINT) AS topic, a.n_name || ' ' || b.n_name || ' ' || c.n_name AS description FROM nation a JOIN nation b ON b.n_nationkey = (a.n_nationkey + 1) % 25 JOIN nation c ON c.n_nationkey = (a.n_nationkey + 2) % 25 WHERE a.n_nationkey < 12),
 """


def topic_descriptions(v):
    n = v.table("nation").select(c("n_nationkey").cast("long").alias("topic"), "n_name")
    named = lambda k: n.select(F.pmod(c("topic") - k, F.lit(25)).alias("topic"), c("n_name").alias(f"n{k}"))
    rows = named(0).join(F.broadcast(named(1)), "topic").join(F.broadcast(named(2)), "topic")  # 25 rows
    return rows.where("topic < 12").select("topic", F.concat_ws(" ", "n0", "n1", "n2").alias("description"))


@query("topic_counts", TOPICS_SQL + "n AS (SELECT label, count(*) AS n FROM embeddings GROUP BY label) SELECT topic, description, coalesce(n, 0) AS n FROM d LEFT JOIN n ON topic = label")
def _(v):
    """Descriptions with counts anew; topics that have lost all their rows stay."""
    n = counts.value_counts(v.table("embeddings"), ["label"]).select(c("label").cast("long").alias("topic"), "n")
    return topic_descriptions(v).join(n, "topic", "left").fillna(0, ["n"]).select("topic", "description", "n")


#: Looked for in the descriptions of topics.
KEYWORDS = ("nation_3", "ion_1 ", "_9 nation_10", "none")


@query("topic_keyword_stats", TOPICS_SQL + f"""p AS (SELECT CAST(label AS BIGINT) AS topic, plays FROM posts JOIN embeddings ON vec_id = event_id), w AS (SELECT unnest({list(KEYWORDS)}) AS keyword),
 f AS (SELECT keyword, min(topic) AS topic FROM w JOIN d ON contains(lower(description), keyword) GROUP BY keyword),
 g AS (SELECT keyword, f.topic AS topic, {GROUPS.format('p.topic = f.topic', 'a')}, {GROUPS.format('TRUE', 'b')}, count(*) FILTER (WHERE p.topic = f.topic) AS n, count(*) AS total FROM f, p GROUP BY ALL),
 r AS (SELECT *, (ma - mb) / sqrt(va / na + vb / nb) AS t, pow(va / na + vb / nb, 2) / (pow(va / na, 2) / (na - 1) + pow(vb / nb, 2) / (nb - 1)) AS dof FROM g)
 SELECT keyword, topic, n, round(100.0 * n / total, 4) AS percent, round(ma, 4) AS mean, round(t, 4) AS t, round(dof, 4) AS dof, {p_value_sql('t', 'dof')} AS p FROM r""")
def _(v):
    """The first topic whose description has each keyword: its share of posts, their number and mean plays, and how far that is from all posts' mean."""
    words = v.spark.createDataFrame([(k,) for k in KEYWORDS], "keyword string")
    found = topic_descriptions(v).join(F.broadcast(words), F.lower("description").contains(c("keyword"))).groupBy("keyword").agg(F.min("topic").alias("topic"))
    p = v.posts.join(v.table("embeddings").select(c("vec_id").alias("event_id"), c("label").cast("long").alias("_topic")), "event_id").select("_topic", "plays")
    same = c("_topic") == c("topic")
    g = p.crossJoin(F.broadcast(found)).groupBy("keyword", "topic").agg(  # a row a keyword
        *stats.moments(c("plays"), same, "a"), *stats.moments(c("plays"), F.lit(True), "b"), F.count_if(same).alias("n"), one().alias("total"))
    kept = ["keyword", "topic", "n", R(100.0 * c("n") / c("total")).alias("percent"), R(c("m_a")).alias("mean")]
    held = g.select("*", *kept[3:])
    return stats.t_of(held, keep=["keyword", "topic", "n", "percent", "mean"])


@query("topic_distributions", "SELECT label, k % 5 AS bucket, count(*) AS n FROM posts JOIN embeddings ON vec_id = event_id GROUP BY 1, 2")
def _(v):
    t = v.table("embeddings").select(c("vec_id").alias("event_id"), "label")
    return v.posts.join(t, "event_id").groupBy("label", (c("k") % 5).alias("bucket")).agg(one().alias("n"))


@query("topic_centroids", "SELECT label, i, round(avg(x), 4) + 0.0 AS mean FROM (SELECT label, unnest(embedding) AS x, unnest(range(1, len(embedding) + 1)) AS i FROM embeddings) GROUP BY 1, 2")
def _(v):
    flat = v.table("embeddings").select("label", F.posexplode("embedding").alias("i", "x"))
    return flat.groupBy("label", (c("i") + 1).cast("long").alias("i")).agg((R(F.avg(c("x").cast("double"))) + 0.0).alias("mean"))


@query("cosine_nearest_topic", CENTROIDS + """, s AS (SELECT v.vec_id, t.topic, list_dot_product(CAST(v.embedding AS DOUBLE[]), t.e) / sqrt(list_dot_product(CAST(v.embedding AS DOUBLE[]), CAST(v.embedding AS DOUBLE[])) * list_dot_product(t.e, t.e)) AS c FROM embeddings v, t)
 SELECT vec_id, topic FROM (SELECT vec_id, topic, row_number() OVER (PARTITION BY vec_id ORDER BY round(c, 8) DESC, topic) AS rn FROM s) WHERE rn = 1""")
def _(v):
    """Of all topics the one whose mean is nearest."""
    e = v.table("embeddings")
    t = models.centroids(e, "label", "embedding").toDF("topic", "e")
    s = e.select("vec_id", "embedding").crossJoin(F.broadcast(t)).select("vec_id", "topic", F.round(rules.cosine(c("embedding"), c("e")), 8).alias("s"))  # a row a topic
    return s.groupBy("vec_id").agg(F.max_by("topic", F.struct("s", -c("topic"))).alias("topic"))


@query("class_tfidf", """WITH w AS (SELECT lang, unnest(regexp_extract_all(lower(text), '[a-z]+')) AS t FROM documents), n AS (SELECT lang, t, count(*) AS tf FROM w GROUP BY 1, 2), f AS (SELECT t, sum(tf) AS f FROM n GROUP BY t), a AS (SELECT avg(z) AS a FROM (SELECT sum(tf) AS z FROM n GROUP BY lang)),
 s AS (SELECT n.lang, n.t, round(tf * ln(1 + a / f), 3) AS score FROM n JOIN f USING (t), a) SELECT lang, t, score FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, t) AS rn FROM s) WHERE rn <= 10""")
def _(v):
    from pyspark.sql import Window

    w = v.table("documents").select("lang", F.explode(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]+"), F.lit(0))).alias("t"))
    n = w.groupBy("lang", "t").agg(one().alias("tf"))
    f = n.groupBy("t").agg(F.sum("tf").alias("f"))
    a = n.groupBy("lang").agg(F.sum("tf").alias("z")).agg(F.avg("z").alias("a"))
    s = n.join(f, "t").crossJoin(F.broadcast(a)).select("lang", "t", R(c("tf") * F.ln(1 + c("a") / c("f")), 3).alias("score"))
    rn = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("score"), "t"))
    return s.withColumn("rn", rn).where("rn <= 10").drop("rn")


@query("zero_shot_scores", CENTROIDS + """, s AS (SELECT v.vec_id, t.topic, exp(5 * list_dot_product(CAST(v.embedding AS DOUBLE[]), t.e) / sqrt(list_dot_product(CAST(v.embedding AS DOUBLE[]), CAST(v.embedding AS DOUBLE[])) * list_dot_product(t.e, t.e))) AS x FROM embeddings v, t),
 p AS (SELECT vec_id, topic, x / sum(x) OVER (PARTITION BY vec_id) AS p FROM s)
 SELECT vec_id, round(avg(CASE WHEN topic < 5 THEN p END) / (avg(CASE WHEN topic < 5 THEN p END) + avg(CASE WHEN topic >= 5 THEN p END)), 4) AS score, arg_max(topic, (round(p, 8), -topic)) AS best FROM p GROUP BY vec_id""")
def _(v):
    """Prompts are the topics' mean vectors, those of topics 0 to 4 positive; vectors and prompts are normalised, their scaled products go through a softmax."""
    e = v.table("embeddings")
    p = models.centroids(e, "label", "embedding").toDF("topic", "e")
    s = e.select("vec_id", "embedding").crossJoin(F.broadcast(p)).select("vec_id", "topic", F.exp(5 * rules.cosine(c("embedding"), c("e"))).alias("x"))  # a row a topic
    own = s.groupBy("vec_id").agg(F.sum("x").alias("all"), F.avg(F.when(c("topic") < 5, c("x"))).alias("pos"), F.avg(F.when(c("topic") >= 5, c("x"))).alias("neg"),
                                  F.collect_list(F.struct("x", "topic")).alias("each"))  # as many as topics
    share = lambda x: F.struct(F.round(x["x"] / c("all"), 8).alias("p"), (-x["topic"]).alias("t"))
    return own.select("vec_id", R(c("pos") / c("all") / (c("pos") / c("all") + c("neg") / c("all"))).alias("score"), (-F.array_max(F.transform("each", share))["t"]).alias("best"))


@query("dedup_embeddings", "WITH u AS (SELECT vec_id, embedding FROM embeddings UNION ALL SELECT vec_id + 1000000, embedding FROM embeddings) SELECT min(vec_id) AS vec_id FROM u GROUP BY embedding")
def _(v):
    e = v.table("embeddings").select("vec_id", "embedding")
    both = e.unionByName(e.select((c("vec_id") + 1000000).alias("vec_id"), "embedding"))
    return both.groupBy("embedding").agg(F.min("vec_id").alias("vec_id")).select("vec_id")


@query("align_embeddings", """WITH i AS (SELECT event_id AS id, event_id // 50 AS batch FROM events), e AS (SELECT vec_id, vec_id // 50 AS batch, embedding FROM embeddings WHERE vec_id % 97 > 0),
 b AS (SELECT coalesce(x.batch, y.batch) AS batch, coalesce(n, 0) AS ids, coalesce(m, 0) AS vectors FROM (SELECT batch, count(*) AS n FROM i GROUP BY batch) x FULL JOIN (SELECT batch, count(*) AS m FROM e GROUP BY batch) y ON x.batch = y.batch)
 SELECT 'aligned' AS side, b.batch AS batch, i.id AS id, round(CAST(embedding[1] AS DOUBLE), 5) AS x FROM b JOIN i ON b.batch = i.batch JOIN e ON i.batch = e.batch AND i.id = e.vec_id WHERE ids = vectors
 UNION ALL SELECT 'quarantine', batch, NULL, NULL FROM b WHERE ids <> vectors""")
def _(v):
    """Vectors by id for batches that have as many vectors as ids; the numbers of others."""
    ids = v.table("events").select(c("event_id").alias("id"), F.floor(c("event_id") / 50).alias("batch"))
    vectors = v.table("embeddings").where("vec_id % 97 > 0").select(c("vec_id").alias("id"), F.floor(c("vec_id") / 50).alias("batch"), "embedding")
    joined, quarantine = models.align_vectors(ids, vectors, "batch", "id")
    aligned = joined.select(F.lit("aligned").alias("side"), "batch", "id", R(c("embedding")[0].cast("double"), 5).alias("x"))
    return aligned.unionByName(quarantine.select(F.lit("quarantine").alias("side"), "batch"), allowMissingColumns=True)


@query("sample_n", "SELECT id, plays FROM posts ORDER BY md5(id || ':7'), id, plays LIMIT 500")
def _(v):
    return counts.top_k(v.posts.select("id", "plays"), [seeded("id"), "id", "plays"], 500)


@query("sample_per_class", "SELECT vec_id, label FROM (SELECT vec_id, label, row_number() OVER (PARTITION BY label ORDER BY md5(vec_id || ':7'), vec_id) AS rn FROM embeddings) WHERE rn <= 5")
def _(v):
    from pyspark.sql import Window

    rn = F.row_number().over(Window.partitionBy("label").orderBy(seeded("vec_id"), "vec_id"))
    return v.table("embeddings").select("vec_id", "label", rn.alias("rn")).where("rn <= 5").drop("rn")


@query("stratified_folds", "SELECT doc_id, toxic, CAST((row_number() OVER (PARTITION BY toxic ORDER BY md5(doc_id || ':7'), doc_id) - 1) % 5 AS INTEGER) AS fold FROM labels")
def _(v):
    """Folds that each label's rows are dealt to in turn, in a random order of keys; rows without a label are a label of their own."""
    ranked = estimators.numbered(v.table("labels").select("doc_id", "toxic"), ["toxic"], seeded("doc_id"), ["doc_id"])
    return ranked.select("doc_id", "toxic", (c("i") % 5).cast("int").alias("fold"))
