"""Bit sections, unseen species, cached results and models over posts, comments and embeddings."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import ids, rules
from ..operators import coverage, models
from .joins_windows import INTERVALS, SEGMENTS_SQL
from .registry import query

c = F.col
R = lambda x, n=4: F.round(x, n)


def one():
    return F.count(F.lit(1))


@query("fixed_sections", "SELECT w AS width, o AS start, (id >> o) & ((1 << w) - 1) AS x, count(*) AS n FROM posts, (SELECT unnest([1, 2, 4, 8]) AS w), (SELECT unnest(range(0, 32)) AS o) WHERE o % w = 0 GROUP BY 1, 2, 3")
def _(v):
    places = F.array(*[F.struct(F.lit(w).alias("width"), F.lit(o).cast("long").alias("start")) for w in (1, 2, 4, 8) for o in range(0, 32, w)])
    rows = v.posts.select("id", F.inline(places))
    x = F.expr("shiftright(id, cast(start as int)) & (shiftleft(1L, width) - 1)")
    return rows.select("width", "start", x.alias("x")).groupBy("width", "start", "x").agg(one().alias("n"))


@query("coverage_combinations", SEGMENTS_SQL + """, p AS (SELECT segment, n, sum(n) OVER (PARTITION BY segment ORDER BY n DESC, x ROWS UNBOUNDED PRECEDING) - n AS before, sum(n) OVER (PARTITION BY segment) AS t FROM s), k AS (SELECT segment, count(*) AS needed FROM p WHERE before * 10 < t * 9 GROUP BY segment)
 SELECT segment, needed, CAST((SELECT product(needed) FROM k) AS BIGINT) AS combinations FROM k""")
def _(v):
    """The fewest values of each interval that reach nine tenths of all posts, and how many combinations they make."""
    k = coverage.needed_values(coverage.interval_counts(v.posts, "id", INTERVALS), 9, 10)
    return k.crossJoin(F.broadcast(k.agg(F.product("needed").cast("long").alias("combinations")))).select("segment", "needed", "combinations")  # one row


SPECIES = "WITH s AS (SELECT count(*) AS r FROM posts GROUP BY id & 4194303), n AS (SELECT r, count(*) AS f FROM s GROUP BY r) "


def species(v):
    return coverage.counts_of_counts(v.posts.select(ids.suffix(c("id")).alias("s")), "s").toDF("r", "f")


@query("richness_ace", SPECIES + """, a AS (SELECT coalesce(sum(f) FILTER (WHERE r <= 10), 0) AS rare, coalesce(sum(f) FILTER (WHERE r > 10), 0) AS common, coalesce(sum(r * f) FILTER (WHERE r <= 10), 0) AS held,
 coalesce(sum(f) FILTER (WHERE r = 1), 0) AS f1, coalesce(sum(r * (r - 1) * f) FILTER (WHERE r <= 10), 0) AS pairs FROM n), g AS (SELECT *, 1 - f1 / held AS known FROM a)
 SELECT CASE WHEN known > 0 THEN round(common + rare / known + f1 / known * greatest(rare / known * pairs / (held * (held - 1)) - 1, 0), 4) END AS ace FROM g""")
def _(v):
    rare = c("r") <= 10
    total = lambda x, when: F.coalesce(F.sum(F.when(when, x)), F.lit(0))
    a = species(v).agg(total(c("f"), rare).alias("rare"), total(c("f"), ~rare).alias("common"), total(c("r") * c("f"), rare).alias("held"),
                       total(c("f"), c("r") == 1).alias("f1"), total(c("r") * (c("r") - 1) * c("f"), rare).alias("pairs"))
    a = a.withColumn("known", F.try_subtract(F.lit(1.0), F.try_divide("f1", "held")))
    spread = F.greatest(F.try_divide(c("rare") / c("known") * c("pairs"), c("held") * (c("held") - 1)) - 1, F.lit(0.0))
    return a.select(F.when(c("known") > 0, R(c("common") + c("rare") / c("known") + c("f1") / c("known") * spread)).alias("ace"))


@query("win_neighbour_interp", SPECIES + "SELECT r, round(CASE WHEN lead(r) OVER w IS NULL THEN f / (r - coalesce(lag(r) OVER w, 0)) ELSE 2 * f / (lead(r) OVER w - coalesce(lag(r) OVER w, 0)) END, 4) AS z FROM n WINDOW w AS (ORDER BY r)")
def _(v):
    w = Window.orderBy("r")  # one row a distinct count
    low, high = F.coalesce(F.lag("r").over(w), F.lit(0)), F.lead("r").over(w)
    return species(v).select("r", R(F.when(high.isNull(), c("f") / (c("r") - low)).otherwise(2 * c("f") / (high - low))).alias("z"))





def vectors(v):
    from pyspark.ml.functions import array_to_vector

    return v.table("embeddings").select("vec_id", c("label").cast("double").alias("topic"), array_to_vector(c("embedding").cast("array<double>")).alias("features"))


@query("project_2d")
def _(v):
    """Principal components, not the reference's neighbour graph layout."""
    from pyspark.ml.feature import PCA
    from pyspark.ml.functions import vector_to_array

    e = vectors(v)
    xy = vector_to_array("xy")
    return PCA(k=2, inputCol="features", outputCol="xy").fit(e).transform(e).select("vec_id", xy[0].alias("x"), xy[1].alias("y"))


@query("cluster_topics")
def _(v):
    """Topics of all vectors, from splits of a sample."""
    return models.cluster_topics(v.table("embeddings"), "vec_id", "embedding", 8)
