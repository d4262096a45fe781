"""Estimates from aggregates: species, bootstrap intervals, permutations, curves."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import ids
from ..operators import coverage, estimators
from .joins_windows import INTERVALS
from .registry import query

c = F.col
R = lambda x, n=4: F.round(x, n)


def one():
    return F.count(F.lit(1))


@query("good_turing_probs", """WITH n AS (SELECT r, count(*) AS species FROM (SELECT count(*) AS r FROM posts GROUP BY id & 4194303) GROUP BY r),
 z AS (SELECT r, species, 2 * species / (coalesce(lead(r) OVER w, 2 * r - coalesce(lag(r) OVER w, 0)) - coalesce(lag(r) OVER w, 0)) AS z, CASE WHEN lead(r) OVER w = r + 1 THEN lead(species) OVER w END AS n1 FROM n WINDOW w AS (ORDER BY r)),
 l AS (SELECT regr_slope(ln(z), ln(r)) AS b, sum(r * species) AS total, coalesce(sum(species) FILTER (WHERE r = 1), 0) AS once FROM z),
 e AS (SELECT r, species, once, total, (r + 1) * n1 / species AS x, (r + 1) * pow((r + 1) / r, b) AS y, sqrt(pow(r + 1, 2) * n1 / (species * species) * (1 + n1 / species)) AS sd FROM z, l),
 s AS (SELECT *, CASE WHEN max(CAST(coalesce(abs(x - y) <= 1.96 * sd, TRUE) AS INTEGER)) OVER (ORDER BY r ROWS UNBOUNDED PRECEDING) = 1 THEN y ELSE x END AS star FROM e)
 SELECT r, species, round((1 - once / total) * star / sum(star * species) OVER (), 9) AS p FROM s""")
def _(v):
    cc = coverage.counts_of_counts(v.posts.select(ids.suffix(c("id")).alias("s")), "s")
    return estimators.good_turing(cc).select("r", "species", R(c("p"), 9).alias("p"))


@query("segment_distinct_ci", """WITH s AS (SELECT i.a || '-' || i.b AS segment, (id >> (31 - i.b)) & ((1 << (i.b - i.a + 1)) - 1) AS x FROM posts, (SELECT unnest([10, 18, 24, 0]) AS a, unnest([17, 23, 31, 9]) AS b) i),
 n AS (SELECT segment, x, count(*) AS n FROM s GROUP BY 1, 2), r AS (SELECT segment, rep, count(*) FILTER (WHERE CAST('0x' || substr(md5(segment || ':' || x || ':' || rep), 1, 13) AS BIGINT) / 4503599627370496.0 < 1 - exp(-n)) AS d FROM n, (SELECT unnest(range(1, 101)) AS rep) GROUP BY 1, 2)
 SELECT segment, (SELECT count(*) FROM n WHERE n.segment = r.segment) AS distinct_values, round(quantile_cont(d, 0.05), 4) AS lower FROM r GROUP BY segment""")
def _(v):
    n = coverage.interval_counts(v.posts, "id", INTERVALS)
    return estimators.distinct_interval(n, "segment", "x", 100, 0.95).select("segment", c("distinct").alias("distinct_values"), R(c("lower")).alias("lower"))


@query("uniform_segments", """WITH s AS (SELECT i AS start, i + l AS stop, ((id & 4294967295) >> (32 - i - l)) & ((1 << l) - 1) AS x, l FROM posts, (SELECT unnest(range(0, 29)) AS i), (SELECT unnest(range(3, 13)) AS l) WHERE i + l <= 32),
 n AS (SELECT start, stop, l, x, count(*) AS n FROM s GROUP BY 1, 2, 3, 4), d AS (SELECT start, stop, round(sqrt(greatest(sum(n * n) / pow(2, l) - pow(sum(n) / pow(2, l), 2), 0)), 4) AS sd FROM n GROUP BY start, stop, l)
 SELECT start, stop, sd FROM d ORDER BY sd, start, stop LIMIT 5""")
def _(v):
    low = v.posts.select(c("id").bitwiseAND(F.lit((1 << 32) - 1).cast("long")).alias("w"))
    d = estimators.uniform_segments(low, "w", 32, 3, 12).select(c("start").cast("long").alias("start"), c("stop").cast("long").alias("stop"), R(c("sd")).alias("sd"))
    return d.orderBy("sd", "start", "stop").limit(5)


PRECISION, RECALL = 0.88, 0.81


def found_by_country(v):
    return v.posts.groupBy("loc").agg(F.count_if(c("k") > 60).alias("k"), one().alias("n"))


@query("prevalence_points", "SELECT loc, round(count(*) FILTER (WHERE k > 60) * 0.88 / 0.81 / count(*) * 100, 4) AS point FROM posts GROUP BY loc")
def _(v):
    return found_by_country(v).select("loc", R(estimators.prevalence(c("k"), c("n"), PRECISION, RECALL)).alias("point"))


@query("prevalence_ci")
def _(v):
    """Intervals of prevalence_points from seeded draws."""
    return estimators.prevalence_interval(found_by_country(v), "loc", PRECISION, RECALL, 300)


TESTED, TRUST = 6110, 0.7


@query("prevalence_ci_adjusted", f"""WITH g AS (SELECT loc, CAST(count(*) FILTER (WHERE k > 60) AS DOUBLE) AS k, CAST(count(*) AS DOUBLE) AS n FROM posts GROUP BY loc),
 s AS (SELECT loc, k, n, k * {PRECISION} / {RECALL} / n * 100 AS point, exp(1.959963984540054 * sqrt((1 - k / n) / nullif(k, 0) + {1 - PRECISION} / ({PRECISION} * m) + {1 - RECALL} / ({RECALL} * m)
  + pow(({1 - TRUST}) * 0.2 / {PRECISION}, 2) + pow(({1 - TRUST}) * 0.2 / {RECALL}, 2))) AS spread FROM g, (SELECT {TESTED} * {TRUST} * {TRUST} AS m))
 SELECT loc, round(point, 4) AS point, round(CASE WHEN k = 0 THEN 0 ELSE point / spread END, 4) AS lower,
  round(least(CASE WHEN k = 0 THEN (1 - pow(0.025, 1 / n)) * {PRECISION} / {RECALL} * 100 ELSE point * spread END, 100), 4) AS upper FROM s""")
def _(v):
    out = estimators.prevalence_interval_adjusted(found_by_country(v), "loc", PRECISION, RECALL, TESTED, TRUST)
    return out.select("loc", *[R(c(x)).alias(x) for x in ("point", "lower", "upper")])


@query("permutation_blocks", """WITH c AS (SELECT cid, uid, small_author AS a FROM comments), r AS (SELECT c.*, rep FROM c, (SELECT unnest(range(1, 6)) AS rep)),
 x AS (SELECT rep, uid, row_number() OVER (PARTITION BY rep ORDER BY md5('a:' || cid || ':' || rep), cid, uid) AS i FROM r), y AS (SELECT rep, a, row_number() OVER (PARTITION BY rep ORDER BY md5('b:' || cid || ':' || rep), cid, a) AS i FROM r),
 s AS (SELECT rep, size, count(*) AS groups FROM (SELECT rep, s, count(*) AS size FROM (SELECT x.rep AS rep, uid, array_to_string(list_sort(list(DISTINCT a)), ',') AS s FROM x JOIN y ON x.rep = y.rep AND x.i = y.i GROUP BY 1, 2) GROUP BY 1, 2) GROUP BY 1, 2),
 o AS (SELECT size, count(*) AS observed FROM (SELECT count(*) AS size FROM (SELECT uid, array_to_string(list_sort(list(DISTINCT a)), ',') AS s FROM c GROUP BY uid) GROUP BY s) GROUP BY size),
 g AS (SELECT o.size, observed, rep, coalesce(groups, 0) AS groups FROM o CROSS JOIN (SELECT unnest(range(1, 6)) AS rep) q LEFT JOIN s USING (size, rep))
 SELECT size, observed, round(avg(groups), 4) AS mean, round(stddev_pop(groups), 4) AS sd, round(avg(CASE WHEN groups >= observed THEN 1.0 ELSE 0.0 END), 4) AS p FROM g GROUP BY size, observed""")
def _(v):
    out = estimators.permutation_blocks(v.comments.select("cid", "uid", "small_author"), "cid", "uid", "small_author", 5)
    return out.select("size", "observed", R(c("mean")).alias("mean"), R(c("sd")).alias("sd"), R(c("p")).alias("p"))


@query("deletion_curve")
def _(v):
    """Weekly rates of each status after an anchor of rate 0 a week before the first; a point i from the anchor on weighs 1 + i, as its residual is divided by 1 / (1 + i)."""
    from pyspark.sql import Window

    week = ((F.datediff(F.date_trunc("week", "ts"), F.lit("2024-01-01"))) + 7).cast("double")
    all_ = v.posts.groupBy(week.alias("t")).agg(one().alias("total"))
    each = v.posts.where("status_msg is not null").groupBy(c("status_msg").alias("status"), week.alias("t")).agg(one().alias("n"))
    weekly = each.join(all_, "t").select("status", "t", (c("n") / c("total")).alias("rate"))
    anchors = each.select("status").distinct().select("status", F.lit(0.0).alias("t"), F.lit(0.0).alias("rate"))
    place = F.row_number().over(Window.partitionBy("status").orderBy("t"))  # a row a week
    series = anchors.unionByName(weekly).withColumn("weight", place)
    return estimators.log_curves(series, "status", "t", "rate", "weight")
