"""Joins, windows, the request ledger, coordination and dictionary coverage."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import ids, rules
from ..operators import counts, coverage, ledger, series
from .registry import query

c = F.col
R = lambda x, n=4: F.round(x, n)


def N():
    return F.count(F.lit(1))


@query("join_left_topics", "SELECT event_id, coalesce(toxic, -1) AS topic FROM events LEFT JOIN labels ON doc_id = event_id")
def _(v):
    t = v.table("labels").select(c("doc_id").alias("event_id"), c("toxic").alias("topic"))
    return v.table("events").select("event_id").join(t, "event_id", "left").fillna({"topic": -1})


@query("join_inner_population", "SELECT loc, count(*) AS n, max(population) AS population FROM posts JOIN countries USING (loc) GROUP BY loc")
def _(v):
    return counts.value_counts(v.posts, ["loc"]).join(F.broadcast(v.countries.select("loc", "population")), "loc")


@query("join_inner_predictors", "SELECT a.doc_id, a.prob > 0.5 AS one, b.prob2 > 0.5 AS two, l.toxic FROM predictions a JOIN predictions b USING (doc_id) JOIN labels l USING (doc_id)")
def _(v):
    p = v.predictions
    return p.select("doc_id", (c("prob") > 0.5).alias("one")).join(p.select("doc_id", (c("prob2") > 0.5).alias("two")), "doc_id").join(v.table("labels").select("doc_id", "toxic"), "doc_id")


@query("join_right_comments", "SELECT p_partkey, count(cid) AS n FROM comments RIGHT JOIN part ON post = p_partkey GROUP BY 1")
def _(v):
    return v.comments.select("post", "cid").join(v.table("part").select("p_partkey"), c("post") == c("p_partkey"), "right").groupBy("p_partkey").agg(F.count("cid").alias("n"))


@query("join_full_zero", """WITH t AS (SELECT id, minute(ts) = 0 AS zero, unnest(regexp_extract_all(descr, '#[a-zA-Z0-9_]+')) AS tag FROM posts)
 SELECT tag, count(*) FILTER (WHERE zero) AS at_zero, count(*) FILTER (WHERE NOT zero) AS rest FROM t GROUP BY tag""")
def _(v):
    return coverage.split_counts(v.posts, rules.hashtags(c("descr")), F.minute("ts") == 0)


@query("spike_hashtags", """WITH t AS (SELECT minute(ts) = 0 AS zero, unnest(regexp_extract_all(descr, '#[a-zA-Z0-9_]+')) AS tag FROM posts),
 g AS (SELECT tag, round(count(*) FILTER (WHERE zero) - count(*) FILTER (WHERE NOT zero) / 59.0, 4) AS gap FROM t GROUP BY tag)
 (SELECT tag, gap FROM g ORDER BY gap DESC, tag LIMIT 10) UNION (SELECT tag, gap FROM g ORDER BY gap, tag LIMIT 10)""")
def _(v):
    both = coverage.split_counts(v.posts, rules.hashtags(c("descr")), F.minute("ts") == 0)
    g = both.select("tag", R(c("at_zero") - c("rest") / 59.0).alias("gap"))
    return counts.top_k(g, [F.desc("gap"), "tag"], 10).union(counts.top_k(g, ["gap", "tag"], 10)).distinct()


@query("join_semi_frequent", "SELECT event_id FROM posts WHERE author IN (SELECT author FROM posts GROUP BY author HAVING count(*) >= 70)")
def _(v):
    often = counts.value_counts(v.posts, ["author"]).where("n >= 70")
    return v.posts.select("event_id", "author").join(often, "author", "left_semi").select("event_id")


@query("join_anti_resume", "SELECT event_id FROM events WHERE event_id NOT IN (SELECT doc_id FROM labels)")
def _(v):
    return v.table("events").select("event_id").join(v.table("labels").select(c("doc_id").alias("event_id")), "event_id", "left_anti")


@query("join_cross_candidates", "SELECT s.create_s * 4294967296 + d.suffix AS id FROM (SELECT DISTINCT create_s // 86400 * 86400 AS create_s FROM posts) s, (SELECT DISTINCT id & 4194303 AS suffix FROM posts) d")
def _(v):
    """The first millisecond of every day with posts, for the whole dictionary."""
    days = v.posts.select((F.floor(c("create_s") / 86400) * 86400000).alias("ms")).distinct()
    return ledger.candidates(days, v.posts.select(ids.suffix(c("id")).alias("suffix"))).select("id")


@query("ledger_candidates", "SELECT (m // 1000) * 4294967296 + (m % 1000) * 4194304 + suffix AS id FROM (SELECT unnest(range(s * 1000, s * 1000 + 20)) AS m FROM (SELECT min(create_s) AS s FROM posts)), (SELECT DISTINCT id & 4194303 AS suffix FROM posts)")
def _(v):
    """20 ms from the first post's second on, at 1 ms each, for the whole dictionary."""
    start = v.posts.agg((F.min("create_s") * 1000).alias("s"))
    return ledger.candidates(ledger.milliseconds(start, "s", 20), v.posts.select(ids.suffix(c("id")).alias("suffix"))).select("id")


@query("ledger_schedule", """SELECT d.day + s AS at, 'hour' AS slice FROM (SELECT min(create_s) // 86400 * 86400 AS day FROM posts) d, (SELECT unnest(range(68400, 72000)) AS s)
 UNION ALL SELECT d.day + h * 3600 + 2520 + s, 'minutes' FROM (SELECT min(create_s) // 86400 * 86400 AS day FROM posts) d, (SELECT unnest(range(24)) AS h), (SELECT unnest(range(60)) AS s)""")
def _(v):
    return ledger.schedule(v.posts.agg((F.floor(F.min("create_s") / 86400) * 86400).alias("day")))


@query("ledger_load", "SELECT id AS args, status_msg IS NULL OR status_code IS NOT NULL AS completed FROM posts")
def _(v):
    return ledger.load(v.posts.select("id", F.when(c("status_msg").isNull(), c("id")).alias("found"), "status_code"))


@query("ledger_resume", "SELECT event_id AS args, k % 3 > 0 AS completed FROM posts UNION ALL SELECT DISTINCT o_orderkey, FALSE FROM orders WHERE o_orderkey NOT IN (SELECT event_id FROM events)")
def _(v):
    done = v.posts.select(c("event_id").alias("args"), (c("k") % 3 > 0).alias("completed"))
    return ledger.resume(done, v.table("orders").select(c("o_orderkey").alias("args")))


@query("ledger_apply", "SELECT event_id AS args, k % 4 + CASE WHEN k % 2 = 0 THEN 1 ELSE 0 END AS attempts, k % 2 = 1 OR k % 4 + CASE WHEN k % 2 = 0 THEN 1 ELSE 0 END >= 3 AS completed FROM posts")
def _(v):
    held = v.posts.select(c("event_id").alias("args"), F.array_repeat(F.lit("timeout"), (c("k") % 4).cast("int")).alias("exceptions"), F.lit(False).alias("completed"))
    news = v.posts.select(c("event_id").alias("args"), F.when(c("k") % 2 == 0, "refused").alias("exception"))
    return ledger.apply(held, news, 3).select("args", F.size("exceptions").cast("long").alias("attempts"), "completed")


@query("join_upsert_ledger", "SELECT event_id, CASE WHEN toxic IS NOT NULL THEN CAST(toxic AS BIGINT) ELSE k END AS value FROM posts LEFT JOIN labels ON doc_id = event_id")
def _(v):
    news = v.table("labels").select(c("doc_id").alias("event_id"), c("toxic").cast("long").alias("value"))
    return ledger.upsert(v.posts.select("event_id", c("k").alias("value")), news, "event_id", "value")


@query("ledger_remaining", "SELECT count(*) FILTER (WHERE status_msg IS NOT NULL) AS remaining FROM posts")
def _(v):
    return v.posts.agg(F.count_if(c("status_msg").isNotNull()).alias("remaining"))


@query("ledger_summary", "SELECT count(*) FILTER (WHERE status_msg IS NULL) AS hits, count(*) FILTER (WHERE status_msg IS NULL OR status_msg <> 'item doesn''t exist') AS valid, round(avg(CASE WHEN status_msg IS NULL THEN 1.0 ELSE 0.0 END), 4) AS hit_share FROM posts")
def _(v):
    hit = c("status_msg").isNull()
    return v.posts.agg(F.count_if(hit).alias("hits"), F.count_if(hit | (c("status_msg") != rules.GONE)).alias("valid"), R(F.avg(F.when(hit, 1.0).otherwise(0.0))).alias("hit_share"))


@query("next_batch", "SELECT event_id FROM posts WHERE status_msg IS NOT NULL ORDER BY event_id LIMIT 100")
def _(v):
    return counts.top_k(v.posts.where("status_msg is not null").select("event_id"), ["event_id"], 100)


@query("request_budget", "SELECT count(DISTINCT id & 4194303) * 1000 * 3600 AS requests FROM posts")
def _(v):
    return v.posts.agg((F.count_distinct(ids.suffix(c("id"))) * 1000 * 3600).alias("requests"))


@query("join_comment_offsets", """WITH k AS (SELECT l_orderkey * 10 + l_linenumber AS cid, CASE WHEN l_linenumber % 3 > 0 THEN epoch_us(l_shipdate) // 1000000 END AS create_s, CASE WHEN l_linenumber % 5 > 0 THEN l_orderkey END AS post FROM lineitem)
 SELECT cid, create_s - epoch_us(o_orderdate) // 1000000 AS seconds FROM k LEFT JOIN (SELECT * FROM orders WHERE o_orderkey % 4 > 0) ON post = o_orderkey WHERE create_s IS NOT NULL AND o_orderdate IS NOT NULL""")
def _(v):
    """Comments keep their post's time where it is known; only those with both times have an offset."""
    times = v.table("lineitem").select((c("l_orderkey") * 10 + c("l_linenumber")).alias("cid"), F.when(c("l_linenumber") % 3 > 0, F.unix_timestamp("l_shipdate")).alias("create_s"),
                                       F.when(c("l_linenumber") % 5 > 0, c("l_orderkey")).alias("post"))
    posts = v.table("orders").where("o_orderkey % 4 > 0").select(c("o_orderkey").alias("post"), F.unix_timestamp("o_orderdate").alias("posted_s"))
    return times.join(posts, "post", "left").where("create_s is not null and posted_s is not null").select("cid", (c("create_s") - c("posted_s")).alias("seconds"))


@query("join_group_size_back", "SELECT event_id, count(*) OVER (PARTITION BY author) AS n FROM posts")
def _(v):
    return v.posts.select("event_id", "author").join(counts.value_counts(v.posts, ["author"]), "author").select("event_id", "n")


@query("join_by_id_not_position", "SELECT doc_id, prob, CAST(toxic AS BIGINT) AS toxic FROM predictions JOIN labels USING (doc_id)")
def _(v):
    return v.predictions.select("doc_id", "prob").join(v.table("labels").select("doc_id", c("toxic").cast("long").alias("toxic")), "doc_id")


@query("interaction_sets", "SELECT uid, count(*) AS n, array_to_string(list(small_author ORDER BY small_author), ',') AS every, array_to_string(list_sort(list(DISTINCT small_author)), ',') AS authors, count(DISTINCT small_author) AS distinct_authors FROM comments GROUP BY uid")
def _(v):
    """Each commenter's authors, one for each comment, and how many they are; the same without repeats."""
    per = v.comments.groupBy("uid", "small_author").agg(N().alias("n"))  # a busy commenter's row holds each author once until here
    own = F.array_sort(F.collect_list(F.struct("small_author", "n")))
    rows = per.groupBy("uid").agg(F.sum("n").alias("n"), own.alias("own"))
    every = F.flatten(F.transform("own", lambda x: F.array_repeat(x["small_author"], x["n"].cast("int"))))
    return rows.select("uid", "n", F.array_join(every, ",").alias("every"), F.array_join(c("own")["small_author"], ",").alias("authors"), F.size("own").cast("long").alias("distinct_authors"))


@query("block_groups", "SELECT authors, count(*) AS members FROM (SELECT uid, array_to_string(list_sort(list(DISTINCT small_author)), ',') AS authors FROM comments GROUP BY uid) GROUP BY authors HAVING count(*) > 5")
def _(v):
    return coverage.blocks(v.comments, "uid", "small_author").where("members > 5")


@query("block_size_distribution", "SELECT members, count(*) AS blocks FROM (SELECT authors, count(*) AS members FROM (SELECT uid, array_to_string(list_sort(list(DISTINCT small_author)), ',') AS authors FROM comments GROUP BY uid) GROUP BY authors) GROUP BY members")
def _(v):
    return coverage.blocks(v.comments, "uid", "small_author").groupBy("members").agg(N().alias("blocks"))


@query("suspicious_commenters", "SELECT uid FROM comments GROUP BY uid HAVING count(DISTINCT author) > 20 AND count(*) > 30")
def _(v):
    return v.comments.groupBy("uid").agg(F.count_distinct("author").alias("a"), N().alias("n")).where("a > 20 and n > 30").select("uid")


@query("comment_gaps", "SELECT uid, round((max(create_s) - min(create_s)) / (count(*) - 1), 4) AS gap, count(*) AS n FROM comments GROUP BY uid HAVING count(*) > 1")
def _(v):
    return v.comments.groupBy("uid").agg(N().alias("n"), R((F.max("create_s") - F.min("create_s")) / (N() - 1)).alias("gap")).where("n > 1")


@query("frequent_posters", "SELECT author, count(*) AS n FROM posts GROUP BY author HAVING count(*) > 70")
def _(v):
    return counts.value_counts(v.posts, ["author"]).where("n > 70")


@query("ids_per_ms_geo", "SELECT n AS size, count(*) AS groups FROM (SELECT ms, dc, count(*) AS n FROM posts GROUP BY 1, 2) GROUP BY n")
def _(v):
    return counts.value_counts(v.posts, ["ms", "dc"]).groupBy(c("n").alias("size")).agg(N().alias("groups"))


@query("counter_by_group_size", "SELECT n AS size, counter, count(*) AS posts FROM (SELECT counter, count(*) OVER (PARTITION BY ms, dc) AS n FROM posts) GROUP BY 1, 2")
def _(v):
    size = counts.value_counts(v.posts, ["ms", "dc"])
    return v.posts.select("ms", "dc", "counter").join(size, ["ms", "dc"]).groupBy(c("n").alias("size"), "counter").agg(N().alias("posts"))


@query("dominant_worker", "SELECT loc, arg_min(worker, (-n, worker)) AS worker FROM (SELECT loc, worker, count(*) AS n FROM posts GROUP BY 1, 2) GROUP BY loc")
def _(v):
    return counts.value_counts(v.posts, ["loc", "worker"]).groupBy("loc").agg(F.min_by("worker", F.struct(-c("n"), c("worker"))).alias("worker"))


#: Intervals of bits of the low word of an id, of at most 10 bits each; the same in SQL.
INTERVALS = ((10, 17), (18, 23), (24, 31), (0, 9))
SEGMENTS_SQL = "WITH i AS (SELECT unnest([10, 18, 24, 0]) AS a, unnest([17, 23, 31, 9]) AS b), s AS (SELECT a || '-' || b AS segment, (id >> (31 - b)) & ((1 << (b - a + 1)) - 1) AS x, count(*) AS n FROM posts, i GROUP BY ALL)"


@query("segment_stats", SEGMENTS_SQL + """, t AS (SELECT segment, sum(n) AS t, count(*) AS distinct_values FROM s GROUP BY segment), e AS (SELECT segment, round(-sum(n / t * ln(n / t)), 4) AS entropy FROM s JOIN t USING (segment) GROUP BY segment)
 SELECT segment, x, n, distinct_values, entropy FROM s JOIN t USING (segment) JOIN e USING (segment)""")
def _(v):
    """Each interval's histogram, with its distinct values and its entropy."""
    n = coverage.interval_counts(v.posts, "id", INTERVALS)
    return n.join(F.broadcast(coverage.interval_stats(n)), "segment").select("segment", "x", "n", c("values").alias("distinct_values"), "entropy")  # a row an interval


@query("observed_combinations", "SELECT DISTINCT id & 4194303 AS suffix FROM posts")
def _(v):
    return v.posts.select(ids.suffix(c("id")).alias("suffix")).distinct()


@query("missing_counters", """WITH r AS (SELECT id & 255 AS geo, ms, (id >> 14) & 31 AS counter, create_s // 2592000 AS slot FROM posts WHERE event_id % 32 NOT IN (3, 17) OR user_id % 17 > 8),
 g AS (SELECT geo, slot, ms // 250 AS quarter, list(DISTINCT counter) AS seen, min(counter) AS a, max(counter) AS b FROM r GROUP BY 1, 2, 3),
 m AS (SELECT geo, slot, quarter, len(seen) AS seen, list_filter(range(a, b + 1), lambda x: NOT list_contains(seen, x)) AS gone FROM g),
 p AS (SELECT geo, slot, quarter, unnest(gone) AS counter FROM m WHERE len(gone) / seen < 0.2)
 SELECT p.geo AS geo, slot, quarter, p.counter AS counter, slot * 2592000 * 4294967296 + quarter * 250 * 4194304 + p.counter * 16384 + p.geo AS proposed FROM p ANTI JOIN (SELECT DISTINCT geo, counter FROM r) k ON k.geo = p.geo AND k.counter = p.counter""")
def _(v):
    """Counters that a place leaves out between others in a quarter of all milliseconds, few enough to be odd, and that it was never asked for: the ids to try."""
    i = c("id")
    rows = v.posts.where((~(c("event_id") % 32).isin(3, 17)) | (c("user_id") % 17 > 8)).select(
        ids.worker(i).alias("geo"), F.floor(c("ms") / 250).alias("quarter"), ids.counter(i).alias("counter"), F.floor(c("create_s") / 2592000).alias("slot"))
    new = coverage.proposals(rows, "geo", ["slot", "quarter"], "counter", rows, 0.2)
    return new.select("geo", "slot", "quarter", "counter", ids.compose(c("slot") * 2592000, c("quarter") * 250, c("counter"), c("geo")).alias("proposed"))


HITS = "WITH h AS (SELECT id & 4194303 AS s, count(*) FILTER (WHERE status_msg IS NULL) AS hits, count(*) AS requests FROM posts GROUP BY 1), w AS (SELECT *, sum(hits) OVER (ORDER BY hits DESC, s ROWS UNBOUNDED PRECEDING) AS cum, sum(hits) OVER () AS total FROM h)"


@query("hit_rate_curve", HITS + """ SELECT x.share AS share, round(sum(hits) / max(total), 4) AS kept, round(sum(hits) / sum(requests), 4) AS hit_rate, count(*) AS suffixes
 FROM w JOIN (SELECT unnest([0.9, 0.95, 0.99, 0.995, 0.999, 1.0]) AS share) x ON cum <= floor(total * x.share) GROUP BY x.share""")
def _(v):
    return coverage.hit_rate_curve(v.posts.select(ids.suffix(c("id")).alias("s"), c("status_msg").isNull().alias("hit")))


@query("win_cumsum", HITS + " SELECT s, CAST(cum AS BIGINT) AS cum FROM w")
def _(v):
    per = coverage.hits_by(v.posts.select(ids.suffix(c("id")).alias("s"), c("status_msg").isNull().alias("hit")))
    return coverage.cumulative(per).select("s", "cum")


@query("counts_of_counts", "SELECT n AS r, count(*) AS species FROM (SELECT id & 4194303 AS s, count(*) AS n FROM posts GROUP BY 1) GROUP BY n")
def _(v):
    return coverage.counts_of_counts(v.posts.select(ids.suffix(c("id")).alias("s")), "s")


RC = "WITH r AS (SELECT n AS r, count(*) AS f FROM (SELECT id & 4194303 AS s, count(*) AS n FROM posts GROUP BY 1) GROUP BY n) "


@query("unseen_mass", RC + "SELECT round(coalesce(sum(CASE WHEN r = 1 THEN f END), 0) / sum(r * f), 6) AS p0 FROM r")
def _(v):
    return coverage.unseen_mass(coverage.counts_of_counts(v.posts.select(ids.suffix(c("id")).alias("s")), "s"))


@query("richness_chao1", RC + "SELECT round(sum(f) + coalesce(sum(CASE WHEN r = 1 THEN f END), 0) * (coalesce(sum(CASE WHEN r = 1 THEN f END), 0) - 1) / (2 * (coalesce(sum(CASE WHEN r = 2 THEN f END), 0) + 1)), 4) AS chao1 FROM r")
def _(v):
    return coverage.chao1(coverage.counts_of_counts(v.posts.select(ids.suffix(c("id")).alias("s")), "s"))


@query("win_cum_prob", "WITH n AS (SELECT loc, k, count(*) AS n FROM posts GROUP BY 1, 2) SELECT loc, k, round(sum(n) OVER (PARTITION BY loc ORDER BY n DESC, k ROWS UNBOUNDED PRECEDING) / sum(n) OVER (PARTITION BY loc), 4) AS p FROM n")
def _(v):
    w = Window.partitionBy("loc")
    run = w.orderBy(F.desc("n"), "k").rowsBetween(Window.unboundedPreceding, 0)
    return counts.value_counts(v.posts, ["loc", "k"]).select("loc", "k", R(F.sum("n").over(run) / F.sum("n").over(w)).alias("p"))


@query("win_lag_gap", "SELECT event_id, coalesce(create_s - lag(create_s) OVER (PARTITION BY author ORDER BY create_s, event_id), -1) AS gap FROM posts")
def _(v):
    rows = series.with_gaps(v.posts.select("author", "create_s", "event_id"), "author", "create_s", "event_id")
    return rows.select("event_id", F.coalesce("gap", F.lit(-1)).alias("gap"))


@query("rle_series", """WITH d AS (SELECT author, event_id, create_s, k, create_s - lag(create_s) OVER (PARTITION BY author ORDER BY create_s, event_id) AS d FROM posts)
 SELECT author, create_s // 86400 AS day, string_agg(CASE WHEN d > 1 THEN CAST(-(d - 1) AS VARCHAR) || ',' ELSE '' END || CAST(k AS VARCHAR), ',' ORDER BY create_s, event_id) AS series FROM d GROUP BY author, create_s // 86400""")
def _(v):
    """A row a day, as an author's posts may be more than a row holds."""
    rows = series.run_lengths(v.posts.select("author", "create_s", "event_id", "k"), "author", "create_s", "event_id", "k")
    return rows.select("author", c("block").alias("day"), F.array_join("series", ",").alias("series"))


@query("win_pareto", """WITH a AS (SELECT author, count(*) AS n, round(avg(plays), 4) AS mean FROM posts GROUP BY author),
 b AS (SELECT *, max(mean) OVER (ORDER BY n DESC, mean DESC, author ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS best FROM a) SELECT author, n, mean FROM b WHERE best IS NULL OR mean > best""")
def _(v):
    a = v.posts.groupBy("author").agg(N().alias("n"), R(F.avg("plays")).alias("mean"))
    known = a.where("mean is not null")
    top = known.groupBy("n").agg(F.min_by(F.struct("author", "mean"), F.struct(-c("mean"), "author")).alias("top")).select("top.author", "n", "top.mean")
    best = F.max("mean").over(Window.orderBy(F.desc("n")).rowsBetween(Window.unboundedPreceding, -1))  # rows: the distinct n, whose sum is at most the posts
    front = top.withColumn("best", best).where("best is null or mean > best").select("author", "n", "mean")
    ahead = a.where("mean is null").crossJoin(F.broadcast(known.agg(F.max("n").alias("last")))).where("last is null or n > last")
    return front.unionByName(ahead.select("author", "n", "mean"))


@query("win_row_number", "SELECT event_id, row_number() OVER (PARTITION BY author ORDER BY event_id) AS rn FROM posts")
def _(v):
    return v.posts.select("event_id", F.row_number().over(Window.partitionBy("author").orderBy("event_id")).alias("rn"))


@query("win_first_n", "SELECT label, vec_id FROM (SELECT label, vec_id, row_number() OVER (PARTITION BY label ORDER BY vec_id) AS rn FROM embeddings) WHERE rn <= 10")
def _(v):
    rn = F.row_number().over(Window.partitionBy("label").orderBy("vec_id"))
    return v.table("embeddings").select("label", "vec_id", rn.alias("rn")).where("rn <= 10").drop("rn")


@query("co_comment_blocks", """WITH p AS (SELECT DISTINCT post, uid FROM comments), f AS (SELECT * FROM p WHERE post IN (SELECT post FROM p GROUP BY post HAVING count(*) >= 35))
 SELECT a.post AS a, b.post AS b, count(*) AS shared FROM f a JOIN f b ON a.uid = b.uid AND a.post < b.post GROUP BY 1, 2 HAVING count(*) >= 2""")
def _(v):
    return coverage.shared_members(v.comments.select("post", "uid").distinct(), "post", "uid", 35, 2)
