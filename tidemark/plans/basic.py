"""Scans, projections, filters, scalar rules, value counts and time buckets over posts and comments."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import attempts, ids, pages, rules
from ..operators import counts, countries, ledger
from ..sources import files, slices
from .registry import query

c = F.col
R = lambda x, n=4: F.round(x, n)


@query("scan_time_slice", "SELECT id, create_s, plays FROM posts WHERE hour(ts) = 19 OR minute(ts) = 42")
def _(v):
    """Two slices of a tree of posts; here its leaves are minutes, as a second has few posts."""
    path = files.scratch(v.spark, "tree")
    slices.write_slices(v.posts.select("id", "create_s", "plays", "ts"), path, "ts", ["hour", "minute"])
    return slices.read_slices(v.spark, path, (c("hour") == 19) | (c("minute") == 42)).select("id", "create_s", "plays")


@query("scan_projected", "SELECT user_id, event_type FROM events")
def _(v):
    return v.table("events").select("user_id", "event_type")


@query("scan_lazy_filter", "SELECT id, id & 4194303 AS suffix FROM posts WHERE plays > 1000")
def _(v):
    return v.posts.where("plays > 1000").select("id", ids.suffix(c("id")).alias("suffix"))


@query("merge_drifting_schemas", """SELECT id, CAST(plays AS DOUBLE) AS plays, CASE k % 3 WHEN 0 THEN loc WHEN 2 THEN CAST(author AS VARCHAR) END AS label, CASE WHEN k % 3 = 1 THEN value END AS value,
 CASE WHEN k % 3 > 0 THEN k END AS info_k, CASE WHEN k % 3 = 2 THEN CAST(dc AS VARCHAR) END AS info_dc FROM posts""")
def _(v):
    """Three slices: plays grows from int to long to double, label is a name or a number, info gains a field."""
    path, rows = files.scratch(v.spark, "drift"), v.posts
    drift = ([c("id"), c("plays").cast("int"), c("loc").alias("label")],
             [c("id"), c("plays"), c("value"), F.struct(c("k").cast("int").alias("k")).alias("info")],
             [F.struct("k", c("dc").cast("string").alias("dc")).alias("info"), c("id"), c("plays").cast("double"), c("author").alias("label")])
    for i, columns in enumerate(drift):
        rows.where(c("k") % 3 == i).select(*columns).write.parquet(f"{path}/{i}")
    merged = slices.merge_slices(v.spark, [f"{path}/{i}" for i in range(len(drift))])
    return merged.select("id", "plays", "label", "value", c("info.k").alias("info_k"), c("info.dc").alias("info_dc"))


@query("ingest_mixed_sources", """SELECT event_id AS id, epoch_us(ts) // 1000000 AS create_s, 'events' AS source FROM events
 UNION ALL SELECT o_orderkey, epoch_us(o_orderdate) // 1000000, 'orders' FROM orders WHERE o_orderkey NOT IN (SELECT event_id FROM events)""")
def _(v):
    one = v.table("events").select(c("event_id").alias("id"), F.unix_timestamp("ts").alias("create_s"), F.lit("events").alias("source"))
    two = v.table("orders").select(c("o_orderkey").alias("id"), F.unix_timestamp("o_orderdate").alias("create_s"), F.lit("orders").alias("source"))
    return counts.keep_first(one.unionByName(two), ["id"], ["source", "create_s"])


@query("flatten_posts", "SELECT id, author, plays, loc, len(string_split(descr, ' ')) AS images FROM posts WHERE status_msg IS NULL")
def _(v):
    nested = v.posts.select(F.struct(F.when(c("status_msg").isNull(), c("id")).alias("id"), F.struct(c("author").alias("uniqueId")).alias("author"),
                                     F.struct(c("plays").alias("playCount")).alias("stats"), "loc", F.split("descr", " ").alias("images")).alias("r"))
    return nested.where("r.id is not null").select("r.id", c("r.author.uniqueId").alias("author"), c("r.stats.playCount").alias("plays"), "r.loc", F.size("r.images").cast("long").alias("images"))


@query("flatten_errors", "SELECT id, status_code, status_msg FROM posts WHERE status_code IS NOT NULL")
def _(v):
    return v.posts.where("status_code is not null").select("id", "status_code", "status_msg")


@query("filter_valid_returns", "SELECT count(*) AS n FROM posts WHERE status_msg IS NULL OR status_msg <> 'item doesn''t exist'")
def _(v):
    return v.posts.where(c("status_msg").isNull() | (c("status_msg") != rules.GONE)).agg(F.count(F.lit(1)).alias("n"))


@query("status_or_success", "SELECT id, coalesce(status_msg, 'success') AS status FROM posts")
def _(v):
    return v.posts.select("id", F.coalesce("status_msg", F.lit("success")).alias("status"))


@query("success_flag", "SELECT event_id, (status_msg <> 'item doesn''t exist' OR CASE WHEN status_msg IS NULL THEN id END IS NOT NULL) AS success FROM posts")
def _(v):
    return v.posts.select("event_id", rules.success(c("status_msg"), F.when(c("status_msg").isNull(), c("id"))).alias("success"))


@query("maybe_existed", "SELECT event_id, NOT coalesce(status_code IN (10204, 10222) AND status_msg = 'item doesn''t exist', FALSE) AS existed FROM posts")
def _(v):
    return v.posts.select("event_id", rules.maybe_existed(c("status_code"), c("status_msg"), c("id")).alias("existed"))


@query("invalid_id_rate", "SELECT event_id % 3 AS slice, round(avg(CASE WHEN event_type = 'error' AND event_id % 7 = 0 THEN 1.0 ELSE 0.0 END), 4) AS rate, count(*) AS n FROM posts GROUP BY 1")
def _(v):
    """The share of answers in each slice of requests that call the id invalid."""
    bad = (c("event_type") == "error") & (c("event_id") % 7 == 0)
    answers = v.posts.select((c("event_id") % 3).alias("slice"), F.when(bad, rules.INVALID_CODE).otherwise(c("status_code")).alias("code"), F.when(bad, rules.INVALID).otherwise(c("status_msg")).alias("status"))
    return answers.groupBy("slice").agg(R(F.avg(rules.invalid_id(c("code"), c("status")).cast("double"))).alias("rate"), F.count(F.lit(1)).alias("n"))


@query("id_fields", """SELECT id, id >> 32 AS second, (id >> 22) & 1023 AS ms, (id >> 14) & 255 AS counter, id & 16383 AS geo, (id >> 8) & 63 AS dc, id & 255 AS worker FROM posts""")
def _(v):
    i = c("id")
    return v.posts.select("id", ids.second(i).alias("second"), ids.millisecond(i).alias("ms"), ids.counter(i).alias("counter"), ids.geo(i).alias("geo"), ids.datacenter(i).alias("dc"), ids.worker(i).alias("worker"))


@query("id_timestamp", "SELECT id, epoch_us(make_timestamp((id >> 32) * 1000000)) // 1000000 AS at FROM posts")
def _(v):
    return v.posts.select("id", F.unix_timestamp(ids.timestamp(c("id"))).alias("at"))


@query("id_suffix", "SELECT id, id & 4194303 AS suffix FROM posts")
def _(v):
    return v.posts.select("id", ids.suffix(c("id")).alias("suffix"))


@query("id_worker", "SELECT id, id & 255 AS worker FROM posts")
def _(v):
    return v.posts.select("id", ids.worker(c("id")).alias("worker"))


@query("compose_id", "SELECT create_s * 4294967296 + ms * 4194304 + counter * 16384 + worker AS id FROM posts")
def _(v):
    return v.posts.select(ids.compose(c("create_s"), c("ms"), c("counter"), c("worker")).alias("id"))


@query("id_drift", "SELECT round(avg(abs((id >> 32) - (create_s + k % 3))), 4) AS mean_drift, max(abs((id >> 32) - (create_s + k % 3))) AS max_drift FROM posts")
def _(v):
    d = F.abs(ids.second(c("id")) - (c("create_s") + c("k") % 3))
    return v.posts.agg(R(F.avg(d)).alias("mean_drift"), F.max(d).alias("max_drift"))


@query("id_echo_check", "SELECT event_id // 100 AS batch, bool_and(k <> 7) AS valid FROM posts GROUP BY 1")
def _(v):
    echoed = F.when(c("k") == 7, c("id") + 1).otherwise(c("id"))
    return v.posts.groupBy(F.floor(c("event_id") / 100).alias("batch")).agg(F.bool_and(echoed == c("id")).alias("valid"))


@query("split_mismatched", """WITH r AS (SELECT id, create_s // 3600 AS slice, CASE WHEN k = 7 THEN id + 1 WHEN k = 8 THEN NULL ELSE id END AS echoed FROM posts), b AS (SELECT slice FROM r GROUP BY slice HAVING bool_or(echoed IS DISTINCT FROM id))
 SELECT 'kept' AS side, id, slice FROM r WHERE echoed = id UNION ALL SELECT 'quarantine', id, slice FROM r WHERE slice IN (SELECT slice FROM b)""")
def _(v):
    """Answers whose id is the one asked for, and in quarantine all answers of slices that hold others; both are written."""
    rows = v.posts.select("id", F.floor(c("create_s") / 3600).alias("slice"), F.when(c("k") == 7, c("id") + 1).when(c("k") != 8, c("id")).alias("echoed"))
    path = files.scratch(v.spark, "split")
    ledger.split_mismatched(rows, "id", "echoed", "slice", f"{path}/kept", f"{path}/quarantine")
    read = lambda side: v.spark.read.schema(rows.schema).parquet(f"{path}/{side}").select(F.lit(side).alias("side"), "id", "slice")
    return read("kept").unionByName(read("quarantine"))


@query("in_dictionary_assert", "SELECT count(*) AS outside FROM posts WHERE (id & 4194303) NOT IN (SELECT id & 4194303 FROM posts WHERE k < 50)")
def _(v):
    known = v.posts.where("k < 50").select(ids.suffix(c("id")).alias("s")).distinct()
    return v.posts.select(ids.suffix(c("id")).alias("s")).join(known, "s", "left_anti").agg(F.count(F.lit(1)).alias("outside"))


@query("calendar_parts", "SELECT id, second(ts) AS s, minute(ts) AS m, hour(ts) AS h, year(ts) AS y FROM posts")
def _(v):
    return v.posts.select("id", F.second("ts").alias("s"), F.minute("ts").alias("m"), F.hour("ts").alias("h"), F.year("ts").alias("y"))


@query("extract_hashtags", "SELECT id, unnest(regexp_extract_all(descr, '#[a-zA-Z0-9_]+')) AS tag FROM posts")
def _(v):
    return v.posts.select("id", F.explode(rules.hashtags(c("descr"))).alias("tag"))


@query("emoji_flags", """SELECT event_id, regexp_matches(t, '^[\\x{1F300}-\\x{1FAFF}\\x{2600}-\\x{27BF}]+') AS starts, regexp_matches(t, '[\\x{1F300}-\\x{1FAFF}\\x{2600}-\\x{27BF}]+$') AS ends
 FROM (SELECT event_id, CASE WHEN k % 3 = 0 THEN chr(128512) ELSE '' END || descr || CASE WHEN k % 5 = 0 THEN chr(9728) ELSE '' END AS t FROM posts)""")
def _(v):
    t = F.concat(F.when(c("k") % 3 == 0, "\U0001F600").otherwise(""), "descr", F.when(c("k") % 5 == 0, "☀").otherwise(""))
    run = r"[\x{1F300}-\x{1FAFF}\x{2600}-\x{27BF}]+"
    return v.posts.select("event_id", t.rlike("^" + run).alias("starts"), t.rlike(run + "$").alias("ends"))


@query("clean_labels", "SELECT DISTINCT event_type, upper(substr(event_type, 1, 1)) || lower(substr(event_type, 2)) AS label FROM posts")
def _(v):
    raw = F.concat(F.lit("  BrandX "), "event_type", F.lit("\nmore"))
    label = F.initcap(F.trim(F.regexp_replace(F.split_part(F.trim(raw), F.lit("\n"), F.lit(1)), "BrandX", "")))
    return v.posts.select("event_type", label.alias("label")).distinct()


@query("path_stem", "SELECT page_id, split_part(split_part(url, '/', -1), '.', 1) AS stem FROM pages")
def _(v):
    return v.table("pages").select("page_id", rules.path_stem(c("url")).alias("stem"))


@query("humanise_counts", """SELECT loc, CASE WHEN n >= 1000000 THEN printf('%.1fm', n / 1000000.0) WHEN n >= 1000 THEN printf('%.1fk', n / 1000.0) ELSE CAST(n AS VARCHAR) END AS shown, CASE WHEN length(d) > 20 THEN left(d, 20) || '...' ELSE d END AS descr
 FROM (SELECT loc, count(*) * 16 AS n, max(descr || repeat('+', k)) AS d FROM posts GROUP BY loc)""")
def _(v):
    n = v.posts.groupBy("loc").agg((F.count(F.lit(1)) * 16).alias("n"), F.max(F.concat("descr", F.repeat(F.lit("+"), c("k").cast("int")))).alias("d"))
    return n.select("loc", rules.human_count(c("n")).alias("shown"), rules.shortened(c("d")).alias("descr"))


@query("map_values_default", "SELECT event_id, CASE event_type WHEN 'click' THEN 'Click' WHEN 'view' THEN 'View' ELSE 'Other' END AS label FROM posts")
def _(v):
    names = v.spark.createDataFrame([("click", "Click"), ("view", "View")], "event_type string, label string")
    return v.posts.join(F.broadcast(names), "event_type", "left").select("event_id", F.coalesce("label", F.lit("Other")).alias("label"))


#: A dimension of made-up two-letter codes, and a table that overrides it.
CODES_SQL = """WITH d AS (SELECT n_name AS loc, 'N' || chr(65 + n_nationkey) AS alpha2, 'NA' || chr(65 + n_nationkey) AS alpha3 FROM nation WHERE n_nationkey % 7 <> 6),
 o AS (SELECT 'N' || chr(65 + n_nationkey) AS alpha2, 'OV' || n_regionkey AS alpha3 FROM nation WHERE n_nationkey % 5 = 0),
 p AS (SELECT lower(' n' || chr(65 + n_nationkey) || ' ') AS code FROM posts JOIN nation ON n_name = loc) """


@query("normalise_country", CODES_SQL + "SELECT coalesce(o.alpha3, d.alpha3, '?') AS code, count(*) AS n FROM p LEFT JOIN d ON upper(trim(code)) = d.alpha2 LEFT JOIN o ON upper(trim(code)) = o.alpha2 GROUP BY 1")
def _(v):
    """Posts by the three-letter code of their two-letter one, an override's first; several countries may share one, unknown codes are '?'."""
    n = v.table("nation")
    alpha2 = F.concat(F.lit("N"), F.char((65 + c("n_nationkey")).cast("long")))
    dimension = n.where("n_nationkey % 7 <> 6").select(alpha2.alias("alpha2"), F.concat(F.lit("NA"), F.char((65 + c("n_nationkey")).cast("long"))).alias("alpha3"))
    overrides = n.where("n_nationkey % 5 = 0").select(alpha2.alias("alpha2"), F.concat(F.lit("OV"), "n_regionkey").alias("alpha3"))
    posts = v.posts.join(F.broadcast(n.select(c("n_name").alias("loc"), F.lower(F.concat(F.lit(" "), alpha2, F.lit(" "))).alias("code"))), "loc")
    return counts.value_counts(countries.normalised(posts, "code", dimension, overrides), ["code"])


@query("country_in_list", "SELECT round(avg(CASE WHEN n_regionkey IN (1, 3) THEN 1.0 ELSE 0.0 END), 4) AS share, round(avg(CASE WHEN n_regionkey IN (1, 3) THEN plays END), 4) AS mean_plays FROM posts JOIN countries USING (loc)")
def _(v):
    near = c("n_regionkey").isin(1, 3)
    return v.posts.join(F.broadcast(v.countries), "loc").agg(R(F.avg(F.when(near, 1.0).otherwise(0.0))).alias("share"), R(F.avg(F.when(near, c("plays")))).alias("mean_plays"))


@query("contains_keyword", "SELECT doc_id, contains(lower(text), 'the ') AS hit FROM documents")
def _(v):
    return v.table("documents").select("doc_id", F.lower("text").contains("the ").alias("hit"))


@query("flag_disclosed", "SELECT event_id, coalesce(CAST(k % 4 AS VARCHAR) IN ('1', '2'), FALSE) AS disclosed FROM posts")
def _(v):
    return v.posts.select("event_id", F.coalesce((c("k") % 4).cast("string").isin("1", "2"), F.lit(False)).alias("disclosed"))


@query("threshold_label", "SELECT doc_id, CAST(prob > 0.43 AS INTEGER) AS pred FROM predictions")
def _(v):
    return v.predictions.select("doc_id", (c("prob") > 0.43).cast("int").alias("pred"))


@query("log1p_standardise", "SELECT event_id, round((ln(1 + plays) - avg(ln(1 + plays)) OVER ()) / stddev_pop(ln(1 + plays)) OVER (), 4) AS z FROM posts WHERE plays >= 0")
def _(v):
    rows = v.posts.where("plays >= 0").select("event_id", F.log1p(c("plays").cast("double")).alias("x"))
    one = rows.agg(F.avg("x").alias("m"), F.stddev_pop("x").alias("s"))
    return rows.crossJoin(F.broadcast(one)).select("event_id", R((c("x") - c("m")) / c("s")).alias("z"))


@query("fill_missing", "SELECT event_id, CASE WHEN k % 4 = 0 THEN 0.0 ELSE round(value, 4) END AS x FROM posts")
def _(v):
    x = F.when(c("k") % 4 == 0, F.when(c("k") % 8 == 0, F.lit(float("nan"))).otherwise(F.lit(None))).otherwise(c("value"))
    return v.posts.select("event_id", R(rules.zero_if_missing(x)).alias("x"))


#: Pages with the state that a site's script leaves in them: whole, cut off, broken, of an error, without the item, or with none.
PAGES_SQL = """WITH g AS (SELECT page_id, CASE page_id % 6 WHEN 0 THEN '{"itemInfo":{"itemStruct":{"id":' || page_id || ',"desc":"a } \\"b\\" {"}}}' WHEN 1 THEN '{"statusCode":10204,"statusMsg":"gone"}'
  WHEN 2 THEN '{"statusCode":0}' WHEN 3 THEN '{"itemInfo":{"itemStruct":' ELSE '{"itemInfo":{"itemStruct":{"id":1}}}' END AS detail FROM pages) """


@query("embedded_json", PAGES_SQL + """SELECT page_id, CASE WHEN page_id % 6 = 0 THEN page_id END AS id, CASE WHEN page_id % 6 = 0 THEN 'a } "b" {' END AS descr, CASE WHEN page_id % 6 = 1 THEN 10204 END AS status_code, CASE WHEN page_id % 6 = 1 THEN 'gone' END AS status_msg,
 CASE page_id % 6 WHEN 2 THEN 'no item' WHEN 3 THEN 'broken state' WHEN 4 THEN 'no state' WHEN 5 THEN 'no state' END AS error FROM g""")
def _(v):
    i = c("page_id")
    say = lambda *x: F.concat(*[F.lit(p) if isinstance(p, str) else p for p in x])
    detail = (F.when(i % 6 == 0, say('{"itemInfo":{"itemStruct":{"id":', i.cast("string"), ',"desc":"a } \\"b\\" {"}}}')).when(i % 6 == 1, '{"statusCode":10204,"statusMsg":"gone"}')
              .when(i % 6 == 2, '{"statusCode":0}').when(i % 6 == 3, '{"itemInfo":{"itemStruct":').otherwise('{"itemInfo":{"itemStruct":{"id":1}}}'))
    state = say("<script>{", F.lit(pages.START), detail, F.when(i % 6 == 4, "").otherwise(pages.END), "{}}</script>")
    html = F.when(i % 6 == 5, c("html")).otherwise(F.concat(F.substring("html", 1, 200), state, F.substring("html", F.lit(201), F.length("html"))))
    got = pages.state(html, "id bigint, desc string")
    return v.table("pages").select("page_id", got.alias("s")).select("page_id", "s.item.id", c("s.item.desc").alias("descr"), "s.status_code", "s.status_msg", "s.error")


ATTEMPTS_SQL = r"""WITH a AS (SELECT event_id, k, ts, unnest(range(k % 4)) AS pos FROM posts), p AS (SELECT event_id, pos, CASE pos WHEN 0 THEN 'Timeout(''x'')' WHEN 1 THEN 'it''s "bad", {', 'post_time'': None}' || chr(10) || '\ end' ELSE repeat('e', 60 + k) END AS exception,
  CASE WHEN pos <> 1 THEN strftime(ts, '%Y-%m-%d %H:%M:%S.%f') END AS pre_time, strftime(date_trunc('minute', ts), '%Y-%m-%d %H:%M:%S.%f') AS post_time FROM a) """.replace("{', 'post", "{'', ''post")


def attempts_text(v):
    """The tried requests of each post as the text of a list of dictionaries: messages with either quote, both, escapes and what looks like the list itself."""
    number = lambda part: part("ts").cast("string")
    micros = (F.unix_micros("ts") % 1_000_000).cast("string")
    date = F.concat_ws(", ", number(F.year), number(F.month), number(F.dayofmonth), number(F.hour), number(F.minute))
    to_minute = F.concat(F.lit("datetime.datetime("), date, F.lit(")"))
    full = F.concat(F.lit("datetime.datetime("), date, F.lit(", "), number(F.second), F.when(micros != "0", F.concat(F.lit(", "), micros)).otherwise(""), F.lit(")"))
    entry = lambda e, pre, post: F.concat(F.lit("{'exception': "), e, F.lit(", 'pre_time': "), pre, F.lit(", 'post_time': "), post, F.lit("}"))
    long = F.concat(F.lit("'"), F.repeat(F.lit("e"), (60 + c("k")).cast("int")), F.lit("'"))
    made = F.array(entry(F.lit("\"Timeout('x')\""), full, to_minute), entry(F.lit(r"""'it\'s "bad", {\', \'post_time\': None}\n\\ end'"""), F.lit("None"), to_minute), entry(long, full, to_minute))
    return v.posts.select("event_id", F.concat(F.lit("["), F.array_join(F.slice(made, F.lit(1), (c("k") % 4).cast("int")), ", "), F.lit("]")).alias("text"))


@query("parse_attempts", ATTEMPTS_SQL + "SELECT event_id, CAST(pos AS INTEGER) AS pos, exception, pre_time, post_time FROM p")
def _(v):
    shown = lambda x: F.date_format(x, "yyyy-MM-dd HH:mm:ss.SSSSSS")
    rows = attempts_text(v).select("event_id", F.posexplode(attempts.parse(c("text"))).alias("pos", "a"))
    return rows.select("event_id", "pos", "a.exception", shown(c("a.pre_time")).alias("pre_time"), shown(c("a.post_time")).alias("post_time"))


@query("truncate_attempts", ATTEMPTS_SQL + "SELECT event_id, '[' || array_to_string(list(left(exception, 100) ORDER BY pos), ', ') || ']' AS exceptions, max(length(exception)) AS longest FROM p GROUP BY event_id")
def _(v):
    parsed = attempts_text(v).select("event_id", attempts.parse(c("text")).alias("a")).where(F.size("a") > 0)
    short = attempts.truncate(c("a"))
    return parsed.select("event_id", F.concat(F.lit("["), F.array_join(short["exception"], ", "), F.lit("]")).alias("exceptions"),
                         F.array_max(F.transform("a", lambda a: F.length(a["exception"]))).cast("long").alias("longest"))


@query("bucket_exceptions", "SELECT CASE WHEN contains(event_type, 'err') THEN 'error' WHEN contains(event_type, 'c') THEN 'c' ELSE 'rest' END AS bucket, count(*) AS n FROM posts GROUP BY 1 ORDER BY n DESC, bucket LIMIT 5")
def _(v):
    bucket = F.when(c("event_type").contains("err"), "error").when(c("event_type").contains("c"), "c").otherwise("rest")
    return counts.top_k(counts.value_counts(v.posts.select(bucket.alias("bucket")), ["bucket"]), [F.desc("n"), "bucket"], 5)


#: Where posts are, and the two places between which they are set, in degrees.
PLACE_SQL, NEAR, FAR = "(user_id % 25) * 4.0 - 48 AS lat, (user_id % 36) * 10.0 - 175 AS lon", (38.9, -77.0), (1.35, 103.8)


def km_sql(lat1: str, lon1: str, lat2: str, lon2: str) -> str:
    return f"2 * 6371 * asin(sqrt(pow(sin((radians({lat2}) - radians({lat1})) / 2), 2) + cos(radians({lat1})) * cos(radians({lat2})) * pow(sin((radians({lon2}) - radians({lon1})) / 2), 2)))"


@query("geo_distance_share", f"""WITH p AS (SELECT event_id, {PLACE_SQL} FROM posts), w AS (SELECT {km_sql(*map(str, NEAR + FAR))} AS whole)
 SELECT event_id, round({km_sql('lat', 'lon', *map(str, NEAR))} / whole, 4) AS to_near, round({km_sql('lat', 'lon', *map(str, FAR))} / whole, 4) AS to_far FROM p, w""")
def _(v):
    """How far posts are from either place, as a share of the way between both."""
    at = lambda p: map(F.lit, p)
    whole = rules.haversine_km(*at(NEAR), *at(FAR))
    rows = v.posts.select("event_id", ((c("user_id") % 25) * 4.0 - 48).alias("lat"), ((c("user_id") % 36) * 10.0 - 175).alias("lon"))
    share = lambda p: R(rules.haversine_km(c("lat"), c("lon"), *at(p)) / whole)
    return rows.select("event_id", share(NEAR).alias("to_near"), share(FAR).alias("to_far"))


for _name, _frame, _keys in (
    ("value_counts", "posts", ["loc"]), ("value_counts_multi", "posts", ["event_type", "loc"]), ("value_counts_by_country", "posts", ["loc", "plays"]),
    ("worker_country_crosstab", "posts", ["worker", "loc"]), ("geo_counter_heatmap", "posts", ["dc", "counter"])):
    query(_name, f"SELECT {', '.join(_keys)}, count(*) AS n FROM {_frame} GROUP BY ALL")(
        lambda v, frame=_frame, keys=_keys: counts.value_counts(getattr(v, frame), keys))


@query("comment_distributions", "SELECT 'language' AS of, lang AS value, count(*) AS n FROM comments GROUP BY lang UNION ALL SELECT 'second', CAST(create_s AS VARCHAR), count(*) FROM comments GROUP BY create_s")
def _(v):
    """Comments by language and by second, from one pass."""
    each = F.array(F.struct(F.lit("language").alias("of"), c("lang").alias("value")), F.struct(F.lit("second").alias("of"), c("create_s").cast("string").alias("value")))
    return counts.value_counts(v.comments.select(F.inline(each)), ["of", "value"])


@query("merge_value_counts", "SELECT loc, count(*) AS n FROM posts GROUP BY loc")
def _(v):
    parts = [counts.value_counts(v.posts.where(c("event_id") % 2 == i), ["loc"]) for i in (0, 1)]
    return counts.merge_counts(parts, ["loc"])


@query("distinct_authors", "SELECT count(DISTINCT author) AS authors, TRUE AS estimated, count(DISTINCT CASE WHEN hour(ts) < 12 THEN author END) AS morning, TRUE AS morning_estimated FROM posts")
def _(v):
    """Exact numbers, and whether those of sketches of the hours, united for the whole day and for its first half, lie within three hundredths."""
    held = counts.sketches(v.posts.select("author", F.hour("ts").alias("hour")), ["hour"], "author")
    day = counts.distinct_of(held).select(c("distinct").alias("e_day"))
    half = counts.distinct_of(held.where("hour < 12")).select(c("distinct").alias("e_half"))
    exact = v.posts.agg(F.count_distinct("author").alias("authors"), F.count_distinct(F.when(F.hour("ts") < 12, c("author"))).alias("morning"))
    near = lambda e, n: F.abs(e - n) <= F.greatest(n * 0.03, F.lit(1.0))
    rows = exact.crossJoin(day).crossJoin(half)  # one row each
    return rows.select("authors", near(c("e_day"), c("authors")).alias("estimated"), "morning", near(F.coalesce("e_half", F.lit(0)), c("morning")).alias("morning_estimated"))


@query("weighted_mean", "SELECT round(avg(plays), 4) AS mean FROM posts")
def _(v):
    vc = counts.value_counts(v.posts, ["plays"]).where("plays is not null")
    return vc.agg(R(F.sum(c("plays") * c("n")) / F.sum("n")).alias("mean"))


BINS_SQL = """, b AS (SELECT e AS lo, lead(e) OVER (ORDER BY e) AS hi, lead(e, 2) OVER (ORDER BY e) IS NULL AS closed FROM u),
 h AS (SELECT lo, hi, count(x) AS n FROM b LEFT JOIN v ON x >= lo AND (x < hi OR closed AND x = hi) WHERE hi IS NOT NULL GROUP BY lo, hi) """


@query("log_histogram", """WITH v AS (SELECT plays AS x FROM posts WHERE plays >= 0), m AS (SELECT min(x) AS low, max(x) AS high FROM v),
 g AS (SELECT pow(10, CASE WHEN low = 0 THEN log10(high) * i / 20 ELSE log10(low) + (log10(high) - log10(low)) * i / 20 END) AS e FROM m, (SELECT unnest(range(0, 21)) AS i) UNION ALL SELECT 0.0 FROM m WHERE low = 0),
 u AS (SELECT DISTINCT round_even(e, 0) AS e FROM g)""" + BINS_SQL + "SELECT lo, hi, n FROM h")
def _(v):
    return counts.log_histogram(v.posts.where("plays >= 0"), "plays", 20).select("lo", "hi", "n")


@query("linear_histogram", "SELECT least(CAST(floor(plays * 100.0 / m) AS BIGINT), 99) AS bin, count(*) AS n FROM posts, (SELECT max(plays) AS m FROM posts) WHERE plays >= 0 GROUP BY 1")
def _(v):
    return counts.linear_histogram(v.posts.where("plays >= 0"), "plays", 100)


@query("geom_histogram", """WITH v AS (SELECT create_s - posted_s AS x FROM comments), u AS (SELECT CASE i WHEN 0 THEN 1.0 WHEN 99 THEN high ELSE pow(10, log10(high) * i / 99) END AS e FROM (SELECT max(x) AS high FROM v), (SELECT unnest(range(0, 100)) AS i))""" + BINS_SQL
       + "SELECT round(lo, 3) AS lo, round(hi, 3) AS hi, n, round(n / sum(n) OVER (), 6) AS share FROM h")
def _(v):
    rows = v.comments.select((c("create_s") - c("posted_s")).alias("o"))
    return counts.geometric_histogram_to_max(rows, "o").select(R(c("lo"), 3).alias("lo"), R(c("hi"), 3).alias("hi"), "n", R(c("share"), 6).alias("share"))


@query("offset_hist_by_activity", """WITH a AS (SELECT uid, count(*) AS m FROM comments GROUP BY uid), t AS (SELECT unnest([1, 5, 25]) AS least)
 SELECT least, CAST(floor(ln(create_s - posted_s) / ln(2)) AS BIGINT) AS bin, count(*) AS n FROM comments JOIN a USING (uid) JOIN t ON m >= least WHERE create_s - posted_s >= 1 GROUP BY 1, 2""")
def _(v):
    active = counts.value_counts(v.comments, ["uid"]).withColumnRenamed("n", "m")
    rows = v.comments.join(active, "uid").withColumn("least", F.explode(F.array(*map(F.lit, (1, 5, 25))))).where("m >= least")
    return counts.geometric_histogram(rows.withColumn("o", c("create_s") - c("posted_s")), "o", 2.0, ["least"])


@query("share_by_country", "SELECT loc, count(*) AS total, round(avg(CASE WHEN plays > 5000 THEN 1.0 ELSE 0.0 END), 4) AS share, count(*) >= 50 AS significant FROM posts GROUP BY loc")
def _(v):
    return counts.shares(v.posts, ["loc"], c("plays") > 5000)


@query("significance_gate", "SELECT loc, count(*) >= 50 AS significant FROM posts GROUP BY loc")
def _(v):
    return counts.shares(v.posts, ["loc"], c("plays") > 5000).select("loc", "significant")


@query("tumbling_weekly", "SELECT epoch_us(date_trunc('week', ts)) // 1000000 AS week, coalesce(status_msg, 'success') AS status, count(*) AS n, round(count(*) / sum(count(*)) OVER (PARTITION BY date_trunc('week', ts)), 4) AS share FROM posts GROUP BY date_trunc('week', ts), 2")
def _(v):
    n = v.posts.groupBy(F.unix_timestamp(F.date_trunc("week", "ts")).alias("week"), F.coalesce("status_msg", F.lit("success")).alias("status")).agg(F.count(F.lit(1)).alias("n"))
    return counts.with_share(n, ["week"])


for _unit in ("minute", "hour"):
    query(f"tumbling_{_unit}", f"SELECT epoch_us(date_trunc('{_unit}', ts)) // 1000000 AS at, count(*) AS n FROM posts GROUP BY 1")(
        lambda v, unit=_unit: v.posts.groupBy(F.unix_timestamp(F.date_trunc(unit, "ts")).alias("at")).agg(F.count(F.lit(1)).alias("n")))


@query("tumbling_minute_hour", "SELECT epoch_us(date_trunc('minute', ts)) // 1000000 AS minute, epoch_us(date_trunc('hour', ts)) // 1000000 AS hour, count(*) AS n FROM posts GROUP BY ALL")
def _(v):
    return v.posts.groupBy(*[F.unix_timestamp(F.date_trunc(u, "ts")).alias(u) for u in ("minute", "hour")]).agg(F.count(F.lit(1)).alias("n"))


@query("fetch_timeline", """WITH f AS (SELECT create_s // 60 * 60 AS at, count(*) AS fetches, count(status_msg) AS exceptions FROM posts GROUP BY 1)
 SELECT t."at" AS at, coalesce(fetches, 0) AS fetches, coalesce(exceptions, 0) AS exceptions FROM (SELECT unnest(range(min(f.at), max(f.at) + 1, 60)) AS "at" FROM f) t LEFT JOIN f ON t."at" = f."at" """)
def _(v):
    """By minute, as a second of the given month is empty as a rule; minutes without fetches are there, too."""
    return counts.timeline(v.posts.select("create_s", "status_msg"), "create_s", 60, fetches=F.count(F.lit(1)), exceptions=F.count("status_msg"))


@query("extrapolate_sample", """WITH m AS (SELECT hour(ts) AS h, minute(ts) AS m, count(*) AS n FROM posts GROUP BY 1, 2), f AS (SELECT avg(n) / max(CASE WHEN m = 42 THEN n END) AS factor FROM m WHERE h = 19)
 SELECT h, round(n * 60 * factor, 4) AS estimate FROM m, f WHERE m = 42""")
def _(v):
    """An hour from its minute 42, times how the whole hour 19 relates to its own minute 42."""
    per = v.posts.groupBy(F.hour("ts").alias("h"), F.minute("ts").alias("m")).agg(F.count(F.lit(1)).alias("n"))  # 1440 rows
    return counts.extrapolated(per, "h", "m", 42, per.where("h = 19")).select("h", R(c("estimate")).alias("estimate"))


@query("fold_by_second", "SELECT s, count(*) AS seconds, round(avg(n), 4) AS mean, round(stddev_samp(n), 4) AS sd FROM (SELECT create_s % 60 AS s, create_s, count(*) AS n FROM posts GROUP BY 1, 2) GROUP BY s")
def _(v):
    per = v.posts.groupBy((c("create_s") % 60).alias("s"), "create_s").agg(F.count(F.lit(1)).alias("n"))
    return per.groupBy("s").agg(F.count(F.lit(1)).alias("seconds"), R(F.avg("n")).alias("mean"), R(F.stddev_samp("n")).alias("sd"))


@query("spike_means", "SELECT round(avg(CASE WHEN minute(ts) = 0 THEN plays END), 4) AS at_zero, round(avg(CASE WHEN minute(ts) <> 0 THEN plays END), 4) AS rest FROM posts")
def _(v):
    zero = F.minute("ts") == 0
    return v.posts.agg(R(F.avg(F.when(zero, c("plays")))).alias("at_zero"), R(F.avg(F.when(~zero, c("plays")))).alias("rest"))


@query("top_k", "SELECT id, plays FROM posts ORDER BY plays DESC, id LIMIT 20")
def _(v):
    return counts.top_k(v.posts.select("id", "plays"), [F.desc("plays"), "id"], 20)


@query("union_slices", "SELECT DISTINCT id FROM posts WHERE hour(ts) = 19 OR minute(ts) = 42")
def _(v):
    p = v.posts.select("id", "ts")
    return counts.keep_first(p.where(F.hour("ts") == 19).unionByName(p.where(F.minute("ts") == 42)), ["id"], ["ts"]).select("id")


@query("dedup_keep_first", "SELECT author, min(event_id) AS event_id FROM posts GROUP BY author")
def _(v):
    return counts.keep_first(v.posts.select("author", "event_id"), ["author"], ["event_id"])


@query("ids_intersection", "SELECT event_id AS id FROM events INTERSECT SELECT o_orderkey FROM orders")
def _(v):
    return v.table("events").select(c("event_id").alias("id")).intersect(v.table("orders").select("o_orderkey"))


@query("ids_difference", "SELECT event_id AS id FROM events EXCEPT SELECT doc_id FROM labels")
def _(v):
    return v.table("events").select(c("event_id").alias("id")).distinct().join(v.table("labels").select(c("doc_id").alias("id")), "id", "left_anti")
