"""Files in and out, listings, zones and headers."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import network
from ..sources import files
from .registry import query

c = F.col


def one():
    return F.count(F.lit(1))


#: Larger files are read by line; fetched documents over lines are smaller than this.
SMALL_FILE = 100_000


def fetched(v) -> str:
    """Conversations as fetched comment answers: of each 20 one document, every other one spread over lines in a file of its own, some without comments.

    Among the documents in lines every other line is broken off.
    """
    user = F.struct((c("conv_id") % 97).alias("uid"), F.length("text").cast("long").alias("follower_count"), c("turn").alias("following_count"))
    comment = F.struct((c("conv_id") * 1000 + c("turn")).alias("cid"), "text", user.alias("user"))
    docs = v.table("conversations").groupBy(F.floor(c("conv_id") / 20).alias("d")).agg(F.collect_list(comment).alias("comments"))  # 20 conversations a document
    data = F.when(c("d") % 7 != 3, F.struct("comments"))
    folder = files.scratch(v.spark, "answers")
    pretty = docs.where("d % 2 = 0").select(F.to_json(F.struct(data.alias("data")), {"pretty": "true"}))
    pretty.write.option("maxRecordsPerFile", 1).text(f"{folder}/kind=pretty")
    line = F.to_json(F.struct(data.alias("data")))
    docs.where("d % 2 = 1").select(F.explode(F.array(line, F.substring(line, F.lit(1), F.length(line) - 3)))).write.text(f"{folder}/kind=lines")
    return folder


@query("ingest_comments_json", "SELECT conv_id * 1000 + turn AS cid, text, conv_id % 97 AS uid FROM conversations WHERE (conv_id // 20) % 7 <> 3")
def _(v):
    return files.comments(files.read_json_documents(v.spark, fetched(v), files.COMMENTS, SMALL_FILE)).select("cid", "text", "uid")


@query("extract_commenter_profiles", """SELECT conv_id % 97 AS uid, arg_min(length(text), conv_id * 1000 + turn) AS follower_count, arg_min(turn, conv_id * 1000 + turn) AS following_count
 FROM conversations WHERE (conv_id // 20) % 7 <> 3 GROUP BY 1""")
def _(v):
    rows = files.comments(files.read_json_documents(v.spark, fetched(v), files.COMMENTS, SMALL_FILE))
    first = F.min_by(F.struct("follower_count", "following_count"), "cid")
    return rows.groupBy("uid").agg(first.alias("u")).select("uid", "u.*")


@query("salvage_json_records", """WITH r AS (SELECT doc_id // 20 AS d, doc_id, toxic, '{"id":' || doc_id || ',"toxic":' || toxic || ',"note":"a } b, {"}' AS t FROM labels),
 p AS (SELECT d, doc_id, toxic, 1 + sum(length(t)) OVER w + row_number() OVER w - 1 AS stop, sum(length(t) + 1) OVER (PARTITION BY d) + 1 AS whole FROM r WINDOW w AS (PARTITION BY d ORDER BY doc_id ROWS UNBOUNDED PRECEDING))
 SELECT d, doc_id AS id, toxic FROM p WHERE stop <= CASE WHEN d % 3 = 0 THEN whole ELSE whole * 7 // 10 END""")
def _(v):
    record = F.to_json(F.struct(c("doc_id").alias("id"), "toxic", F.lit("a } b, {").alias("note")))
    docs = v.table("labels").groupBy(F.floor(c("doc_id") / 20).alias("d")).agg(F.array_sort(F.collect_list(F.struct("doc_id", record.alias("t")))).alias("g"))
    whole = F.concat(F.lit("["), F.array_join(F.transform("g", lambda x: x["t"]), ","), F.lit("]"))
    cut = docs.select("d", F.when(c("d") % 3 == 0, whole).otherwise(F.substring(whole, F.lit(1), F.floor(F.length(whole) * 7 / 10).cast("int"))).alias("text"))
    return files.salvage(cut, "text", "id bigint, toxic int, note string").where(f"record.{files.CORRUPT} is null").select("d", "record.id", "record.toxic")


@query("read_csv_preamble", "SELECT n_nationkey AS code, n_name || ', \"' || n_regionkey || '\"' AS name, n_regionkey AS region FROM nation")
def _(v):
    name = F.concat("n_name", F.lit(', "'), "n_regionkey", F.lit('"'))
    line = F.to_csv(F.struct(c("n_nationkey").alias("code"), name.alias("name"), c("n_regionkey").alias("region")), {"escape": '"', "quoteAll": "true"})
    lines = v.table("nation").agg(F.array_join(F.array_sort(F.collect_list(line)), "\r\n").alias("t"))  # a dimension
    path = files.scratch(v.spark, "preamble")
    lines.select(F.concat(F.lit('Source,"made"\r\n\r\nUpdated,today\r\ncode,name,region\r\n'), "t")).write.text(path)
    return files.read_csv_preamble(v.spark, path, "code int, name string, region int", 4)


@query("collect_sidecar_json", "SELECT page_id // 10 AS d, count(*) AS pages, 1700000000 + (page_id // 10) + 0.25 AS at FROM pages GROUP BY page_id // 10")
def _(v):
    rows = v.table("pages").groupBy(F.floor(c("page_id") / 10).alias("d")).agg(one().alias("pages"))
    path = files.scratch(v.spark, "sidecars")
    files.write_sidecars(rows, F.concat((c("d") + 1700000000).cast("string"), F.lit(".25_video")), path)
    return files.read_sidecars(v.spark, path, "d long, pages long").select("d", "pages", "at")


@query("resolve_listing", """WITH l AS (SELECT CASE doc_id % 3 WHEN 0 THEN '/a/' WHEN 1 THEN '/b/' ELSE '/c/' END || doc_id || '.mp4' AS path FROM documents WHERE doc_id % 5 <> 0)
 SELECT doc_id, d || doc_id || '.mp4' AS path FROM labels, (SELECT unnest(['/a/', '/b/']) AS d) WHERE d || doc_id || '.mp4' IN (SELECT path FROM l)""")
def _(v):
    folder = F.when(c("doc_id") % 3 == 0, "/a/").when(c("doc_id") % 3 == 1, "/b/").otherwise("/c/")
    listing = v.table("documents").where("doc_id % 5 <> 0").select(F.concat(folder, "doc_id", F.lit(".mp4")).alias("path"))
    return files.resolve_listing(v.table("labels").select("doc_id"), ["/a/", "/b/"], F.concat("doc_id", F.lit(".mp4")), listing).select("doc_id", "path")


@query("sink_parquet", "SELECT doc_id, quality, toxic FROM labels")
def _(v):
    path, rows = files.scratch(v.spark, "sink"), v.table("labels").select("doc_id", "quality", "toxic")
    files.sink_parquet(rows, path)
    return v.spark.read.schema(rows.schema).parquet(path)


@query("sink_partitioned_csv", "SELECT loc, descr, count(*) AS n FROM posts GROUP BY 1, 2")
def _(v):
    path, rows = files.scratch(v.spark, "sink"), v.posts.groupBy("loc", "descr").agg(one().alias("n"))
    files.sink_partitioned_csv(rows, path, "loc")
    return v.spark.read.schema("descr string, n long, loc string").option("header", True).csv(path)


#: Time zones of the made-up countries: two of this list each, none for every sixth.
ZONES = ("America/Toronto", "Europe/Paris", "Asia/Tokyo", "Australia/Sydney", "America/Sao_Paulo", "Asia/Kolkata", "UTC", "America/Los_Angeles", "Africa/Lagos", "Asia/Kathmandu")
ZONED_SQL = f"""WITH z AS (SELECT n_name AS loc, [{', '.join(map(repr, ZONES))}][n_nationkey % 10 + 1] AS a, [{', '.join(map(repr, ZONES))}][n_nationkey * 3 % 10 + 1] AS b FROM nation WHERE n_nationkey % 6 <> 5),
 h AS (SELECT event_id, (hour((ts AT TIME ZONE 'UTC') AT TIME ZONE a) + hour((ts AT TIME ZONE 'UTC') AT TIME ZONE b)) // 2 AS local_hour FROM posts LEFT JOIN z ON posts.loc = z.loc) """


def zoned(v):
    names = F.array(*map(F.lit, ZONES))
    zones = F.array(F.element_at(names, (c("n_nationkey") % 10 + 1).cast("int")), F.element_at(names, (c("n_nationkey") * 3 % 10 + 1).cast("int")))
    table = v.table("nation").where("n_nationkey % 6 <> 5").select(c("n_name").alias("loc"), zones.alias("zones"))
    return v.posts.join(F.broadcast(table), "loc", "left").select("event_id", network.local_hour(c("ts"), c("zones")).alias("local_hour"))


@query("local_hour", ZONED_SQL + "SELECT event_id, local_hour FROM h")
def _(v):
    return zoned(v)


@query("local_hour_share", ZONED_SQL + "SELECT local_hour, count(*) AS n, round(count(*) / (SELECT count(local_hour) FROM h), 6) AS share FROM h WHERE local_hour IS NOT NULL GROUP BY local_hour")
def _(v):
    h = zoned(v).where("local_hour is not null")
    total = h.agg(one().alias("t"))
    return h.groupBy("local_hour").agg(one().alias("n")).crossJoin(F.broadcast(total)).select("local_hour", "n", F.round(c("n") / c("t"), 6).alias("share"))


@query("parse_cache_headers", r"""WITH h AS (SELECT page_id, CASE page_id % 4 WHEN 0 THEN 'TCP_HIT' WHEN 3 THEN 'NONE' ELSE 'TCP_MISS' END || ' from a23-' || page_id % 200 || '-6-1.deploy.net (x)' AS xc,
  CASE WHEN page_id % 3 = 0 THEN CASE WHEN page_id % 2 = 0 THEN 'TCP_HIT' ELSE 'TCP_MISS' END || ' from a9-8-7-' || page_id % 100 || '.deploy.net' END AS xr,
  CASE WHEN page_id % 5 < 2 THEN '12,10.0.0.' || page_id % 50 || ', 13,10.0.1.1, 14,10.0.2.2' END AS xp, CASE WHEN page_id % 7 = 0 THEN '[a=1.2.3.' || page_id % 9 || ',b=2][a=4.5.6.7,c]' END AS xd,
  CASE WHEN page_id % 11 = 0 THEN '40,99.1.1.' || page_id % 20 END AS xo FROM pages),
 p AS (SELECT *, CASE WHEN contains(xc, 'TCP_') THEN replace(regexp_extract(xc, 'from a([0-9\-]+).deploy', 1), '-', '.') END AS c1, replace(regexp_extract(xr, 'from a([0-9\-]+).deploy', 1), '-', '.') AS c2,
  list_transform(string_split(xp, ', '), lambda s: string_split(s, ',')[2]) AS par, regexp_extract_all(xd, '\[a=([0-9\.]+),', 1) AS dbg, string_split(xo, ',')[2] AS org FROM h)
 SELECT page_id, CASE WHEN c1 IS NOT NULL THEN contains(xc, 'TCP_HIT') END AS cache_hit, contains(xr, 'TCP_HIT') AS remote_hit, c1 AS cache_ip, c2 AS remote_ip, org AS origin_ip, coalesce(org, dbg[-1], par[1]) AS final_ip,
  concat_ws('>', c1, c2, par[3], par[2], dbg[1], org) AS ips FROM p""")
def _(v):
    i = c("page_id")
    say = lambda *parts: F.concat(*[p if not isinstance(p, str) else F.lit(p) for p in parts])
    kind = F.when(i % 4 == 0, "TCP_HIT").when(i % 4 == 3, "NONE").otherwise("TCP_MISS")
    headers = {
        "x-cache": say(kind, " from a23-", i % 200, "-6-1.deploy.net (x)"),
        "x-cache-remote": F.when(i % 3 == 0, say(F.when(i % 2 == 0, "TCP_HIT").otherwise("TCP_MISS"), " from a9-8-7-", i % 100, ".deploy.net")),
        "x-parent-response-time": F.when(i % 5 < 2, say("12,10.0.0.", i % 50, ", 13,10.0.1.1, 14,10.0.2.2")),
        "akamai-amd-bc-debug": F.when(i % 7 == 0, say("[a=1.2.3.", i % 9, ",b=2][a=4.5.6.7,c]")),
        "x-origin-response-time": F.when(i % 11 == 0, say("40,99.1.1.", i % 20))}
    rows = v.table("pages").select("page_id", F.map_filter(F.create_map(*[x for k, e in headers.items() for x in (F.lit(k), e)]), lambda k, x: x.isNotNull()).alias("headers"))
    p = network.cache_path(c("headers"))
    return rows.select("page_id", p.alias("p")).select("page_id", "p.cache_hit", "p.remote_hit", "p.cache_ip", "p.remote_ip", "p.origin_ip", "p.final_ip", F.array_join("p.ips", ">").alias("ips"))


@query("cached_results_merge", "SELECT doc_id, coalesce(CAST(quality AS BIGINT) + 100, len(regexp_extract_all(text, '[a-z]+'))) AS value, quality IS NOT NULL AS cached FROM documents LEFT JOIN labels USING (doc_id)")
def _(v):
    """Values of labelled documents from the cache, of others computed, from the rows that miss only."""
    cache = v.table("labels").groupBy("doc_id").agg((F.max("quality").cast("long") + 100).alias("value"))
    docs = v.table("documents").select("doc_id", "text")
    hits = docs.select("doc_id").join(cache, "doc_id").select("doc_id", "value", F.lit(True).alias("cached"))
    words = F.size(F.regexp_extract_all("text", F.lit("[a-z]+"), F.lit(0))).cast("long")
    misses = docs.join(cache, "doc_id", "left_anti").select("doc_id", words.alias("value"), F.lit(False).alias("cached"))
    return hits.unionByName(misses).dropDuplicates(["doc_id"])
