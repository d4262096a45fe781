"""Posts, comments and their dimensions, derived from the given tables, with the same definitions in SQL."""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import ids

SQL = {
    "posts": """SELECT event_id, user_id, event_type, value, e.ts, CAST(epoch_us(e.ts) // 1000000 AS BIGINT) AS create_s,
 CAST((epoch_us(e.ts) // 1000) % 1000 AS BIGINT) AS ms, event_id % 32 AS counter, user_id % 4 AS dc, user_id % 17 AS worker,
 CAST(epoch_us(e.ts) // 1000000 AS BIGINT) * 4294967296 + CAST((epoch_us(e.ts) // 1000) % 1000 AS BIGINT) * 4194304 + (event_id % 32) * 16384 + (user_id % 4) * 256 + user_id % 17 AS id,
 user_id AS author, CAST(round(value * 100) AS BIGINT) AS plays, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k,
 '#' || event_type || ' #k' || json_extract_string(props, '$.k') AS descr, n_name AS loc,
 CASE WHEN event_type = 'error' THEN CASE event_id % 5 WHEN 0 THEN 'status_deleted' WHEN 1 THEN 'status_self_see' ELSE 'item doesn''t exist' END END AS status_msg,
 CASE WHEN event_type = 'error' THEN 10204 END AS status_code FROM events e LEFT JOIN nation ON n_nationkey = user_id % 25""",
    "comments": """SELECT l_orderkey * 10 + l_linenumber AS cid, o_custkey AS uid, l_partkey AS post, l_suppkey AS author, l_suppkey % 5 AS small_author,
 CAST(epoch_us(o_orderdate) // 1000000 AS BIGINT) AS posted_s, CAST(epoch_us(l_shipdate) // 1000000 AS BIGINT) AS create_s, l_shipmode AS lang FROM lineitem JOIN orders ON l_orderkey = o_orderkey""",
    "countries": """SELECT n_nationkey, n_name AS loc, n_regionkey, CAST((n_nationkey + 1) * 1000003 AS BIGINT) AS population,
 0.1 + 0.01 * n_nationkey AS young_share, CASE n_regionkey WHEN 0 THEN 0.92 WHEN 1 THEN 0.96 WHEN 2 THEN 0.97 WHEN 3 THEN 0.91 ELSE 1.0 END AS coverage FROM nation""",
    "predictions": """SELECT doc_id, toxic AS label, quality, (doc_id * 7919 % 1000) / 1000.0 AS prob, (doc_id * 104729 % 1000) / 1000.0 AS prob2 FROM labels""",
}
SQL["comments"] = SQL["comments"].replace(", l_shipmode AS lang", ", l_returnflag AS lang")


class Views:
    """One scale's tables and views, read lazily."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def table(self, name: str) -> DataFrame:
        df = self.spark.read.parquet(f"{self.folder}/{name}.parquet")
        return df.select(*[F.col(c).cast("timestamp").alias(c) if t == "timestamp_ntz" else F.col(c) for c, t in df.dtypes])

    @functools.cached_property
    def posts(self) -> DataFrame:
        k = F.get_json_object("props", "$.k")
        e, n = self.table("events"), self.table("nation")
        sec, ms = F.unix_timestamp("ts"), F.date_format("ts", "SSS").cast("long")
        status = F.when(F.col("event_type") == "error", F.when(F.col("event_id") % 5 == 0, "status_deleted").when(
            F.col("event_id") % 5 == 1, "status_self_see").otherwise("item doesn't exist"))
        rows = e.select(
            "event_id", "user_id", "event_type", "value", "ts", sec.alias("create_s"), ms.alias("ms"), (F.col("event_id") % 32).alias("counter"),
            (F.col("user_id") % 4).alias("dc"), (F.col("user_id") % 17).alias("worker"),
            ids.compose(sec, ms, F.col("event_id") % 32, (F.col("user_id") % 4) * 256 + F.col("user_id") % 17).alias("id"),
            F.col("user_id").alias("author"), F.round(F.col("value") * 100).cast("long").alias("plays"), k.cast("long").alias("k"),
            F.concat(F.lit("#"), "event_type", F.lit(" #k"), k).alias("descr"), status.alias("status_msg"),
            F.when(F.col("event_type") == "error", 10204).alias("status_code"))
        return rows.join(F.broadcast(n.select(F.col("n_nationkey").cast("long").alias("_n"), F.col("n_name").alias("loc"))), F.col("user_id") % 25 == F.col("_n"), "left").drop("_n")

    @functools.cached_property
    def comments(self) -> DataFrame:
        rows = self.table("lineitem").join(self.table("orders"), F.col("l_orderkey") == F.col("o_orderkey"))
        return rows.select(
            (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("cid"), F.col("o_custkey").alias("uid"), F.col("l_partkey").alias("post"),
            F.col("l_suppkey").alias("author"), (F.col("l_suppkey") % 5).alias("small_author"), F.unix_timestamp("o_orderdate").alias("posted_s"),
            F.unix_timestamp("l_shipdate").alias("create_s"), F.col("l_returnflag").alias("lang"))

    @functools.cached_property
    def countries(self) -> DataFrame:
        n = F.col("n_nationkey")
        coverage = F.when(F.col("n_regionkey") == 0, 0.92).when(F.col("n_regionkey") == 1, 0.96).when(F.col("n_regionkey") == 2, 0.97).when(
            F.col("n_regionkey") == 3, 0.91).otherwise(1.0)
        return self.table("nation").select("n_nationkey", F.col("n_name").alias("loc"), "n_regionkey", ((n + 1) * 1000003).cast("long").alias("population"),
                                           (F.lit(0.1) + n * 0.01).alias("young_share"), coverage.alias("coverage"))

    @functools.cached_property
    def predictions(self) -> DataFrame:
        return self.table("labels").select("doc_id", F.col("toxic").alias("label"), "quality", (F.col("doc_id") * 7919 % 1000 / 1000.0).alias("prob"),
                                           (F.col("doc_id") * 104729 % 1000 / 1000.0).alias("prob2"))
