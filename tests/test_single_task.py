"""Queries over ranks and running maxima that mustn't take whole tables through one task."""

import re
from types import SimpleNamespace

from pyspark.sql import Window
from pyspark.sql import functions as F

from tidemark.plans import registry

registry.queries()


def test_pareto_front(spark):
    """Authors with equal n, equal means and no known plays; only one row for each n may reach the window."""
    rows = [(a, None if a % 7 == 0 or n > 11 else (a * 37 % 50)) for a in range(1, 60) for n in [1 + a * 13 % 12] for _ in range(n)]
    posts = spark.createDataFrame(rows, "author long, plays long")
    a = posts.groupBy("author").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("plays"), 4).alias("mean"))
    best, want, order = None, [], lambda r: (-r["n"], r["mean"] is None, -(r["mean"] or 0), r["author"])
    for r in sorted(a.collect(), key=order):
        if best is None or (r["mean"] is not None and r["mean"] > best):
            want.append(tuple(r))
        best = max((x for x in (best, r["mean"]) if x is not None), default=None)
    got = registry._queries["win_pareto"](SimpleNamespace(posts=posts))
    assert any(m is None for _, _, m in want) and sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, want))
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert re.search(r"Window \[.*?Aggregate \[n#", plan, re.S)


def test_folds(spark):
    labels = spark.range(3000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 10 > 0, (F.col("id") % 3 == 0).cast("int")).alias("toxic"))
    rn = F.row_number().over(Window.partitionBy("toxic").orderBy(F.md5(F.concat_ws(":", "doc_id", F.lit(7))), "doc_id")) - 1
    want = sorted(map(str, labels.select("doc_id", "toxic", (rn % 5).alias("fold")).collect()))
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        spread = registry._queries["stratified_folds"](SimpleNamespace(table=lambda name: labels)).select("*", F.spark_partition_id().alias("at")).collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
    assert sorted(str(r).replace(f", at={r['at']}", "") for r in spread) == want
    assert min(sum(r["at"] == k for r in spread) for k in range(4)) > 300
