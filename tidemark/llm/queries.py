"""The numbered operators and the pipeline as queries over whole tables, and SQL for those that it can express."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import alignment, audit, bpe, fingerprint, imi, language, lm, minhash, packing, pieces, suffix, toxicity, windows

Query = Callable[[SparkSession, str], DataFrame]
BYTE_BPE, WORD_BPE, PIECE_BPE = "byte_bpe_50k.json", "word_bpe_49k.json", "piece_bpe_32k.model"


def fold(n: int, k: int):
    """Whether crc32(doc_id as text) mod n is k; a null doc_id is in no fold."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % n == k, F.lit(False))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = toxicity.learn(docs, table(spark, sf_dir, "labels"), ~fold(3, 1))
    out = docs.select("doc_id", fold(3, 1).alias("held_out"), toxicity.verdict(docs, model).alias("v"))
    return out.select("doc_id", "held_out", F.col("v.score").alias("score"), (F.col("v.score") >= 0.7).cast("int").alias("predicted"),
                      F.col("v.evidence").alias("evidence"))


def op2_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = bpe.round_trip(table(spark, sf_dir, "documents"), public_tokenizers.path(BYTE_BPE))
    return out.select("doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op3_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.lm_scores(table(spark, sf_dir, "documents"), fold(7, 2))


def op4_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return windows.dedup_window_digests(table(spark, sf_dir, "documents"))


def op5_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = language.learn(docs, ~fold(3, 1))
    return docs.select("doc_id", fold(3, 1).alias("held_out"), language.verdict(docs, model).alias("v")).select(
        "doc_id", "held_out", F.col("v.lang_pred").alias("lang_pred"), F.col("v.score").alias("score"), F.col("v.ambiguous").alias("ambiguous"))


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path(WORD_BPE))


def op7_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents"))


def op8_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return imi.search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


def op9_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint.fingerprints(table(spark, sf_dir, "documents"))


def op10_suffixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix.dedup_byte_digests(table(spark, sf_dir, "documents"))


def op11_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op12_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.align(table(spark, sf_dir, "documents"), public_tokenizers.path(BYTE_BPE), public_tokenizers.path(PIECE_BPE))


def op13_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = pieces.round_trip(table(spark, sf_dir, "documents"), public_tokenizers.path(PIECE_BPE))
    return out.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
                      F.sha2("decoded", 256).alias("decoded_sha256"), F.coalesce(F.array_max("ends"), F.lit(0)).cast("long").alias("n_bytes"))


def queries() -> dict[str, Query]:
    import corpus_pipeline

    own = (op1_toxicity, op2_bpe, op3_lm, op4_windows, op5_language, op6_packing, op7_minhash, op8_neighbours, op9_fingerprints, op10_suffixes,
           op11_audit, op12_alignment, op13_pieces)
    return {f.__name__: f for f in own} | {"pipeline": corpus_pipeline.run}


WINDOWS_SQL = r"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS (SELECT doc_id, ws, unnest(range(1, len(ws) - 18)) AS i FROM w WHERE len(ws) >= 20),
k AS (SELECT doc_id, i, row_number() OVER (PARTITION BY array_to_string(ws[i:i + 19], ' ') ORDER BY doc_id, i) AS rn FROM s),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 20)) AS p FROM k WHERE rn > 1),
n AS (SELECT doc_id, count(*) AS n FROM gone GROUP BY doc_id),
each_word AS (SELECT doc_id, unnest(ws) AS word, unnest(range(1, len(ws) + 1)) AS p FROM w),
kept AS (SELECT e.doc_id, string_agg(e.word, ' ' ORDER BY e.p) AS t FROM each_word e ANTI JOIN gone g ON e.doc_id = g.doc_id AND e.p = g.p GROUP BY e.doc_id)
SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(n.n, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept.t, '')) AS kept_sha256
FROM w LEFT JOIN n ON w.doc_id = n.doc_id LEFT JOIN kept ON w.doc_id = kept.doc_id
"""
MINHASH_SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(ws[i:i + 4], ' ') AS g FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 3, 2))) AS i FROM w WHERE len(ws) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2),
l AS (SELECT p.a, p.b FROM p JOIN n x ON p.a = x.doc_id JOIN n y ON p.b = y.doc_id WHERE 100 * p.c >= 85 * (x.n + y.n - p.c)),
r(a, b) AS (SELECT doc_id, doc_id FROM w UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a),
c AS (SELECT a AS doc_id, min(b) AS component_id FROM r GROUP BY a)
SELECT w.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, c.component_id, c.component_id = w.doc_id AS kept
FROM w LEFT JOIN n ON w.doc_id = n.doc_id JOIN c ON w.doc_id = c.doc_id
"""


AUDIT_SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
f AS (SELECT doc_id, part, CAST(len(ws) < 200 AS INTEGER) + 2 * CAST(100 * len(list_distinct(ws)) < 50 * len(ws) AS INTEGER)
  + 4 * CAST(100 * (length(t) - length(regexp_replace(t, '[A-Z]', '', 'g'))) > 3 * length(t) AS INTEGER) + 8 * CAST(regexp_matches(t, '[#$%&*|]') AS INTEGER)
  + 16 * CAST(coalesce(doc_id > min(doc_id) OVER (PARTITION BY t), FALSE) AS INTEGER) AS fails FROM w),
l AS (SELECT doc_id, max(CAST(quality = 1 AS INTEGER)) AS good, max(CAST(toxic = 1 AS INTEGER)) AS toxic FROM labels GROUP BY doc_id),
cell AS (SELECT part, fails, count(*) AS n, coalesce(sum(good), 0) AS good, coalesce(sum(toxic), 0) AS toxic FROM f LEFT JOIN l ON f.doc_id = l.doc_id GROUP BY ALL),
orders(o) AS (SELECT '' UNION ALL SELECT o || letter FROM orders, (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS letter) WHERE NOT contains(o, letter)),
steps AS (SELECT o, step, o[step] AS letter, 1 << (ascii(o[step]) - 65) AS own, CAST(list_sum([0] || list_transform(range(1, step), lambda i: 1 << (ascii(o[i]) - 65))) AS BIGINT) AS before
  FROM (SELECT o, unnest(range(1, 6)) AS step FROM orders WHERE length(o) = 5)),
s AS (SELECT part, o, step, letter, sum(CASE WHEN fails & before = 0 AND fails & own = 0 THEN n ELSE 0 END) AS kept,
  sum(CASE WHEN fails & before = 0 AND fails & own > 0 THEN n ELSE 0 END) AS removed, sum(CASE WHEN fails & before > 0 AND fails & own > 0 THEN n ELSE 0 END) AS redundant,
  sum(CASE WHEN fails = own THEN n ELSE 0 END) AS unique_fails, sum(CASE WHEN fails & before = 0 AND fails & own > 0 THEN good ELSE 0 END) AS good_lost,
  sum(CASE WHEN fails & before = 0 AND fails & own > 0 THEN toxic ELSE 0 END) AS toxic_lost FROM cell, steps GROUP BY ALL)
SELECT part, o AS filter_order, CAST(step AS INTEGER) AS step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed, CAST(redundant AS BIGINT) AS redundant,
 CAST(unique_fails AS BIGINT) AS unique_fails, CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost, CAST(sum(removed) OVER (PARTITION BY part, letter) AS BIGINT) AS shapley FROM s
"""


def oracle_sql() -> dict[str, str]:
    return {"op11_audit": AUDIT_SQL, "op4_windows": WINDOWS_SQL, "op7_minhash": MINHASH_SQL}
