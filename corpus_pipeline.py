"""A training corpus from raw documents: filter, deduplicate, pack. Counted as part of tidemark.llm.

Every stage takes empty tables, nulls in any column, repeated rows, rows of one doc_id with unlike texts, and
extra columns of any name; all but the last give the columns of their input back.
"""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import language, minhash, packing, suffix, toxicity
from tidemark.llm.components import let_go
from tidemark.llm.queries import WORD_BPE, fold
from tidemark.session import ship

#: Hundredths of similarity of near duplicates. op7's contract of 85 binds op7 only; this stage has the job's 0.8.
NEAR = 80
#: SQL can't express the classifiers, the tokenizer or the packing; tests compare with plain Python.
ORACLE_SQL = None


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which a language can be told (operator 5); null texts and texts without a letter go. Repeated rows go or stay together."""
    let_go(ship(spark))
    model = language.learn(docs, ~fold(3, 1))
    return docs.where(language.verdict(docs, model)["lang_pred"] != "und").select(*docs.columns)


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score below 0.7 (operator 1). Null and empty texts have the score of texts without known terms; without labels all stay."""
    let_go(ship(spark))
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = toxicity.learn(docs, labels, ~fold(3, 1))
    return docs.where(toxicity.verdict(docs, model)["score"] < 0.7).select(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The row of the smallest doc_id of each group of near duplicates (operator 7 at 0.8), one of equal rows; null ids and texts without words stay."""
    let_go(ship(spark))
    return minhash.without_near_duplicates(docs, threshold=NEAR).select(*docs.columns)


def drop_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the passages of 200 bytes or more that stand elsewhere too, in every copy (operator 10); n_chars, if there, follows. Null texts stay null."""
    let_go(ship(spark))
    left = suffix.dedup_texts(docs)
    if "n_chars" in docs.columns:
        left = left.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType))
    return left.select(*docs.columns)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of 4096 tokens (operator 6); a null text is its end alone, repeated rows are documents of their own."""
    let_go(ship(spark))
    return packing.pack(docs, public_tokenizers.path(WORD_BPE))


STAGES = [
    ("language", identify_language),
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("repeated_passages", drop_repeated_passages),
    ("packing", pack_sequences),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written to the shared checkpoint folder and read again."""
    ship(spark)
    top = spark.sparkContext._jsc.sc().getCheckpointDir()
    folder = f"{top.get()}/pipeline-{uuid.uuid4().hex}"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{k}-{name}")
        docs = spark.read.parquet(f"{folder}/{k}-{name}")
    return docs
