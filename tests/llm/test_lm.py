"""The language model knows bigrams that training holds once."""

import pytest
from pyspark.sql import functions as F

from tidemark.llm import lm


@pytest.mark.parametrize("mb", [256, 0])
def test_a_bigram_seen_once_scores_above_one_never_seen(spark, mb):
    """All words stand equally often in training; only the bigrams of documents 100 and 102 stand there, once and twice."""
    rows = [(0, "a b c d e f g h"), (1, "h g f e d c b a"), (2, "p q r p s r q s"), (3, "q p s p"), (4, "p q"), (100, "a b"), (101, "a d"), (102, "p q"), (103, "p p")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: r for r in lm.lm_scores(docs, F.col("doc_id") >= 100, 0.005, max_filter_mb=mb).collect()}
    assert abs(got[100]["base_score"] - got[101]["base_score"]) < 1e-9
    assert got[100]["score"] > got[101]["score"] + 0.1
    assert got[102]["score"] > got[103]["score"] + 0.1


def test_levels_give_counts_and_masses_back():
    import numpy as np

    counts = np.arange(1, 2000)
    back = lm.bigram_count(np.floor(np.log2(counts)).astype(np.int64) + 1) + lm.LESS
    assert back[0] == 1 and (abs(np.log2(back / counts)) < 0.6).all()
    mass = np.array([1 - lm.LESS, 2 * (1 - lm.LESS), 1, 2.3, 100, 1e6])
    level = lm.context_level(mass)
    assert (lm.context_mass(level) >= mass * (1 - 1e-6)).all() and (lm.context_mass(level) < 1.5 * mass).all() and level[0] == 0
