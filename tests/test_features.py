"""The feature chain against dense matrices in NumPy."""

import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.operators import features

TAGS = ["a", "b", "c", "rare", "often", "twin"]


@pytest.fixture(scope="module")
def data():
    rng = random.Random(9)
    rows = []
    for i in range(300):
        tags = [t for t, p in zip(TAGS, (0.3, 0.5, 0.2, 0.01, 0.9, 0.0)) if rng.random() < p]
        tags += ["a"] * (rng.random() < 0.2) + ["twin"] * ("b" in tags)
        rows.append((i, tags, rng.gauss(0, 1)))
    return rows + [(300, [], 0.5), (301, None, 0.1)]


def dense(rows, names):
    return np.array([[Counter(t or [])[n] for n in names] for _, t, _ in rows], float)


def vectors(m, width):
    out = {}
    for r in m.collect():
        out[r["key"]] = np.zeros(width)
        out[r["key"]][r["indices"]] = r["values"]
    return np.array([out[k] for k in sorted(out)])


def test_chain(spark, data):
    df = spark.createDataFrame(data, "key long, tags array<string>, y double").repartition(4)
    vocab = features.vocabulary(df, "tags", 2)
    n = Counter(t for _, tags, _ in data for t in tags or [])
    names = sorted((t for t in n if n[t] > 2), key=lambda t: (-n[t], t))
    assert [(r["feature"], r["n"], r["rows"]) for r in vocab.orderBy("idx").collect()] == [(t, n[t], sum(t in (tags or []) for _, tags, _ in data)) for t in names]
    m = features.matrix(df, "key", "tags", vocab)
    x = dense(data, names)
    assert np.array_equal(vectors(m, len(names)), x)  # rows 300 and 301 are there, all zero
    assert {r["idx"]: (r["total"], r["squares"]) for r in features.column_sums(m).collect()} == {i: (x[:, i].sum(), (x[:, i] ** 2).sum()) for i in range(len(names))}
    left, kept = features.prune(m, vocab, 100)
    stay = [t for i, t in enumerate(names) if x[:, i].sum() >= 100]
    assert [r["feature"] for r in kept.orderBy("idx").collect()] == stay and stay != names
    x = dense(data, stay)
    assert np.array_equal(vectors(left, len(stay)), x)
    gram = x.T @ x
    assert {(r["i"], r["j"]): r["dot"] for r in features.moments(left).collect()} == {(i, j): gram[i, j] for i in range(len(stay)) for j in range(i, len(stay)) if gram[i, j]}


@pytest.mark.parametrize("above", [0.8, 0.2, 0.05])
def test_correlations_of_pairs_that_meet_and_that_never_do(spark, above):
    rng = random.Random(3)
    kind = lambda: rng.choice(["p", "p", "p", "q", "q", "r"])
    rows = [(i, [k := kind(), *(["not_p"] * 2 if k != "p" else []), *(["q2"] if k == "q" else []), "all"]) for i in range(400)] + [(400, ["all"])]
    names = ["all", "not_p", "p", "q", "q2", "r"]
    df = spark.createDataFrame(rows, "key long, tags array<string>")
    vocab = features.vocabulary(df, "tags")
    order = [r["feature"] for r in vocab.orderBy("idx").collect()]
    assert sorted(order) == names
    got = {tuple(sorted((order[r["i"]], order[r["j"]]))): r["r"] for r in features.correlated(features.matrix(df, "key", "tags", vocab), above).collect()}
    x = dense([(i, t, 0) for i, t in rows], names)[:, 1:]  # "all" doesn't vary
    r = np.corrcoef(x.T)
    want = {(names[i + 1], names[j + 1]): r[i, j] for i in range(5) for j in range(i + 1, 5) if abs(r[i, j]) > above}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in got) and want[("not_p", "p")] < -0.9


def test_least_squares_with_dependent_columns(spark, data):
    df = spark.createDataFrame(data, "key long, tags array<string>, y double")
    vocab = features.vocabulary(df, "tags", 2)
    names = [r["feature"] for r in vocab.orderBy("idx").collect()]
    assert {"b", "twin"} < set(names)  # the same column
    m = features.matrix(df, "key", "tags", vocab).join(df.select("key", "y", (F.col("key") / 100).alias("z")), "key")
    b, intercept, r2 = features.least_squares(features.with_dense(m, {"z": F.col("z")}), "y", len(names) + 1)
    x, y = np.column_stack([[k / 100 for k, _, _ in data], dense(data, names)]), np.array([v for *_, v in data])
    fitted = np.column_stack([x, np.ones(len(x))]) @ np.linalg.lstsq(np.column_stack([x, np.ones(len(x))]), y, rcond=None)[0]
    assert np.allclose(x @ b + intercept, fitted, atol=1e-8)
    assert abs(b[1 + names.index("b")] - b[1 + names.index("twin")]) < 1e-8  # shared alike
    assert abs(r2 - (1 - ((y - fitted) ** 2).sum() / ((y - y.mean()) ** 2).sum())) < 1e-8
    with pytest.raises(ValueError, match="too many"):
        features.least_squares(m, "y", 5000)


def test_moments_are_added_up_in_batches(spark, monkeypatch):
    """Against NumPy, with rows without entries and rows of more pairs than a task holds at a time."""
    monkeypatch.setattr(features, "PAIRS", 20)
    x = np.random.default_rng(4).integers(0, 3, (60, 9)).astype(float)
    x[7] = 0
    rows = [([int(i) for i in np.flatnonzero(r)], [float(v) for v in r[r > 0]]) for r in x]
    got = {(r["i"], r["j"]): r["dot"] for r in features.moments(spark.createDataFrame(rows, "indices array<int>, values array<double>")).collect()}
    want = x.T @ x
    assert got == {(i, j): want[i, j] for i in range(9) for j in range(i, 9) if want[i, j]}
