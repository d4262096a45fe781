"""Batches of tables in which an id, or none, holds most rows."""

from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from tidemark.llm import exchange, fingerprint, lm, suffix, windows

SCHEMA = "doc_id long, text string"


def table(spark, crowd):
    """A third of all rows with ids of their own, the others with the crowd's; texts of about 1 KB."""
    rows = [(crowd if i % 3 else i * 7, f"{i} " * 200) for i in range(3000)]
    return spark.createDataFrame(rows, SCHEMA).repartition(4)


@pytest.mark.parametrize("crowd", [None, -5, 7000, 10**9])
def test_no_batch_holds_a_crowded_id(spark, crowd):
    batches = exchange.Batches(table(spark, crowd), 0.1)

    def measured(t: pa.Table) -> pa.Table:
        ids = [i for i in t["doc_id"].to_pylist() if i is not None]
        size = sum(len(x) for x in t["text"].to_pylist())
        return pa.table([pa.array([t["_b"][0].as_py()], pa.int32()), pa.array([size], pa.int64()), pa.array([min(ids, default=exchange.NO_ID) if len(ids) == len(t) else exchange.NO_ID], pa.int64()),
                         pa.array([max(ids, default=exchange.NO_ID)], pa.int64()), pa.array([len(t)], pa.int64())], names=["_b", "size", "low", "high", "n"])

    got = sorted(tuple(r) for r in batches.each(measured, "_b int, size long, low long, high long, n long").collect())
    assert [r[0] for r in got] == list(range(batches.n)) and sum(r[4] for r in got) == 3000  # every batch holds rows, and none is lost
    assert max(r[1] for r in got) < 2.5 * 100_000
    assert all(a[3] <= b[2] for a, b in zip(got[:-1], got[1:]))  # ids rise from batch to batch


def test_edges():
    many = exchange.Edges([1, 4, 4, 4, 9], 1)
    assert many.crowded and many.n == 5
    texts = pa.array([f"t{i}" for i in range(400)])
    at = many.batch(np.array([1, 4, 5, 9, 3] * 80, np.int64), texts)
    assert set(at[0::5]) == {0} and set(at[1::5]) == {1, 2, 3} and set(at[2::5]) == {3} and set(at[3::5]) == {4} and set(at[4::5]) == {0}
    first = exchange.Edges([1, 1, 6], 1)
    assert set(first.batch(np.array([1] * 400), texts)) == {0, 1, 2} and first.batch(np.array([6, 5]), texts[:2]).tolist() == [3, 2]
    assert exchange.Edges([], 5).n == 1 and not exchange.Edges([1, 2, 3], 1).crowded


def test_operators_over_a_crowd_without_ids(spark):
    """Half the rows have no id, many of them the same text: the same rows come out as from one batch."""
    rows = [(None if i % 2 else i, " ".join(f"w{(i * k) % 101}" for k in range(1, 60)) + " shared passage " * 15 * (i % 4 == 0)) for i in range(400)] + [(None, "same text " * 40)] * 300
    docs = spark.createDataFrame(rows, SCHEMA).repartition(3)
    plain = lambda df: Counter(str([round(x, 6) if isinstance(x, float) else x for x in r]) for r in df.collect())
    for run in (lambda mb: suffix.dedup_byte_digests(docs, 200, mb), lambda mb: lm.lm_scores(docs, docs["doc_id"] % 4 == 0, mb).drop("score")):  # the filter's layout, and with it its false hits, follow the batches
        few, one = plain(run(0.01)), plain(run(8))
        assert few == one
    for run in (lambda mb: windows.dedup_window_digests(docs, 20, mb), lambda mb: fingerprint.fingerprints(docs, mb)):
        few, one = run(0.01).collect(), run(8).collect()
        assert Counter(r["doc_id"] for r in few) == Counter(r["doc_id"] for r in one)
    removed = lambda mb: sum(r["n_removed"] for r in windows.dedup_window_digests(docs, 20, mb).collect() if r["doc_id"] is None)
    assert removed(0.01) > 0.9 * removed(8)
