"""Substring dedup: Rabin-Karp hashes of every fixed-length token window, compared across the corpus.

Words are the maximal runs of bytes other than space and 0x09-0x0D, unchanged. A window is `width`
consecutive words of one document. A window repeats when the same word sequence starts earlier:
in a smaller doc_id, or earlier in the same document. Repeated windows merge into maximal intervals
of words, which are removed; windows are judged on the input, not on what is left.

Each batch of consecutive doc_ids asks for its distinct window hashes; the bucket that counts a
hash tells every batch but the first that the window has been seen. Words of 64-bit hashes stand
for word sequences: n windows give about n*n/2**65 false matches.

Null and empty texts have no words. Rows of equal doc_id are ordered by text (where they fill several batches
by a hash of it first), and repeated rows are documents of their own, so the later one's windows repeat. A very long
text is in one batch. An empty table gives an empty one. Extra columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import exchange as ex
from .text import utf8, window_hashes, word_hashes, words

WIDTH = 20
RESULT = "doc_id long, n_words long, n_removed long, kept string, spans array<struct<start:long,end:long>>"
RESULT_TYPE = pa.schema([
    ("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept", pa.string()),
    ("spans", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))])
DIGEST = "doc_id long, n_words long, n_removed long, kept_sha256 string"


def _windows(table: pa.Table, width: int):
    data, offsets = utf8(table["text"])
    start, end, doc = words(data, offsets)
    hashes, at = window_hashes(word_hashes(data, start, end), doc, width)
    return data, start, end, doc, hashes, at


def repeated_words(table: pa.Table, replies: pa.Table, width: int, buckets: int):
    """Of a batch in order: its bytes, words, the document of each word, and whether the word is removed."""
    data, start, end, doc, hashes, at = _windows(table, width)
    removed = np.zeros(len(start) + 1, np.int64)
    if len(hashes):
        keys, first, of = np.unique(hashes, return_index=True, return_inverse=True)
        again = ex.heard(replies, keys, buckets, bits=True)[of]
        again |= first[of] != np.arange(len(hashes))
        np.add.at(removed, at[again], 1)
        np.subtract.at(removed, at[again] + width, 1)
    return data, start, end, doc, np.cumsum(removed)[:-1] > 0


def _seen_before(table: pa.Table) -> pa.Table:
    asked = ex.Asked(table)
    order, heads, _ = asked.grouped()
    later = np.ones(len(order), bool)
    later[order[heads]] = False
    return asked.answer(later, bits=True)


def _run(docs: DataFrame, width: int, batch_mb: float, row, schema: str, kind: pa.Schema) -> DataFrame:
    batches = ex.Batches(docs, batch_mb)
    buckets = batches.buckets(0.16)

    def keys(table: pa.Table):
        return np.unique(_windows(table, width)[-2]), None

    def work(table: pa.Table, replies: pa.Table) -> pa.Table:
        table = ex.ordered(table)
        data, start, end, doc, gone = repeated_words(table, replies, width, buckets)
        raw, cuts, rows = data.tobytes(), np.searchsorted(doc, np.arange(len(table) + 1)), []
        for i, doc_id in enumerate(table["doc_id"].to_pylist()):
            a, b = cuts[i], cuts[i + 1]
            kept = b" ".join(raw[s:e] for s, e in zip(start[a:b][~gone[a:b]].tolist(), end[a:b][~gone[a:b]].tolist()))
            rows.append((doc_id, int(b - a), int(gone[a:b].sum()), *row(kept, gone[a:b])))
        return pa.table([pa.array(c, t) for c, t in zip(zip(*rows) if rows else [()] * len(kind), kind.types)], schema=kind)

    replies = ex.answers(ex.ask(batches, keys, buckets), _seen_before)
    return ex.finish(batches, replies, work, schema)


def dedup_windows(docs: DataFrame, width: int = WIDTH, batch_mb: float = 8) -> DataFrame:
    """doc_id, n_words, n_removed, kept (the words left, joined by a space), spans of removed words."""

    def row(kept: bytes, gone: np.ndarray):
        edge = np.flatnonzero(np.diff(np.concatenate([[0], gone.view(np.int8), [0]])))
        return kept.decode(), [{"start": int(s), "end": int(e)} for s, e in zip(edge[::2], edge[1::2])]

    return _run(docs, width, batch_mb, row, RESULT, RESULT_TYPE)


def dedup_window_digests(docs: DataFrame, width: int = WIDTH, batch_mb: float = 8) -> DataFrame:
    """The same as digests: doc_id, n_words, n_removed, kept_sha256."""
    kind = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept_sha256", pa.string())])
    return _run(docs, width, batch_mb, lambda kept, gone: (hashlib.sha256(kept).hexdigest(),), DIGEST, kind)
