"""Best-fit packing: vector best-fit under token, document-count and attention-cost capacities.

A document's ids are those of a vocabulary file with word ends, then END_ID. Documents over the
token capacity are cut into full pieces and a rest. Pieces are dealt by hash into groups of about
`group` documents, so no task gathers them all; in a group, pieces from the largest on go into the
open sequence that fits best, or into a new one if none has room in all three residuals: tokens,
documents, and attention cost (the sum of squared lengths). Best is the smallest weighted residual
norm after placing ("norm") or the largest weighted dot product of demand and residual ("dot").
Ties go to the sequence opened first, equal lengths by doc_id and piece.

Each group may leave one sequence half full, so the number of groups, not the data, bounds the
loss. Null and empty texts are END_ID alone. Repeated rows are documents of their own, a very long text is as many pieces as
it needs, which may fall into several groups. An empty table gives an empty one. Extra columns are ignored.
"""

from __future__ import annotations

import functools
import re
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import SPACE, byte_chars, encoding, vocabulary
from .text import trim

END_ID, CAPACITY = 1, 4096
WORD = re.compile(f"[^{SPACE}]+")
#: The file's split pattern, as it reads among ASCII's characters and among those up to U+017F, and its mark of a word's end.
ASCII_PIECE = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-z]+|[0-9]|[^\sa-z0-9]+")
LATIN_PIECE = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[^\W\d_²³¹¼½¾]+|[\d²³¹¼½¾]|(?:[^\s\w]|_)+")
WORD_END, MARK = "</w>", "\0"
#: The mark, controls that Python takes for white space and Unicode doesn't, and characters whose normal form or case may depend on neighbours.
BEYOND = re.compile("[^\x01-\x1b\x20-\u017f]|<\\|")
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
PACKED = PIECES + ", sequence_id long, offset long"
PACKED_TYPE = pa.schema([
    ("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()),
    ("sequence_id", pa.int64()), ("offset", pa.int64())])


class WordEncoder:
    """Ids as by the tokenizers library: no piece crosses white space, which is dropped.

    The file marks a piece's last byte. Here a byte that plain texts lack stands for the mark, so that
    merging bytes by rank gives the file's ids: the ids of marked bytes come before those of all merges.
    Words with something of BEYOND go to the library itself.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        back = {c: bytes([b]) for b, c in byte_chars().items()}
        ranks = {}
        for token, i in vocabulary(path).items():
            end = token.endswith(WORD_END)
            ranks[b"".join(map(back.__getitem__, token[: -len(WORD_END)] if end else token)) + MARK.encode() * end] = i
        self.base = encoding(f"[^{MARK}]+{MARK}", ranks)

    def plain(self, text: str) -> bytes:
        text = text.lower()
        found = (ASCII_PIECE if text.isascii() else LATIN_PIECE).findall(text)
        return array("I", self.base.encode_ordinary(MARK.join(found) + MARK) if found else []).tobytes()

    def encode(self, text: str) -> bytes:
        """Little-endian 32-bit ids."""
        if not BEYOND.search(text):
            return self.plain(text)
        return b"".join(array("I", self.tokenizer.encode(w, add_special_tokens=False).ids).tobytes() if BEYOND.search(w) else self.plain(w)
                        for w in WORD.findall(text))


@functools.lru_cache(maxsize=1)
def encoder(path: str) -> WordEncoder:
    return WordEncoder(path)


def pieces(docs: DataFrame, path: str, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """doc_id, piece, start, length and ids_crc32 of each piece."""
    end = np.array([end_id], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = encoder(path)
        for batch in batches:
            rows = []
            for doc_id, text in zip(batch["doc_id"].to_pylist(), batch["text"].to_pylist()):
                ids = e.encode(text or "") + end
                for p, at in enumerate(range(0, len(ids), 4 * capacity)):
                    part = ids[at : at + 4 * capacity]
                    rows.append((doc_id, p, at // 4, len(part) // 4, zlib.crc32(part)))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows) if rows else [()] * 5, PACKED_TYPE.types)], PACKED_TYPE.names[:5])
        trim()

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, PIECES)


def best_fit(lengths: np.ndarray, capacity: np.ndarray, weights: np.ndarray, rule: str = "norm") -> tuple[np.ndarray, np.ndarray]:
    """Sequence and offset of each length; lengths fall. capacity and weights: tokens, documents, attention."""
    bins, offsets = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    left = np.empty((1024, 3))
    scale = weights / capacity
    ids, opened, n = np.zeros(1024, np.int64), 0, 0
    least = lengths[-1] if len(lengths) else 0
    for i, t in enumerate(lengths.tolist()):
        need = np.array([t, 1.0, float(t) * t])
        fits = np.flatnonzero((left[:n] >= need).all(1))
        if len(fits):
            room = left[fits]
            value = ((room - need) * scale) ** 2 if rule == "norm" else -(room * need * scale * scale)
            at = fits[np.argmin(value.sum(1))]
        else:
            if n == len(left):
                left, ids = np.concatenate([left, np.empty_like(left)]), np.concatenate([ids, np.zeros_like(ids)])
            at, left[n], ids[n] = n, capacity, opened
            opened, n = opened + 1, n + 1
        bins[i], offsets[i] = ids[at], capacity[0] - left[at, 0]
        left[at] -= need
        if left[at, 0] < least or left[at, 1] < 1:  # nothing that is left fits: closed, order kept
            left[at : n - 1], ids[at : n - 1] = left[at + 1 : n].copy(), ids[at + 1 : n].copy()
            n -= 1
    return bins, offsets


def pack(docs: DataFrame, path: str, capacity: int = CAPACITY, max_docs: int = CAPACITY, max_attention: float | None = None,
         weights: tuple[float, float, float] = (1.0, 0.01, 0.01), rule: str = "norm", group: int = 15_000, end_id: int = END_ID) -> DataFrame:
    """pieces() with sequence_id and offset. By default only tokens bind: max_attention is capacity squared."""
    limits = np.array([capacity, max_docs, max_attention or float(capacity) ** 2], float)
    if limits[2] < float(capacity) ** 2:
        raise ValueError("a full piece must fit into a sequence")
    groups = max(1, docs.count() // group)
    rows = pieces(docs, path, capacity, end_id).withColumn("_g", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(groups)).cast("int"))

    def run(table: pa.Table) -> pa.Table:
        g = table["_g"][0].as_py()
        table = table.take(pa.compute.sort_indices(table, sort_keys=[("length", "descending"), ("doc_id", "ascending"), ("piece", "ascending"), ("ids_crc32", "ascending")]))
        bins, offsets = best_fit(table["length"].to_numpy(), limits, np.array(weights), rule)
        kept = table.select(PACKED_TYPE.names[:5])
        return pa.table([*kept.columns, pa.array(bins + (g << 40)), pa.array(offsets)], schema=PACKED_TYPE)

    return rows.groupBy("_g").applyInArrow(run, PACKED)
