"""Document fingerprints from prefix polynomial hashes.

A text is its code points c. Prefix arrays hold sum(c[j] * B**j) for j < i modulo two primes; two
look-ups and a power of B give the hash of any span, so span equality takes constant time, and the
longest common extension of two places is found by binary search over span equalities.

A fingerprint is the text's length and whole hash, then the KEPT smallest hashes of its spans of
SPAN code points (a shorter text is one span). Likeness is the share of common hashes among the
smallest ones of both together, which estimates the Jaccard index of the span sets; 1 for equal
whole hashes. Two empty texts have likeness 1, an empty and a full one 0.

Null text is empty. The next document is that of the next doc_id (null first, ties by text, or by a hash of it first where
they fill several batches); after the last comes the first, which for one document is itself. Repeated rows follow each
other. A very long text is taken whole in one task. An empty table gives an empty one. Extra columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import exchange as ex
from .text import mix

PRIMES = (2147483647, 2147483629)
BASE = 1000003
SPAN, KEPT = 24, 64
RESULT = ("doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, "
          "near_edited double, near_next double, common_prefix long")
RESULT_TYPE = pa.schema([
    ("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.string()),
    ("edited_fingerprint", pa.string()), ("near_edited", pa.float64()), ("near_next", pa.float64()), ("common_prefix", pa.int64())])
_tables: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _powers(prime: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of BASE and of its inverse, n of them at least, kept for the next text."""
    have = _tables.get(prime)
    if have is None or len(have[0]) < n:
        size = 1 << max(12, (n - 1).bit_length())
        made = []
        for base in (BASE, pow(BASE, -1, prime)):
            out, filled = np.ones(size, np.uint64), 1
            while filled < size:
                out[filled : 2 * filled] = out[:filled] * np.uint64(pow(base, filled, prime)) % np.uint64(prime)
                filled *= 2
            made.append(out)
        _tables[prime] = have = (made[0], made[1])
    return have


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)


class Prefixes:
    """Prefix arrays of one text."""

    def __init__(self, chars: np.ndarray):
        self.n = len(chars)
        self.arrays = []
        for prime in PRIMES:
            power, _ = _powers(prime, self.n + 1)
            out = np.zeros(self.n + 1, np.uint64)
            np.cumsum((chars + np.uint64(1)) * power[: self.n] % np.uint64(prime), out=out[1:])
            self.arrays.append(out % np.uint64(prime))

    def spans(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Hashes of the spans [start, end): equal for equal spans, wherever they stand."""
        out = np.zeros(len(start), np.uint64)
        for prime, array in zip(PRIMES, self.arrays):
            p = np.uint64(prime)
            _, back = _powers(prime, self.n + 1)
            out = (out << np.uint64(31)) ^ ((array[end] + p - array[start]) % p * back[start] % p)
        return out ^ ((end - start).astype(np.uint64) << np.uint64(40))

    def span(self, start: int, end: int) -> int:
        return int(self.spans(np.array([start]), np.array([end]))[0])


def common_extension(a: Prefixes, i: int, b: Prefixes, j: int) -> int:
    """How far a from i and b from j agree."""
    low, high = 0, min(a.n - i, b.n - j)
    while low < high:
        mid = (low + high + 1) // 2
        if a.span(i, i + mid) == b.span(j, j + mid):
            low = mid
        else:
            high = mid - 1
    return low


def sketch(prefixes: Prefixes) -> np.ndarray:
    n = prefixes.n
    if not n:
        return np.zeros(0, np.uint32)
    start = np.arange(max(1, n - SPAN + 1))
    hashes = (mix(prefixes.spans(start, np.minimum(start + SPAN, n))) >> np.uint64(32)).astype(np.uint32)
    few = np.unique(np.partition(hashes, 4 * KEPT)[: 4 * KEPT]) if len(hashes) > 4 * KEPT else np.unique(hashes)
    if len(few) < KEPT < len(hashes):
        few = np.unique(hashes)
    return few[:KEPT]


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Of two sketches."""
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    both = np.union1d(a, b)[:KEPT]
    return float(np.isin(both, a).astype(int) @ np.isin(both, b).astype(int) / len(both))


def fingerprint(prefixes: Prefixes) -> tuple[str, np.ndarray]:
    kept = sketch(prefixes)
    return f"{prefixes.n:x}-{prefixes.span(0, prefixes.n):016x}-{kept.astype('>u4').tobytes().hex()}", kept


def fingerprints(docs: DataFrame, batch_mb: float = 8) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next, common_prefix.

    The edited text has its last floor(n_chars / 4) code points replaced by as many of the next
    document's first. common_prefix is how far it agrees with the text from the start.
    """
    batches = ex.Batches(docs, batch_mb)
    n = batches.n

    def head(table: pa.Table) -> pa.Table:
        """A batch's first text, for the batch before it."""
        text = ex.ordered(table)["text"][0].as_py() or ""
        return pa.table([pa.array([(table["_b"][0].as_py() + n - 1) % n], pa.int32()), pa.array([text], pa.string())], names=["_b", "text"])

    after = batches.each(head, "_b int, text string")

    def work(table: pa.Table, after: pa.Table) -> pa.Table:
        table = ex.ordered(table)
        texts = [t or "" for t in table["text"].to_pylist()] + [after["text"][0].as_py()]
        rows, known = [], None
        for i, doc_id in enumerate(table["doc_id"].to_pylist()):
            text, following = texts[i], texts[i + 1]
            chars = code_points(text) if known is None else known[0]
            prefixes, (mark, kept) = (Prefixes(chars), (None, None)) if known is None else known[1:]
            if mark is None:
                mark, kept = fingerprint(prefixes)
            next_chars = code_points(following)
            next_prefixes = Prefixes(next_chars)
            next_mark, next_kept = fingerprint(next_prefixes)
            cut = len(text) - len(text) // 4
            edited = text[:cut] + following[: len(text) - cut]
            edited_prefixes = Prefixes(np.concatenate([chars[:cut], next_chars[: len(text) - cut]]))
            edited_mark, edited_kept = fingerprint(edited_prefixes)
            rows.append((
                doc_id, len(text), hashlib.sha256(edited.encode("utf-8", "surrogatepass")).hexdigest(), mark, edited_mark,
                1.0 if mark == edited_mark else likeness(kept, edited_kept), 1.0 if mark == next_mark else likeness(kept, next_kept),
                common_extension(prefixes, 0, edited_prefixes, 0)))
            known = (next_chars, next_prefixes, (next_mark, next_kept))
        return pa.table([pa.array(c, t) for c, t in zip(zip(*rows) if rows else [()] * len(RESULT_TYPE), RESULT_TYPE.types)], schema=RESULT_TYPE)

    return ex.finish(batches, after, work, RESULT)
