"""Questions and answers between batches of documents and buckets of hashes.

Exact counting of every window of a large corpus would shuffle a row for each. Instead the
documents are dealt into batches of consecutive ids; each batch sends every bucket one sorted,
delta-coded array of its distinct hashes, the bucket's task compares what all batches sent, and
answers each batch in the order of its question. A hash comes once from each batch however often
it occurs there, so a hot one costs no more than another. Both halves are grouped Arrow functions:
Spark partitions, shuffles and retries them.
"""

from __future__ import annotations

import bisect
import copy
import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .text import trim

ASK = "_b int, _k int, n int, keys binary, vals binary"
ASK_TYPE = pa.schema([("_b", pa.int32()), ("_k", pa.int32()), ("n", pa.int32()), ("keys", pa.binary()), ("vals", pa.binary())])
#: What a null doc_id counts as.
NO_ID = -(2**63)
ANSWER = "_b int, _k int, reply binary"
ANSWER_TYPE = pa.schema([("_b", pa.int32()), ("_k", pa.int32()), ("reply", pa.binary())])


def pack(keys: np.ndarray) -> bytes:
    """Sorted 64-bit keys as the first one and differences of as few bytes as the largest needs."""
    if not len(keys):
        return b""
    gaps = np.diff(keys)
    width = (int(gaps.max()).bit_length() + 7) // 8 if len(gaps) else 0
    return bytes([width]) + keys[:1].tobytes() + gaps.view(np.uint8).reshape(-1, 8)[:, :width].tobytes()


def unpack(packed: bytes, n: int) -> np.ndarray:
    if not n:
        return np.zeros(0, np.uint64)
    width, out = packed[0], np.zeros((n, 8), np.uint8)
    out[0] = np.frombuffer(packed, np.uint8, 8, 1)
    if n > 1:
        out[1:, :width] = np.frombuffer(packed, np.uint8, offset=9).reshape(n - 1, width)
    return np.cumsum(out.view(np.uint64).ravel(), dtype=np.uint64)


class Edges:
    """Where batches begin: at a doc_id, or inside one at a hash of its texts. Batches count from 0 in the order of ids, a crowded id's in that of hashes."""

    def __init__(self, cuts: list[int], least: int):
        """cuts: quantiles of doc_ids, one again for each share of the rows that it holds; least: the smallest doc_id, at which the first batch begins."""
        ids, times = np.unique(np.array(cuts, np.int64), return_counts=True)
        self.ids: list[int] = []
        self.hashes: list[int] = []
        for i, n in zip(ids.tolist(), times.tolist()):
            for k in range(n + (i == least) if n > 1 or i != least else 0):
                if (i, k) != (least, 0):  # so the first batch isn't empty
                    self.ids.append(i)
                    self.hashes.append((k << 64) // (n + (i == least)))
        self.n, self.number = len(self.ids) + 1, None
        self.crowded = len(set(self.ids)) < len(self.ids)

    def batch(self, ids: np.ndarray, texts: pa.Array) -> np.ndarray:
        own = np.array(self.ids, np.int64)
        low, high = np.searchsorted(own, ids, "left"), np.searchsorted(own, ids, "right")
        out = high.copy()
        for at in np.flatnonzero(high - low > 1).tolist():
            mark = int.from_bytes(hashlib.blake2b((texts[at].as_py() or "").encode(), digest_size=8).digest(), "big")
            out[at] = bisect.bisect_right(self.hashes, mark, int(low[at]), int(high[at]))
        return out if self.number is None else self.number[out]

    def without_empty(self, held: list[int]) -> Edges:
        """The same edges with the batches that hold rows counted anew."""
        out = copy.copy(self)
        out.n, out.number = len(held), np.full(self.n, -1)
        out.number[np.sort(held)] = np.arange(len(held))
        return out


class Batches:
    """Documents as (doc_id, text, _b): batches of about batch_mb MB with consecutive doc_ids.

    A null doc_id counts as the smallest. Rows of one doc_id are in one batch, but where they would fill several, which shows by the
    id being several of the quantiles that batches begin at: these share out its rows by ranges of a hash of the text. The rows are shuffled
    once, as compressed runs of one batch each, and every grouping by _b reuses that shuffle.
    """

    def __init__(self, docs: DataFrame, batch_mb: float = 8, **more: Column):
        """more: further columns of the rows."""
        self.rows = rows = docs.select(
            F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"),
            *[c.alias(name) for name, c in more.items()])
        size = rows.agg(F.sum(F.octet_length("text")).alias("bytes"), F.count(F.lit(1)).alias("docs"), F.count("doc_id").alias("ids"), F.min("doc_id").alias("least")).first()
        self.docs, self.bytes = size["docs"], size["bytes"] or 0
        self.n = int(min(max(1, self.docs), max(1, -(-self.bytes // int(batch_mb * 1e6)))))
        cuts: list[int] = []
        if self.n > 1:
            at = [i / self.n for i in range(1, self.n)]
            cuts = rows.agg(F.percentile_approx(F.coalesce("doc_id", F.lit(NO_ID)), at, max(10_000, 20 * self.n)).alias("c")).first()["c"] or []
        edges = Edges(cuts, NO_ID if size["least"] is None or size["ids"] < self.docs else size["least"])

        def dealt(edges: Edges) -> DataFrame:
            return rows.mapInArrow(lambda batches: deal(batches, edges), "_b int, rows binary")

        def deal(batches: Iterator[pa.RecordBatch], edges: Edges) -> Iterator[pa.RecordBatch]:
            for rows in batches:
                b = edges.batch(rows["doc_id"].fill_null(NO_ID).to_numpy(zero_copy_only=False), rows["text"])
                order = np.argsort(b, kind="stable")
                heads = np.append(np.flatnonzero(np.diff(b[order], prepend=-1)), len(b))
                runs = [(int(b[order[i]]), zipped(rows.take(pa.array(order[i:j])))) for i, j in zip(heads[:-1], heads[1:])]
                yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in runs], pa.int32()), pa.array([z for _, z in runs], pa.binary())], ["_b", "rows"])
            trim()

        if edges.crowded:  # few texts may leave a range of hashes empty
            edges = edges.without_empty([r["_b"] for r in dealt(edges).select("_b").distinct().collect()])
        self.n = edges.n
        self._dealt = dealt(edges).repartition(self.n, "_b")

    def each(self, work: Callable[[pa.Table], pa.Table], schema: str) -> DataFrame:
        """What `work` makes of each batch's rows."""
        def run(table: pa.Table) -> pa.Table:
            out = work(unzipped(table))
            trim()
            return out

        return self._dealt.groupBy("_b").applyInArrow(run, schema)

    def each_with(self, other: DataFrame, work: Callable[[pa.Table, pa.Table], pa.Table], schema: str) -> DataFrame:
        """What `work` makes of each batch's rows and the other rows of its _b."""
        def run(table: pa.Table, right: pa.Table) -> pa.Table:
            out = work(unzipped(table), right)
            trim()
            return out

        return self._dealt.groupBy("_b").cogroup(other.groupBy("_b")).applyInArrow(run, schema)

    def buckets(self, keys_per_byte: float, most: int = 1_500_000) -> int:
        """A power of two of buckets so that each gets about `most` keys."""
        need = max(1.0, self.bytes * keys_per_byte / most)
        return 1 << max(0, int(np.ceil(np.log2(max(need, min(self.n, 16))))))


def zipped(rows: pa.RecordBatch) -> bytes:
    out = pa.BufferOutputStream()
    with pa.ipc.new_stream(out, rows.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as stream:
        stream.write_batch(rows)
    return out.getvalue().to_pybytes()


def unzipped(table: pa.Table) -> pa.Table:
    """The rows of a batch with its number _b; the order of its runs is any."""
    rows = pa.concat_tables([pa.ipc.open_stream(z.as_buffer()).read_all() for z in table["rows"]])
    return rows.append_column("_b", pa.array(np.full(len(rows), table["_b"][0].as_py(), np.int32)))


def bucket_bounds(keys: np.ndarray, buckets: int) -> np.ndarray:
    """Where each bucket begins in sorted keys; a bucket holds the keys that agree in their high bits."""
    if buckets == 1:
        return np.array([0, len(keys)])
    edges = np.arange(buckets, dtype=np.uint64) << np.uint64(65 - buckets.bit_length())
    return np.append(np.searchsorted(keys, edges), len(keys))


def questions(batch: int, keys: np.ndarray, buckets: int, values: np.ndarray | None = None, every: bool = False) -> pa.Table:
    """One row for each bucket that gets some of the batch's sorted distinct keys (or for every one), with a value of each."""
    bounds, rows = bucket_bounds(keys, buckets), []
    for k in range(buckets) if every else np.flatnonzero(np.diff(bounds)):
        a, b = bounds[k], bounds[k + 1]
        rows.append((batch, int(k), int(b - a), pack(keys[a:b]), values[a:b].tobytes() if values is not None else None))
    return pa.table([pa.array(c, t) for c, t in zip(zip(*rows) if rows else [()] * 5, ASK_TYPE.types)], schema=ASK_TYPE)


def ask(batches: Batches, make: Callable[[pa.Table], tuple[np.ndarray, np.ndarray | None]], buckets: int) -> DataFrame:
    """make: the sorted distinct keys of a batch's (doc_id, text, _b) rows, and their values or None."""

    def send(table: pa.Table) -> pa.Table:
        keys, values = make(table)
        return questions(table["_b"][0].as_py(), keys, buckets, values)

    return batches.each(send, ASK)


class Asked:
    """What one bucket was asked: batch numbers in rising order, their keys, and all keys together."""

    def __init__(self, table: pa.Table, dtype: np.dtype | str | None = None):
        order = np.argsort(table["_b"].to_numpy(), kind="stable")
        table = table.take(pa.array(order)) if len(order) > 1 else table
        self.bucket = table["_k"][0].as_py()
        self.batch = table["_b"].to_numpy().astype(np.int32)
        self.size = table["n"].to_numpy()
        self.keys = np.concatenate([unpack(k.as_py(), n) for k, n in zip(table["keys"], self.size)])
        self.values = np.concatenate([np.frombuffer(v.as_py(), dtype) for v in table["vals"]]) if dtype else None

    def grouped(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """An order that brings equal keys together by rising batch; starts of the groups in it; each asked key's group."""
        order = np.argsort(self.keys, kind="stable")
        ranked = self.keys[order]
        new = np.ones(len(ranked), bool)
        new[1:] = ranked[1:] != ranked[:-1]
        group = np.empty(len(ranked), np.int64)
        group[order] = np.cumsum(new) - 1
        return order, np.flatnonzero(new), group

    def answer(self, replies: np.ndarray, bits: bool = False, head: bytes = b"") -> pa.Table:
        """A reply for each asked key, cut by batch; head: what every batch hears first."""
        ends = np.cumsum(self.size)
        parts = [head + (np.packbits(p) if bits else p).tobytes() for p in np.split(replies, ends[:-1])]
        return pa.table([pa.array(self.batch), pa.array(np.full(len(parts), self.bucket, np.int32)), pa.array(parts, pa.binary())], schema=ANSWER_TYPE)


def answers(asked: DataFrame, reply: Callable[[pa.Table], pa.Table]) -> DataFrame:
    return asked.groupBy("_k").applyInArrow(reply, ANSWER)


def heard(table: pa.Table, keys: np.ndarray, buckets: int, dtype: np.dtype | str = np.uint8, bits: bool = False, skip: int = 0) -> np.ndarray:
    """The replies to a batch's sorted distinct keys, put together again, without `skip` bytes at the head of each."""
    bounds = bucket_bounds(keys, buckets)
    got = dict(zip(table["_k"].to_pylist(), table["reply"].to_pylist()))
    parts: list[np.ndarray] = []
    for k in np.flatnonzero(np.diff(bounds)):
        x = np.frombuffer(got[int(k)], np.uint8 if bits else dtype, offset=skip)
        parts.append(np.unpackbits(x, count=bounds[k + 1] - bounds[k]).astype(bool) if bits else x)
    return np.concatenate(parts) if parts else np.zeros(0, bool if bits else dtype)


def ordered(table: pa.Table) -> pa.Table:
    """A batch's rows by doc_id (null first), equal ones by text (null first); those of a crowded id are in the order of hashes across batches."""
    return table.sort_by([("doc_id", "ascending"), ("text", "ascending")]) if len(table) < 2 else table.take(
        pa.compute.sort_indices(table, sort_keys=[("doc_id", "ascending"), ("text", "ascending")], null_placement="at_start"))


def finish(batches: Batches, replies: DataFrame, work: Callable[[pa.Table, pa.Table], pa.Table], schema: str) -> DataFrame:
    """work: a batch's rows and the replies to it -> result rows."""
    return batches.each_with(replies, work, schema)


def slices(offsets: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Runs of documents of about `most` bytes together, at least one document each."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + most, "right")) - 1)
        yield i, j
        i = j
