"""Where two tokenizers agree: links between their tokens, and how often each pair of ids is linked in the whole corpus.

A and B are a byte-level BPE file and a SentencePiece model, which both encode a space and the text. Where tokens of
both end at one byte, a group ends and those two tokens are linked. A task cuts its documents into batches of
about SLICE bytes; each link is a record (B id, A id, document), and a batch deals its records by the low bits of the B
id (a radix) into buckets, as runs in order of B id, A id and document: zstd frames of FRAME records. The runs
are written once into the shared folder.

Tasks of one bucket and about FAN batches each merge their runs through a heap, a frame of each run at a time,
into counts of each pair; tasks of a bucket merge FAN such lists of counts at a time until one is left. Its order is
side-major, all pairs of a B id stand together, so the pass that ends the merge also tells each B id's highest
count. The counts go back to every part of their bucket, whose runs stream by them once more, and what they add to each
document is summed by batch. However hot a pair is, a merge holds FAN frames, and a list of counts at most
the pairs of a bucket, which the vocabularies bound; nothing is collected.

Texts that are null or empty, and those whose joined tokens differ from the space and the text (U+2581 in a text
does that), have no tokens: zeros and an empty digest. Repeated rows and rows of one or no doc_id are documents of
their own, ties for the highest count all count, extra columns are ignored, an empty table gives an empty
one. A text is encoded in one task, a long one by halves as in bpe.
"""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.files import scratch
from .bpe import SPREAD_LEAF, Codec, codec
from .pieces import PieceCodec, piece_codec, text_slices, texts
from .text import trim

SLICE, FRAME, FAN, BUCKETS = 4_000_000, 16_384, 64, 16
#: A kind of rows of the written table: a batch's documents, or its run in one bucket.
DOCUMENTS, RUN = "documents", "run"
WRITTEN = "batch long, bucket int, frames array<binary>"
DOCUMENT = pa.schema([("doc_id", pa.int64()), ("n_a", pa.int64()), ("n_b", pa.int64()), ("n_groups", pa.int64()), ("n_links", pa.int64()), ("groups_sha256", pa.string())])
LINKED = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"
LINKED_TYPE = pa.schema([*list(DOCUMENT)[:5], ("n_best", pa.int64()), ("count_sum", pa.int64()), DOCUMENT.field(5)])


def frame(**columns: np.ndarray) -> bytes:
    batch = pa.RecordBatch.from_arrays([pa.array(c) for c in columns.values()], [*columns])
    out = pa.BufferOutputStream()
    with pa.ipc.new_stream(out, batch.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as stream:
        stream.write_batch(batch)
    return out.getvalue().to_pybytes()


def opened(packed: pa.Scalar) -> pa.Table:
    return pa.ipc.open_stream(packed.as_buffer()).read_all()


def frames(keys: np.ndarray, most: int = FRAME, **columns: np.ndarray) -> list[bytes]:
    """Sorted keys, as differences, and more columns, cut into frames."""
    return [frame(key=np.diff(keys[i : i + most], prepend=np.uint64(0)), **{n: c[i : i + most] for n, c in columns.items()}) for i in range(0, len(keys), most)]


def keys_of(table: pa.Table) -> np.ndarray:
    return np.cumsum(table["key"].to_numpy(), dtype=np.uint64)


class Strings:
    """Digits of ids behind a mark, as bytes of one width, so that lists of tokens become text without a loop."""

    MARKS = "", ",", "|", ";"

    def __init__(self, n: int):
        self.n = n
        self.table = np.array([f"{m}{i}" for m in self.MARKS for i in range(n)], "S")
        self.table = self.table.view(np.uint8).reshape(len(self.MARKS) * n, -1)

    def join(self, marks: np.ndarray, ids: np.ndarray) -> bytes:
        flat = self.table[marks * self.n + ids].ravel()
        return flat[flat != 0].tobytes()


class Aligner:
    """Tokens, groups and links of one text after another."""

    def __init__(self, a: Codec, b: PieceCodec):
        self.a, self.b = a, b
        self.strings = Strings(max(len(a.length), len(b.length)))

    def encoded(self, text: str) -> np.ndarray:
        """A's ids; a long text's leaves are joined in a tree."""
        return self.a.joined(text, SPREAD_LEAF).astype(np.int64)

    def groups(self, ids_a: np.ndarray, ids_b: np.ndarray, i: np.ndarray, j: np.ndarray) -> bytes:
        """`a1,a2|b1;a3|b2,b3` from the places of the last tokens of the groups on both sides."""
        marks, order = [], []
        for ids, last, mark, side in ((ids_a, i, 3, 0), (ids_b, j, 2, 1)):
            size = np.diff(last, prepend=-1)
            m = np.ones(len(ids), np.int64)
            m[last - size + 1] = mark
            marks.append(m)
            order.append(np.repeat(np.arange(len(last)) * 2 + side, size))
        marks[0][0] = 0
        by = np.argsort(np.concatenate(order), kind="stable")
        return self.strings.join(np.concatenate(marks)[by], np.concatenate([ids_a, ids_b])[by])

    def __call__(self, text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """ids of both sides, and the places of the tokens that end together; nothing if a side isn't the space and the text."""
        none = (np.zeros(0, np.int64),) * 4
        if not text:
            return none
        data = (" " + text).encode()
        ids_b = self.b.encode(text)[0].astype(np.int64)
        if self.b.raw(ids_b) != data:
            return none
        ids_a = self.encoded(" " + text)
        if self.a.raw(ids_a) != data:
            return none
        ends_a, ends_b = np.cumsum(self.a.length[ids_a]), np.cumsum(self.b.text_length[ids_b])
        j = np.searchsorted(ends_b, ends_a)
        i = np.flatnonzero(ends_b[j] == ends_a)
        return ids_a, ids_b, i, j[i]


def merged(runs: Iterable[Iterator[tuple[np.ndarray, np.ndarray]]]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Keys in rising order and the sums of their numbers, from sorted runs that come block by block.

    The heap holds each run's next key. What lies up to the smallest last key of all open blocks is taken at
    once; a run whose block is used up opens its next one, which may begin with the same key.
    """
    heap: list[tuple[int, int]] = []
    blocks: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    sources = [iter(r) for r in runs]

    def refill(r: int) -> None:
        for keys, n in sources[r]:
            if len(keys):
                blocks[r] = keys, n
                heapq.heappush(heap, (int(keys[0]), r))
                return
        blocks.pop(r, None)

    for r in range(len(sources)):
        refill(r)
    while heap:
        bound = min(int(keys[-1]) for keys, _ in blocks.values())
        parts = []
        while heap and heap[0][0] <= bound:
            _, r = heapq.heappop(heap)
            keys, n = blocks[r]
            cut = int(np.searchsorted(keys, np.uint64(bound), "right"))
            parts.append((keys[:cut], n[:cut]))
            if cut < len(keys):
                blocks[r] = keys[cut:], n[cut:]
                heapq.heappush(heap, (int(keys[cut]), r))
            else:
                refill(r)
        keys, at = np.unique(np.concatenate([k for k, _ in parts]), return_inverse=True)
        sums = np.zeros(len(keys), np.int64)
        np.add.at(sums, at, np.concatenate([n for _, n in parts]))
        yield keys, sums


def joined(parts: Iterator[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """What merged() gives, as whole arrays."""
    found = list(parts)
    if not found:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    return np.concatenate([k for k, _ in found]), np.concatenate([n for _, n in found])


def blocks_of(packed: Iterable[pa.Scalar], number: str) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    for p in packed:
        table = opened(p)
        yield keys_of(table), table[number].to_numpy()


def written(docs: DataFrame, a_path: str, b_path: str, slice_bytes: int = SLICE, buckets: int = BUCKETS) -> DataFrame:
    """Batches of documents and their runs, from a table in the shared folder: WRITTEN and kind."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        align, task, n = Aligner(codec(a_path), piece_codec(b_path)), TaskContext.get().partitionId(), 0
        for batch in batches:
            for part in text_slices(batch, slice_bytes):
                docs_rows, keys, docs = [], [], []
                for d, (doc_id, text) in enumerate(zip(part["doc_id"].to_pylist(), part["text"])):
                    a, b, i, j = align(text.as_py())
                    digest = hashlib.sha256(align.groups(a, b, i, j)).hexdigest() if len(a) else ""
                    docs_rows.append((doc_id, len(a), len(b), len(i), len(i), digest))
                    keys.append(b[j].astype(np.uint64) << np.uint64(32) | a[i].astype(np.uint64))
                    docs.append(np.full(len(i), d, np.int32))
                rows = [(DOCUMENTS, -1, [frame(**{f.name: pa.array(c, f.type) for f, c in zip(DOCUMENT, zip(*docs_rows))})])]
                key, doc = np.concatenate(keys), np.concatenate(docs)
                side = (key >> np.uint64(32)).astype(np.int64) & (buckets - 1)
                order = np.lexsort((doc, key, side))
                key, doc, side = key[order], doc[order], side[order]
                new = np.ones(len(key), bool)
                new[1:] = (key[1:] != key[:-1]) | (doc[1:] != doc[:-1])
                at = np.flatnonzero(new)
                key, doc, side, times = key[at], doc[at], side[at], np.diff(np.append(at, len(new))).astype(np.int32)
                edges = np.searchsorted(side, np.arange(buckets + 1))
                for k in np.flatnonzero(np.diff(edges)).tolist():
                    s = slice(edges[k], edges[k + 1])
                    rows.append((RUN, k, frames(key[s], doc=doc[s], times=times[s])))
                kinds, bucket, packed = zip(*rows)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(kinds), pa.array([task << 32 | n] * len(rows), pa.int64()), pa.array(bucket, pa.int32()), pa.array(packed, pa.list_(pa.binary()))],
                    ["kind", "batch", "bucket", "frames"])
                n += 1
        trim()

    spark, path = docs.sparkSession, scratch(docs.sparkSession, "alignment")
    texts(docs).mapInArrow(run, f"kind string, {WRITTEN}").write.partitionBy("kind").parquet(path)
    return spark.read.schema(f"{WRITTEN}, kind string").parquet(path)


def pair_counts(runs: DataFrame, parts: int, fan: int = FAN) -> DataFrame:
    """bucket and frames of every pair's key, count and whether its B id has no higher one, from runs with bucket, part and frames."""
    schema = "bucket int, part int, frames array<binary>"

    def answer(table: pa.Table, keys: np.ndarray, **columns: np.ndarray) -> pa.Table:
        packed = [frames(keys, **columns)]
        return pa.table([table["bucket"].slice(0, 1), pa.array([0], pa.int32()), pa.array(packed, pa.list_(pa.binary()))], names=["bucket", "part", "frames"])

    def add(number: str):
        def run(table: pa.Table) -> pa.Table:
            keys, n = joined(merged([blocks_of(f, number) for f in table["frames"]]))
            trim()
            return answer(table, keys, n=n).set_column(1, "part", table["part"].slice(0, 1))

        return run

    counts = runs.select("bucket", "part", "frames").groupBy("bucket", "part").applyInArrow(add("times"), schema)
    while parts > fan:
        parts = -(-parts // fan)
        counts = counts.withColumn("part", F.pmod("part", F.lit(parts)).cast("int")).groupBy("bucket", "part").applyInArrow(add("n"), schema)

    def last(table: pa.Table) -> pa.Table:
        keys, n = joined(merged([blocks_of(f, "n") for f in table["frames"]]))
        side = keys >> np.uint64(32)
        heads = np.flatnonzero(np.diff(side, prepend=np.uint64(2**63)))
        most = np.maximum.reduceat(n, heads) if len(heads) else n
        best = n == np.repeat(most, np.diff(np.append(heads, len(n))))
        trim()
        return answer(table, keys, n=n, best=best.astype(np.int8))

    return counts.groupBy("bucket").applyInArrow(last, schema).drop("part")


def align(docs: DataFrame, a_path: str, b_path: str, slice_bytes: int = SLICE, buckets: int = BUCKETS, fan: int = FAN) -> DataFrame:
    """One row a document (LINKED): tokens, groups and links, how many of its links have their B id's highest count, and the sum of their counts."""
    if buckets & (buckets - 1):
        raise ValueError("buckets must be a power of two")
    table = written(docs, a_path, b_path, slice_bytes, buckets)
    documents = table.where(F.col("kind") == DOCUMENTS).select("batch", "frames")
    parts = max(1, -(-documents.count() // fan))
    runs = table.where(F.col("kind") == RUN).select("batch", "bucket", F.pmod(F.xxhash64("batch"), F.lit(parts)).cast("int").alias("part"), "frames")
    counts = pair_counts(runs, parts, fan).withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))

    def back(table: pa.Table, counted: pa.Table) -> pa.Table:
        known = [opened(p) for p in counted["frames"][0]]
        keys = np.concatenate([keys_of(t) for t in known])
        n, best = (np.concatenate([t[c].to_numpy() for t in known]) for c in ("n", "best"))
        out = []
        for packed in table["frames"]:
            doc, add_best, add_sum = [], [], []
            for p in packed:
                t = opened(p)
                at, times = np.searchsorted(keys, keys_of(t)), t["times"].to_numpy().astype(np.int64)
                doc.append(t["doc"].to_numpy())
                add_best.append(times * best[at])
                add_sum.append(times * n[at])
            d, at = np.unique(np.concatenate(doc), return_inverse=True)
            sums = np.zeros((2, len(d)), np.int64)
            np.add.at(sums[0], at, np.concatenate(add_best))
            np.add.at(sums[1], at, np.concatenate(add_sum))
            out.append([frame(doc=d, best=sums[0], sum=sums[1])])
        trim()
        return pa.table([table["batch"], pa.array(out, pa.list_(pa.binary()))], names=["batch", "frames"])

    added = runs.groupBy("bucket", "part").cogroup(counts.groupBy("bucket", "part")).applyInArrow(back, "batch long, frames array<binary>")

    def finish(table: pa.Table, added: pa.Table) -> pa.Table:
        rows = opened(table["frames"][0][0])
        sums = np.zeros((2, len(rows)), np.int64)
        for packed in added["frames"]:
            t = opened(packed[0])
            d = t["doc"].to_numpy()  # each once in a run
            sums[0, d] += t["best"].to_numpy()
            sums[1, d] += t["sum"].to_numpy()
        return pa.table([*(rows[c] for c in DOCUMENT.names[:5]), pa.array(sums[0]), pa.array(sums[1]), rows["groups_sha256"]], schema=LINKED_TYPE)

    return documents.groupBy("batch").cogroup(added.groupBy("batch")).applyInArrow(finish, LINKED)
