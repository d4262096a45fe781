"""BPE encoding and decoding with a byte-level vocabulary file, by tree concatenation.

A text is cut into leaves at fixed places, wherever words or white space stand: every LEAF characters inside the
task that has the text; texts over two leaves of SPREAD_LEAF characters are first cut into these, which Spark deals
over its tasks. Each leaf is encoded on its own, and neighbouring runs are joined in a tree:
a window of tokens around the join is encoded anew and grows until both sides agree with it. The
window may end where white space follows a character (no piece of the split pattern crosses such a
place), at the ends of the runs, or between letters inside a word, where its outermost token must
equal the run's own token there. Two neighbouring tokens that stand together in a right encoding do
so in every right encoding, so such an agreement makes the joined run exact.

Texts up to two leaves are encoded whole. Strings of special tokens are cut out first, as
the tokenizers library does. The leaves of a text are gathered by its doc_id and a hash of it, never
by a place in a partition, so a task that is run again gives the same ones. Null text is empty and
has no ids. Repeated rows give repeated results, an empty table gives an empty one. Extra columns are ignored.
"""

from __future__ import annotations

import functools
import json
import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .exchange import slices

LEAF, SPREAD_LEAF = 1000, 16_384
SLICE = 2_000_000  # bytes of text that a task works on at a time
#: The split pattern of byte-level BPE, and White_Space of Unicode.
SPLIT = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
SPACE = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
#: Pieces never cross from a character to white space after it, so these can be encoded alone.
UNIT = re.compile(f"[{SPACE}]*[^{SPACE}]+|[{SPACE}]+")


def byte_chars() -> dict[int, str]:
    """The printable character that stands for each byte in vocabulary files."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out = {b: chr(b) for b in plain}
    for i, b in enumerate(b for b in range(256) if b not in out):
        out[b] = chr(256 + i)
    return out


def special_tokens(path: str) -> tuple[dict[str, int], re.Pattern | None]:
    """The file's special tokens and a pattern that finds them, the longest first."""
    with open(path, encoding="utf-8") as f:
        special = {t["content"]: t["id"] for t in json.load(f)["added_tokens"]}
    names = sorted(special, key=len, reverse=True)
    return special, re.compile(f"({'|'.join(map(re.escape, names))})") if names else None


def parts(text: str, cut: re.Pattern | None) -> list[str]:
    """Ordinary texts at even places, special tokens between them."""
    return cut.split(text) if cut and cut.search(text) else [text]


def vocabulary(path: str) -> dict[str, int]:
    """The file's tokens but special ones; their ids must follow the order of the merges, so that ids can serve as ranks."""
    with open(path, encoding="utf-8") as f:
        told = json.load(f)
    special = {t["content"] for t in told["added_tokens"]}
    vocab = {k: v for k, v in told["model"]["vocab"].items() if k not in special}
    merged = [vocab["".join(m if isinstance(m, list) else m.split(" "))] for m in told["model"]["merges"]]
    if merged != sorted(merged):
        raise ValueError("ids must follow the order of the merges")
    return vocab


def encoding(pattern: str, ranks: dict[bytes, int]):
    """Splits by a pattern, then merges bytes by rank."""
    import tiktoken

    return tiktoken.Encoding("file", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


class Codec:
    """Encodes and decodes with one byte-level vocabulary file."""

    def __init__(self, path: str):
        back = {c: b for b, c in byte_chars().items()}
        self.special, self.cut = special_tokens(path)
        ranks = {bytes(back[c] for c in token): i for token, i in vocabulary(path).items()}
        self.base = encoding(SPLIT, ranks)
        self.bytes = {i: b for b, i in ranks.items()} | {i: s.encode() for s, i in self.special.items()}
        self.length = np.zeros(max(self.bytes) + 1, np.int64)
        for i, b in self.bytes.items():
            self.length[i] = len(b)

    def ordinary(self, text: str) -> np.ndarray:
        return np.array(self.base.encode_ordinary(text), "<u4")

    def joined(self, text: str, leaf: int = LEAF) -> np.ndarray:
        """ordinary() of a text from its leaves."""
        if len(text) <= 2 * leaf:
            return self.ordinary(text)
        leaves = [text[i : i + leaf] for i in range(0, len(text), leaf)]
        return self.tree([(t.encode(), self.ordinary(t)) for t in leaves])

    def encode(self, text: str) -> np.ndarray:
        found = parts(text, self.cut)
        if len(found) == 1:
            return self.joined(text)
        return np.concatenate([self.joined(p) if i % 2 == 0 else np.array([self.special[p]], "<u4") for i, p in enumerate(found)])

    def raw(self, ids: np.ndarray) -> bytes:
        return b"".join(map(self.bytes.__getitem__, ids.tolist()))

    def decode(self, ids: np.ndarray) -> str:
        return self.raw(ids).decode("utf-8", "replace")

    # Joins ------------------------------------------------------------------------------------

    def _edge(self, data: bytes, at: int) -> str:
        """What a window may rest on at a place: 'gap', 'letters' or ''."""
        if not 0 < at < len(data) or data[at] & 0xC0 == 0x80:
            return ""
        past = data[max(0, at - 16) : at].decode("utf-8", "ignore")[-3:]
        here = data[at : at + 4].decode("utf-8", "ignore")[:1]
        if not past or not here:
            return ""
        if UNIT.match(here) and re.match(f"[{SPACE}]", here) and not re.match(f"[{SPACE}]", past[-1]):
            return "gap"
        return "letters" if len(past) == 3 and past.isalpha() and here.isalpha() else ""

    def join(self, left: tuple[bytes, np.ndarray], right: tuple[bytes, np.ndarray]) -> tuple[bytes, np.ndarray]:
        """The encoding of left's text and right's text together, from the encodings of each."""
        data, a, b = left[0] + right[0], left[1], right[1]
        if not len(a) or not len(b):
            return data, b if not len(a) else a
        ends_a, ends_b = np.cumsum(self.length[a]), np.cumsum(self.length[b]) + len(left[0])
        window = 16
        while True:
            i, i_edge = max(0, len(a) - window), "end"
            while i > 0 and not (i_edge := self._edge(data, int(ends_a[i - 1]))):
                i -= 1
            i_edge = i_edge if i else "end"
            j, j_edge = min(len(b), window), "end"
            while j < len(b) and not (j_edge := self._edge(data, int(ends_b[j - 1]))):
                j += 1
            j_edge = j_edge if j < len(b) else "end"
            start, end = (int(ends_a[i - 1]) if i else 0), int(ends_b[j - 1])
            ids = self.ordinary(data[start:end].decode())
            if (i_edge != "letters" or ids[0] == a[i]) and (j_edge != "letters" or ids[-1] == b[j - 1]):
                return data, np.concatenate([a[:i], ids, b[j:]])
            window *= 2

    def tree(self, runs: list[tuple[bytes, np.ndarray]]) -> np.ndarray:
        """Joins neighbouring runs pair by pair until one is left."""
        while len(runs) > 1:
            runs = [self.join(*runs[k : k + 2]) if k + 1 < len(runs) else runs[k] for k in range(0, len(runs), 2)]
        return runs[0][1]


@functools.lru_cache(maxsize=1)
def codec(path: str) -> Codec:
    """One for each Python worker and file."""
    return Codec(path)


def _lists(ids: list[np.ndarray]) -> pa.Array:
    ends = np.cumsum([0, *map(len, ids)])
    values = np.concatenate([np.zeros(0, np.uint32), *ids]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(values, pa.int32()))


def _decoded(c: Codec, ids: list[np.ndarray]) -> list[pa.Array]:
    return [pa.array([np.asarray(i, "<u4").tobytes() for i in ids], pa.binary()), pa.array(map(c.decode, ids), pa.string())]


def _texts(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Slices of a batch with about SLICE bytes of text each."""
    size = np.asarray(pa.compute.binary_length(batch["text"])).astype(np.int64)
    for i, j in slices(np.append(0, np.cumsum(size)), SLICE):
        yield batch.slice(i, j - i)


def _encoded(docs: DataFrame, path: str, leaf: int, make: Callable[[Codec, list[np.ndarray]], list[pa.Array]], schema: str) -> DataFrame:
    """doc_id and what `make` makes of the ids of every whole text, in the task that encodes or joins it."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    names = [f.split()[0] for f in schema.split(", ")]
    size = F.char_length("text")

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path)
        for batch in batches:
            for part in _texts(batch):
                yield pa.RecordBatch.from_arrays([part["doc_id"], *make(c, [c.encode(t.as_py()) for t in part["text"]])], names)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _, special = special_tokens(path)
        for batch in batches:
            for doc_id, key, text in zip(batch["doc_id"].to_pylist(), batch["key"].to_pylist(), batch["text"]):
                out = [(doc_id, key, p, i, part[at : at + leaf]) for p, part in enumerate(parts(text.as_py(), special))
                       for i, at in enumerate(range(0, max(1, len(part)), leaf if p % 2 == 0 else len(part)))]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(x, t) for x, t in zip(zip(*out), (pa.int64(), pa.string(), pa.int32(), pa.int32(), pa.string()))],
                    ["doc_id", "key", "part", "leaf", "text"])

    def leaves(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path)
        for batch in batches:
            ids = [np.array([c.special[t]], "<u4") if p % 2 else c.joined(t) for t, p in zip(batch["text"].to_pylist(), batch["part"].to_pylist())]
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array([i.tobytes() for i in ids], pa.binary())], ["doc_id", "key", "part", "leaf", "ids"])

    def join(table: pa.Table) -> pa.Table:
        c = codec(path)
        table = table.sort_by([("part", "ascending"), ("leaf", "ascending")])
        same = int(((table["part"].to_numpy() == 0) & (table["leaf"].to_numpy() == 0)).sum())  # repeated rows: so many equal leaves
        table = table.take(pa.array(range(0, len(table), same)))
        part = table["part"].to_numpy()
        ids = [np.frombuffer(i.as_py(), "<u4") for i in table["ids"]]
        runs = [(c.raw(i), i) for i in ids]
        heads = np.append(np.flatnonzero(np.diff(part, prepend=-1)), len(part))
        made = make(c, [np.concatenate([c.tree(runs[a:b]) for a, b in zip(heads[:-1], heads[1:])])])
        one = pa.table([table["doc_id"].slice(0, 1), *made], names=names)
        return pa.concat_tables([one] * same)

    short = rows.where(size <= 2 * leaf).mapInArrow(whole, schema)
    long = rows.where(size > 2 * leaf).withColumn("key", F.md5("text")).mapInArrow(cut, "doc_id long, key string, part int, leaf int, text string")
    found = long.repartition("doc_id", "key", "part", "leaf").mapInArrow(leaves, "doc_id long, key string, part int, leaf int, ids binary")
    return short.unionByName(found.groupBy("doc_id", "key").applyInArrow(join, schema))


def encode(docs: DataFrame, path: str, leaf: int = SPREAD_LEAF) -> DataFrame:
    """doc_id and ids of every whole text."""
    return _encoded(docs, path, leaf, lambda c, ids: [_lists(ids)], "doc_id long, ids array<int>")


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """doc_id, ids and decoded: the text that the ids stand for."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path)
        for batch in batches:
            yield pa.RecordBatch.from_arrays(
                [batch["doc_id"], batch["ids"], pa.array([c.decode(np.asarray(i.values)) for i in batch["ids"]], pa.string())], ["doc_id", "ids", "decoded"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, ids array<int>, decoded string")


def round_trip(docs: DataFrame, path: str, leaf: int = SPREAD_LEAF) -> DataFrame:
    """doc_id, ids as little-endian unsigned 32-bit integers, and decoded, the text they stand for, by one task for each text."""
    return _encoded(docs, path, leaf, _decoded, "doc_id long, ids binary, decoded string")
