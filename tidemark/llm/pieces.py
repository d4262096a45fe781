"""SentencePiece encoding and decoding with a BPE model file, keeping each piece's place in the original text.

A text is normalised by the file's compiled character map: at every place the longest prefix that the map's
double array holds is replaced, else one character stands for itself. Each byte of the normalised text
records the original byte at which its prefix began, so that the ends of a piece, which are known in
normalised bytes, give a span of original bytes. White space becomes U+2581 and a text gets one more in front, as the
file says. Merging runs over units, words with the white space before them, which no piece of the file crosses;
where some piece does, the whole text is one unit.

Pieces that the file lacks fall back to bytes; of the bytes of one character all but the last have an empty span
at its start, as in the sentencepiece library. Null text is empty; it has no ids and decodes to the empty text. Repeated
rows give repeated results, ties of merge scores go to the left, extra columns are ignored, an empty
table gives an empty one. A text is encoded in one task, in time n log n however long its units are.
"""

from __future__ import annotations

import functools
import heapq
import re
import struct
from collections import Counter
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import encoding
from .exchange import slices
from .text import trim

SLICE = 2_000_000  # bytes of text that a task works on at a time
#: How model files mark white space, their kinds of pieces, the fields of theirs that are read here, and what broken bytes decode to.
SPACE, SPACE_BYTES = "▁", "▁".encode()
NORMAL, UNKNOWN, CONTROL, BYTE = 1, 2, 3, 6
BPE = 2
BROKEN = "�"
ENCODED = "doc_id long, ids array<int>, starts array<int>, ends array<int>"


def fields(message: bytes) -> Iterator[tuple[int, int | bytes]]:
    """Number and value of each field of a protocol-buffer message."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = message[at]
            at += 1
            value |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return value

    while at < len(message):
        key = varint()
        kind = key & 7
        if kind == 0:
            yield key >> 3, varint()
        else:
            size = varint() if kind == 2 else 8 if kind == 1 else 4
            yield key >> 3, message[at : at + size]
            at += size


class CharacterMap:
    """Replacements of prefixes: a double array whose leaves point into texts that end in a zero byte."""

    def __init__(self, compiled: bytes):
        size = struct.unpack_from("<I", compiled)[0]
        self.units = np.frombuffer(compiled, "<u4", size // 4, 4).tolist()
        self.texts = compiled[4 + size :]
        #: Whether a replaced prefix may begin with a byte.
        self.begins = [self._step(self._base(0), byte) is not None for byte in range(256)]

    def _base(self, node: int) -> int:
        unit = self.units[node]
        return node ^ ((unit >> 10) << ((unit & 0x200) >> 6))

    def _step(self, base: int, byte: int) -> int | None:
        node = base ^ byte
        return node if node < len(self.units) and self.units[node] & 0x800000FF == byte else None

    def longest(self, data: bytes, at: int) -> tuple[int, bytes]:
        """Length and replacement of the longest prefix at a place; 0 if there is none."""
        length, leaf, base = 0, 0, self._base(0)
        for i in range(at, len(data)):
            node = self._step(base, data[i])
            if node is None:
                break
            base = self._base(node)
            if self.units[node] >> 8 & 1:
                length, leaf = i + 1 - at, self.units[base] & 0x7FFFFFFF
        return length, self.texts[leaf : self.texts.index(0, leaf)] if length else b""


class Normaliser:
    """Normalised bytes of a text, and for each of them, and for their end, the original byte they come from."""

    def __init__(self, compiled: bytes = b"", prefix: bool = True, squeeze: bool = True, escape: bool = True, suffix: bool = False):
        self.map = CharacterMap(compiled) if compiled else None
        self.prefix, self.squeeze, self.suffix = prefix and not suffix, squeeze, prefix and suffix
        self.space = SPACE_BYTES if escape else b" "

    def __call__(self, data: bytes) -> tuple[bytes, np.ndarray]:
        if not data:
            return b"", np.zeros(1, np.int64)
        return self._mapped(data) if self.map or self.squeeze or self.suffix else self._plain(data)

    def _plain(self, data: bytes) -> tuple[bytes, np.ndarray]:
        """Without replacements every character stands for itself."""
        raw = np.frombuffer(data, np.uint8)
        at = np.arange(len(raw) + 1)
        at[:-1][raw & 0xC0 == 0x80] = 0
        at = np.maximum.accumulate(at)
        widths = np.ones(len(at), np.int64)
        widths[:-1][raw == 32] = len(self.space)
        widths[0] += len(self.space) * self.prefix
        return self.space * self.prefix + data.replace(b" ", self.space), np.repeat(at, widths)

    def _prefixes(self, data: bytes) -> Iterator[tuple[int, bytes]]:
        """Where each prefix begins, and what it becomes."""
        at = 0
        while at < len(data):
            length, text = self.map.longest(data, at) if self.map and self.map.begins[data[at]] else (0, b"")
            if not length:
                length = 1 if data[at] < 0x80 else 2 if data[at] < 0xE0 else 3 if data[at] < 0xF0 else 4
                text = data[at : at + length]
            yield at, text
            at += length

    def _mapped(self, data: bytes) -> tuple[bytes, np.ndarray]:
        out, origin, end = bytearray(), [], len(data)
        # White space that is squeezed follows other white space, or stands at either end.
        after_space, begun = self.squeeze, False
        for at, text in self._prefixes(data):
            if not begun:
                if self.squeeze and text == b" ":
                    continue
                begun = True
                out += self.space * self.prefix
                origin += [at] * (len(self.space) * self.prefix)
            if after_space:
                text = text.lstrip(b" ")
            if text:
                put = text.replace(b" ", self.space)
                out += put
                origin += [at] * len(put)
                after_space = self.squeeze and text.endswith(b" ")
        if not begun:
            return b"", np.zeros(1, np.int64)
        while self.squeeze and out.endswith(self.space):
            end = origin[-len(self.space)]
            del out[-len(self.space) :], origin[-len(self.space) :]
        if self.suffix:
            out += self.space
            origin += [end] * len(self.space)
        return bytes(out), np.array([*origin, end], np.int64)


class Merger:
    """ids of normalised texts: neighbours merge by falling score, equal scores from the left.

    Where pieces' scores differ their order is a rank, and a library merges by ranks: first the bytes of each character,
    then characters. Units in which pieces of equal scores may meet are merged by an agenda of scores and places.
    """

    def __init__(self, scores: dict[str, tuple[float, int]], byte_ids: list[int]):
        self.scores, self.byte_ids = scores, byte_ids
        long = [t for t in scores if len(t) > 1]
        crossed = any(re.search(f"[^{SPACE}]{SPACE}", t) for t in long)
        unit = "(?s:.+)" if crossed else f"{SPACE}*[^{SPACE}]+|{SPACE}+"
        self.unit = re.compile(unit)
        shared = Counter(scores[t][0] for t in long)
        apart = sorted((t for t in long if shared[scores[t][0]] > 1 or self.merge(t) != [scores[t][1]]), key=len, reverse=True)
        self.apart = re.compile("|".join(map(re.escape, apart))) if apart else None
        ranks = {bytes([b]): b for b in range(256)}
        chars = {c.encode() for t in scores for c in t}
        for start in sorted({c[:k] for c in chars for k in range(2, len(c) + 1)}, key=lambda b: (len(b), b)):
            ranks[start] = len(ranks)
        for t in sorted(long, key=lambda t: -scores[t][0]):
            ranks[t.encode()] = len(ranks)
        known = {t.encode(): i for t, (_, i) in scores.items()}
        self.ranked = encoding(unit, ranks)
        #: The id of each rank, or -1 for what stands for several bytes that are no piece.
        self.ids = np.array([known.get(b, byte_ids[b[0]] if len(b) == 1 else -1) for b in ranks], np.int32)
        self.broken = {r: [*map(byte_ids.__getitem__, b)] for b, r in ranks.items() if self.ids[r] < 0}

    def __call__(self, text: str) -> np.ndarray:
        if not self.apart or not self.apart.search(text):
            return self._by_rank(text)
        out, begun = [], 0
        for found in self.unit.finditer(text):
            if self.apart.search(found[0]):
                out += [self._by_rank(text[begun : found.start()]), np.array(self.merge(found[0]), np.int32)]
                begun = found.end()
        return np.concatenate([*out, self._by_rank(text[begun:])])

    def _by_rank(self, text: str) -> np.ndarray:
        found = np.array(self.ranked.encode_ordinary(text), np.int64)
        ids = self.ids[found]
        if not (ids < 0).any():
            return ids
        return np.fromiter(chain.from_iterable(self.broken[r] if i < 0 else (i,) for r, i in zip(found.tolist(), ids.tolist())), np.int32)

    def merge(self, unit: str) -> list[int]:
        """The ids of one unit by an agenda."""
        scores, n = self.scores, len(unit)
        symbols: list[str] = list(unit)
        before, after = list(range(-1, n - 1)), list(range(1, n + 1))
        agenda: list[tuple[float, int, int, str]] = []

        def offer(i: int, j: int) -> None:
            both = symbols[i] + symbols[j]
            if both in scores:
                heapq.heappush(agenda, (-scores[both][0], i, j, both))

        for i in range(n - 1):
            offer(i, i + 1)
        while agenda:
            _, i, j, both = heapq.heappop(agenda)
            if after[i] != j or symbols[i] + symbols[j] != both or not symbols[i]:
                continue  # one of the two has been merged since
            symbols[i], symbols[j] = both, ""
            after[i] = after[j]
            if after[j] < n:
                before[after[j]] = i
                offer(i, after[j])
            if before[i] >= 0:
                offer(before[i], i)
        found = [(s, scores.get(s)) for s in symbols if s]
        return [*chain.from_iterable((known[1],) if known else map(self.byte_ids.__getitem__, s.encode()) for s, known in found)]


class PieceCodec:
    """Encodes and decodes with one model file: BPE, with bytes for what has no piece."""

    def __init__(self, path: str):
        pieces, model, spec = [], {}, {}
        with open(path, "rb") as f:
            for number, value in fields(f.read()):
                if number == 1:
                    pieces.append(dict(fields(value)))
                elif number == 2:
                    model = dict(fields(value))
                elif number == 3:
                    spec = dict(fields(value))
        texts = [p[1].decode() for p in pieces]
        kinds = [p.get(3, NORMAL) for p in pieces]
        if model.get(3) != BPE or not model.get(35) or not {*kinds} <= {NORMAL, UNKNOWN, CONTROL, BYTE}:
            raise ValueError("the file must be a BPE model with byte pieces, without pieces of a user's own")
        scores = {t: (struct.unpack("<f", p.get(2, bytes(4)))[0], i) for i, (t, k, p) in enumerate(zip(texts, kinds, pieces)) if k == NORMAL}
        byte_ids = [i for i, k in enumerate(kinds) if k == BYTE]  # <0x00> to <0xFF>
        self.merger = Merger(scores, byte_ids)
        self.prefix = bool(spec.get(3, 1))
        self.normalise = Normaliser(spec.get(2, b""), self.prefix, bool(spec.get(4, 1)), bool(spec.get(5, 1)), bool(model.get(24)))
        self.raw_bytes = [bytes([int(t[3:5], 16)]) if k == BYTE else t.encode() if k == NORMAL else b"" for t, k in zip(texts, kinds)]
        self.length = np.array([*map(len, self.raw_bytes)], np.int64)
        self.text_bytes = [b if k == BYTE else b.replace(SPACE_BYTES, b" ") for b, k in zip(self.raw_bytes, kinds)]
        self.text_length = np.array([*map(len, self.text_bytes)], np.int64)
        self.is_byte = np.array([k == BYTE for k in kinds])
        self.surface = [(model.get(44) or b" \xe2\x81\x87 ") if k == UNKNOWN else b for b, k in zip(self.text_bytes, kinds)]
        self.squeezed = bool(spec.get(4, 1))

    def encode(self, text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """ids, and where each one's span of original bytes begins and ends."""
        normal, origin = self.normalise(text.encode())
        ids = self.merger(normal.decode())
        ends = np.cumsum(self.length[ids])
        return ids, origin[ends - self.length[ids]], origin[ends]

    def raw(self, ids: np.ndarray) -> bytes:
        """The bytes that ids stand for, with spaces for U+2581, the one in front among them."""
        return b"".join(map(self.text_bytes.__getitem__, ids.tolist()))

    def decode(self, ids: np.ndarray) -> str:
        parts = [self.surface[i] for i in ids.tolist()]
        if self.prefix or self.squeezed:  # the white space that encoding put in front
            for k, (i, part) in enumerate(zip(ids.tolist(), parts)):
                if self.raw_bytes[i].startswith(SPACE_BYTES) and not self.is_byte[i]:
                    parts[k] = part[1:]
                    if self.squeezed:
                        continue
                if part or self.is_byte[i]:
                    break
        try:
            return b"".join(parts).decode()
        except UnicodeDecodeError:
            return "".join(self._decoded(ids, parts))

    def _decoded(self, ids: np.ndarray, parts: list[bytes]) -> Iterator[str]:
        """Runs of byte pieces on their own: each byte that is part of no character is BROKEN."""
        at, kinds = 0, self.is_byte[ids]
        edges = [*(np.flatnonzero(np.diff(kinds)) + 1).tolist(), len(ids)]
        for end in edges:
            run = b"".join(parts[at:end])
            while run:
                try:
                    yield run.decode()
                    break
                except UnicodeDecodeError as e:
                    yield run[: e.start].decode() + BROKEN
                    run = run[e.start + 1 :]
            at = end


@functools.lru_cache(maxsize=1)
def piece_codec(path: str) -> PieceCodec:
    """One for each Python worker and file."""
    return PieceCodec(path)


def lists(values: list[np.ndarray]) -> pa.Array:
    ends = np.cumsum([0, *map(len, values)])
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate([np.zeros(0, np.int32), *values]).astype(np.int32), pa.int32()))


def text_slices(batch: pa.RecordBatch, most: int) -> Iterator[pa.RecordBatch]:
    """Slices of a batch with about `most` bytes of text each."""
    size = np.asarray(pa.compute.binary_length(batch["text"])).astype(np.int64)
    for i, j in slices(np.append(0, np.cumsum(size)), most):
        yield batch.slice(i, j - i)


def texts(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))


def _encoded(docs: DataFrame, path: str, decoded: bool) -> DataFrame:
    names = [f.split()[0] for f in ENCODED.split(", ")] + ["decoded"] * decoded

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = piece_codec(path)
        for batch in batches:
            for part in text_slices(batch, SLICE):
                found = [c.encode(t.as_py()) for t in part["text"]]
                columns = [part["doc_id"], *(lists([f[k] for f in found]) for k in range(3))]
                if decoded:
                    columns.append(pa.array([c.decode(f[0]) for f in found], pa.string()))
                yield pa.RecordBatch.from_arrays(columns, names)
        trim()

    return texts(docs).mapInArrow(run, ENCODED + ", decoded string" * decoded)


def encode(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, ids, starts and ends of every whole text: each piece's span of the text's UTF-8 bytes."""
    return _encoded(docs, path, False)


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """doc_id, ids and decoded: the text that any list of ids stands for; null ids are none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = piece_codec(path)
        for batch in batches:
            ids = [np.array(i.as_py() or (), np.int32) for i in batch["ids"]]
            yield pa.RecordBatch.from_arrays([batch["doc_id"], batch["ids"], pa.array(map(c.decode, ids), pa.string())], ["doc_id", "ids", "decoded"])

    return encoded.select("doc_id", F.col("ids").cast("array<int>")).mapInArrow(run, "doc_id long, ids array<int>, decoded string")


def round_trip(docs: DataFrame, path: str) -> DataFrame:
    """encode() with decoded, the text that the ids stand for, in the same task."""
    return _encoded(docs, path, True)
