"""LM scoring with a log-frequency Bloom filter of quantised bigram counts, broadcast to the workers.

Tokens are words `[^\\x20\\x09-\\x0D]+` with A-Z lower-cased, then one end; the end also stands
before the first word. A bigram seen c >= 1 times in training has the level floor(log2 c) + 1 and
enters the filter once for each level up to it. Probing level after level until one is absent gives
a level back, which stands for the mean count of a level under a 1/c**2 law, less LESS. A context
enters with the mass S of its bigrams, in half powers of two above that of one bigram seen once,
which takes no entry. Unigram counts are exact. The probability of w after h is

    (count(h, w) + (max(c(h) - S(h), 0) + 1) * p(w)) / (max(c(h), S(h)) + 1),
    p(w) = (c(w) + 1) / (N + V + 1),

so what is taken off the bigrams' counts goes back to the unigrams, and the sum over w is at
most 1 but for false positives of the filter (about 1 in 80 of the levels that a key lacks).

The filter's size follows the distinct bigrams. Up to max_filter_mb it is broadcast;
beyond that its segments stay in Spark, every batch sends its distinct bigrams to them, and the
tasks that hold a segment probe it and answer. Both ways give the same scores.

Null and empty texts have the end alone. A null doc_id counts as training. Repeated rows count as
documents of their own. With no training tokens N = V = 0 and every score is 0. An empty table
gives an empty one. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import exchange as ex
from .text import LOWER, mix, trim, unmix, utf8, word_hashes, words

END = np.uint64(0xD1B54A32D192ED03)
LOW = np.uint64((1 << 28) - 1)
PROBES, BITS = 4, 10
LESS = 0.8  # off each bigram's count, for the bigrams that training lacks
SCORES = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
SCORES_TYPE = pa.schema([
    ("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()),
    ("train_tokens", pa.int64()), ("base_score", pa.float64()), ("score", pa.float64())])
LEARNED = "kind int, seg int, bits long, data binary, vals binary"
LEARNED_TYPE = pa.schema([("kind", pa.int32()), ("seg", pa.int32()), ("bits", pa.int64()), ("data", pa.binary()), ("vals", pa.binary())])
BIGRAM, CONTEXT = 0, 1
HEAD = 16  # bytes of a reply's head: a bucket's distinct and all training tokens


def tokens(column) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all tokens, each document's words and then END, and the documents' numbers."""
    data, offsets = utf8(column)
    data = LOWER[data]
    start, end, doc = words(data, offsets)
    hashes, n = word_hashes(data, start, end), len(offsets) - 1
    counts = np.bincount(doc, minlength=n)
    out = np.full(len(hashes) + n, END)
    of = np.repeat(np.arange(n), counts + 1)
    place = np.arange(len(hashes)) + doc
    out[place] = hashes
    return out, of


def bigrams(hashes: np.ndarray) -> np.ndarray:
    """Mixed keys of (token before, token); before a document's first word stands END."""
    before = np.concatenate([[END], hashes[:-1]]) if len(hashes) else hashes
    return mix((before & ~LOW) | (hashes >> np.uint64(36)))


def context_key(hashes: np.ndarray) -> np.ndarray:
    """36 bits of a token's hash, as the high ones."""
    return hashes & ~LOW


def counted(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    keys, n = np.unique(keys, return_counts=True)
    return keys, n.astype(np.uint32)


def places(keys: np.ndarray, level: int, bits: np.ndarray | int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The bits that n-grams set at a level, one probe at a time; send() the mask of those to go on with."""
    a = mix(keys + np.uint64(0x632BE59BD9B4E019 * level % (1 << 64)))
    b = mix(a) | np.uint64(1)
    bits = np.broadcast_to(np.asarray(bits, np.uint64), a.shape)
    for _ in range(PROBES):
        keep = yield ((a >> np.uint64(32)) * bits >> np.uint64(32)).astype(np.int64)
        if keep is not None:
            a, b, bits = a[keep], b[keep], bits[keep]
        a = a + b


def filled(keys: np.ndarray, levels: np.ndarray) -> tuple[int, bytes]:
    """A filter segment: its size in bits and its bytes. Each key enters at levels 1 to its own."""
    bits = max(64, int(levels.sum()) * BITS)
    bits += -bits % 8  # a segment is far below 2**32 bits
    out = np.zeros(bits, bool)
    for level in range(1, int(levels.max(initial=0)) + 1):
        for at in places(keys[levels >= level], level, np.uint64(bits)):
            out[at] = True
    return bits, np.packbits(out, bitorder="little").tobytes()


class Filter:
    """Segments behind one another; a key's high bits give its segment."""

    def __init__(self, sizes: dict[int, int], buckets: int):
        """sizes: bits of each segment."""
        size = [sizes.get(k, 0) for k in range(buckets)]
        self.bits = np.array(size, np.uint64)
        self.offset = np.concatenate([[0], np.cumsum(size)[:-1]]).astype(np.int64)
        self.data = np.zeros(sum(size) >> 3, np.uint8)
        self.shift = np.uint64(65 - buckets.bit_length())

    def put(self, segment: int, data: bytes) -> None:
        at = int(self.offset[segment]) >> 3
        self.data[at : at + len(data)] = np.frombuffer(data, np.uint8)

    def levels(self, keys: np.ndarray) -> np.ndarray:
        out = np.zeros(len(keys), np.uint8)
        seg = (keys >> self.shift).astype(np.int64) if self.shift < 64 else np.zeros(len(keys), np.int64)
        alive = np.flatnonzero(self.bits[seg] > 0)
        level = 0
        while len(alive) and level < 250:
            level += 1
            s = seg[alive]
            offset, probe = self.offset[s], places(keys[alive], level, self.bits[s])
            at = next(probe) + offset
            for k in range(PROBES):
                hit = (self.data[at >> 3] >> (at & 7).astype(np.uint8)) & 1 > 0
                alive, offset = alive[hit], offset[hit]
                if k + 1 < PROBES:
                    at = probe.send(hit) + offset
            out[alive] = level
        return out


def _means() -> np.ndarray:
    """The mean count of each level: of 2**(level - 1) to 2**level - 1 in proportion to 1/c**2."""
    out = [0.0]
    for level in range(1, 64):
        c = np.arange(2.0 ** (level - 1), 2.0**level) if level < 16 else None
        out.append(float((1 / c).sum() / (1 / c**2).sum()) if c is not None else 2 * np.log(2) * 2.0 ** (level - 1))
    return np.array(out)


MEANS = _means()


def bigram_count(level: np.ndarray) -> np.ndarray:
    """What a level stands for, less LESS."""
    return np.where(level > 0, MEANS[np.minimum(level, len(MEANS) - 1)] - LESS, 0.0)


def context_level(mass: np.ndarray) -> np.ndarray:
    return np.maximum(np.ceil(2 * np.log2(mass / (1 - LESS)) - 1e-6), 0).astype(np.int64)


def context_mass(level: np.ndarray) -> np.ndarray:
    """At least the mass that has the level, for a context that training has."""
    return (1 - LESS) * np.exp2(level / 2.0)


class Model:
    """What training learned; `learned` lies in the shared checkpoint folder."""

    def __init__(self, learned: DataFrame, contexts: DataFrame, buckets: int):
        self.segments = learned.where(F.col("kind") == BIGRAM).select("kind", "seg", "bits", "data").unionByName(
            contexts.select("kind", "seg", "bits", "data"))
        self.buckets = buckets
        self.filter_mb = (self.segments.agg(F.sum("bits")).first()[0] or 0) / 8e6


def train(docs: DataFrame, learn: Column, buckets: int) -> Model:
    """Counts bigrams of the rows for which `learn` holds, and fills the filter."""

    def send(parts):
        for batch in parts:
            offsets = np.append(0, np.cumsum(np.asarray(pa.compute.fill_null(pa.compute.binary_length(batch["text"]), 0)).astype(np.int64)))
            for i, j in ex.slices(offsets, 16_000_000):
                hashes, _ = tokens(batch.slice(i, j - i)["text"])
                keys, n = counted(bigrams(hashes))
                yield from ex.questions(0, keys, buckets, n).to_batches()
        trim()

    def count(table: pa.Table) -> pa.Table:
        asked = ex.Asked(table, np.uint32)
        order, heads, _ = asked.grouped()
        n = np.add.reduceat(asked.values[order].astype(np.int64), heads)
        keys = asked.keys[order][heads]
        levels = np.floor(np.log2(n)).astype(np.int64) + 1
        rows = [(BIGRAM, asked.bucket, *filled(keys, levels), None)]
        of, where = np.unique(context_key(unmix(keys)), return_inverse=True)
        mass = np.bincount(where, bigram_count(levels), len(of)).astype(np.float32)
        bounds = ex.bucket_bounds(of, buckets)
        for k in np.flatnonzero(np.diff(bounds)):
            a, b = bounds[k], bounds[k + 1]
            rows.append((CONTEXT, int(k), int(b - a), ex.pack(of[a:b] >> np.uint64(28)), mass[a:b].tobytes()))
        return pa.table([pa.array(c, t) for c, t in zip(zip(*rows), LEARNED_TYPE.types)], schema=LEARNED_TYPE)

    def weigh(table: pa.Table) -> pa.Table:
        keys = np.concatenate([ex.unpack(k.as_py(), n.as_py()) for k, n in zip(table["data"], table["bits"])])
        keys = keys << np.uint64(28)
        mass = np.concatenate([np.frombuffer(v.as_py(), np.float32) for v in table["vals"]])
        keys, where = np.unique(keys, return_inverse=True)
        levels = context_level(np.bincount(where, mass))
        rows = [(CONTEXT, table["seg"][0].as_py(), *filled(keys, levels), None)]
        return pa.table([pa.array(c, t) for c, t in zip(zip(*rows), LEARNED_TYPE.types)], schema=LEARNED_TYPE)

    texts = docs.where(learn).select(F.col("text").cast("string").alias("text"))
    learned = texts.mapInArrow(send, ex.ASK).groupBy("_k").applyInArrow(count, LEARNED).checkpoint()
    contexts = learned.where(F.col("kind") == CONTEXT).groupBy("seg").applyInArrow(weigh, LEARNED).checkpoint()
    return Model(learned, contexts, buckets)


def lm_scores(docs: DataFrame, held_out: Column, batch_mb: float = 16, max_filter_mb: float = 128) -> DataFrame:
    """Scores of every document by a model of those that aren't held out; see the module."""
    held = F.coalesce(held_out, F.lit(False))
    batches = ex.Batches(docs, batch_mb, held_out=held)
    buckets = batches.buckets(0.16)
    model = train(docs, ~held, buckets)
    spark, near = docs.sparkSession, model.filter_mb <= max_filter_mb
    shared = None
    if near:
        sizes: dict[int, dict[int, int]] = {BIGRAM: {}, CONTEXT: {}}
        for r in model.segments.select("kind", "seg", "bits").collect():  # a few numbers for each segment
            sizes[r["kind"]][r["seg"]] = r["bits"]
        filters = {kind: Filter(x, buckets) for kind, x in sizes.items()}
        for r in model.segments.select("kind", "seg", "data").toLocalIterator():  # at most max_filter_mb, a task's segments at a time
            filters[r["kind"]].put(r["seg"], r["data"])
        shared = spark.sparkContext.broadcast(filters)
        del filters

    def needed(table: pa.Table):
        hashes, of = tokens(table["text"])
        train_token = ~np.asarray(table["held_out"])[of]
        keys, where = np.unique(mix(hashes), return_inverse=True)
        return hashes, keys, np.bincount(where, train_token, len(keys)).astype(np.uint32)

    def send(table: pa.Table) -> pa.Table:
        hashes, keys, n = needed(table)
        b = table["_b"][0].as_py()
        parts = [ex.questions(b, keys, buckets, n, every=True)]  # so that every batch hears all totals
        if not near:
            for kind, more in ((1, bigrams(hashes)), (2, context_key(hashes))):
                rows = ex.questions(b, np.unique(more), buckets)
                parts.append(rows.set_column(1, "_k", pa.array(rows["_k"].to_numpy() + np.int32(kind * buckets))))
        return pa.concat_tables(parts)

    def reply(table: pa.Table, segment: pa.Table) -> pa.Table:
        if not len(table):
            return ex.ANSWER_TYPE.empty_table()
        kind = table["_k"][0].as_py() // buckets
        asked = ex.Asked(table, np.uint32 if kind == 0 else None)
        if kind == 0:
            order, heads, group = asked.grouped()
            n = np.add.reduceat(asked.values[order].astype(np.int64), heads) if len(heads) else np.zeros(0, np.int64)
            return asked.answer(n[group], head=np.array([(n > 0).sum(), n.sum()], np.int64).tobytes())
        own = Filter({asked.bucket % buckets: bits for bits in segment["bits"].to_pylist()}, buckets)
        for data in segment["data"]:
            own.put(asked.bucket % buckets, data.as_py())
        return asked.answer(own.levels(asked.keys))

    def work(table: pa.Table, replies: pa.Table) -> pa.Table:
        hashes, of = tokens(table["text"])
        keys, where = np.unique(mix(hashes), return_inverse=True)

        def part(kind: int) -> pa.Table:
            k = replies["_k"].to_numpy()
            mine = replies.filter(pa.array((k >= kind * buckets) & (k < (kind + 1) * buckets)))
            return mine.set_column(1, "_k", pa.array(mine["_k"].to_numpy() - np.int32(kind * buckets)))

        counts = part(0)
        known = ex.heard(counts, keys, buckets, np.int64, skip=HEAD)
        vocabulary, total = np.sum([np.frombuffer(r.as_py(), np.int64, 2) for r in counts["reply"]], 0).tolist()
        contexts, contexts_at = np.unique(context_key(unmix(keys)), return_inverse=True)
        two, two_at = np.unique(bigrams(hashes), return_inverse=True)
        if near:
            level, mass = shared.value[BIGRAM].levels(two), shared.value[CONTEXT].levels(contexts)
        else:
            level, mass = ex.heard(part(1), two, buckets), ex.heard(part(2), contexts, buckets)
        count, level, mass = known[where], level[two_at], mass[contexts_at][where]
        p = (count + 1.0) / (total + vocabulary + 1.0)
        before = np.empty(len(count))
        mass_before = np.empty(len(count))
        n_docs = len(table)
        last = np.flatnonzero(hashes == END)
        mass = np.where(count > 0, context_mass(mass), 0.0)
        before[1:], mass_before[1:] = count[:-1], mass[:-1]
        before[:1], mass_before[:1] = count[last[:1]], mass[last[:1]]
        smooth = (bigram_count(level) + (np.maximum(before - mass_before, 0) + 1) * p) / (np.maximum(before, mass_before) + 1)
        add = lambda x: np.bincount(of, x, n_docs)
        n = np.bincount(of, minlength=n_docs)
        return pa.table([
            table["doc_id"], table["held_out"], pa.array(n), pa.array(add(count > 0).astype(np.int64)),
            pa.array(np.full(n_docs, total, np.int64)), pa.array(add(np.log10(p))), pa.array(add(np.log10(np.minimum(smooth, 1))))],
            schema=SCORES_TYPE)

    asked = batches.each(send, ex.ASK)
    segments = model.segments.select((F.col("seg") + (F.col("kind") + 1) * buckets).alias("_k"), "bits", "data")
    segments = segments.where(F.lit(not near))
    replies = asked.groupBy("_k").cogroup(segments.groupBy("_k")).applyInArrow(reply, ex.ANSWER)
    return ex.finish(batches, replies, work, SCORES)
