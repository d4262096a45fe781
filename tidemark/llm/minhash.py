"""MinHash near-dedup with b-bit signatures.

Words are `[^\\x20\\x09-\\x0D]+` of the text with A-Z lower-cased; a document's set is its distinct
`width`-word shingles, the whole sequence if it has fewer words, nothing without words. Documents
are linked if 100 * intersection >= 100 * threshold * union; empty sets are linked with nothing.

Documents of equal sets form one class, whatever their number. Class representatives are banded:
`banding` gives so many bands that a pair at the threshold is missed once in 100,000 at most (20 of
5 minima at 0.85, 24 of 4 at 0.80). In a band bucket every member is first paired with the smallest
one, so a bucket of n gives n - 1 pairs and none of its n*n; different bands pair a document with
different others. Of each distinct pair the packed b-bit signatures give, by bit counts, the
similarity corrected for chance collisions; pairs below `floor` go, which a pair at the threshold is
once in 10,000 at most. The rest are confirmed on their full sets, and confirmed links make
components. Where a bucket then still holds several components, each member outside its largest one
is compared with all members of other components, in blocks of bounded size: a task compares two
blocks' signatures, counts the common shingles of what passes, and sends only links that join two
components of the blocks. So every pair that shares a bucket is either inside one component or has
been tried.

Null texts are empty. Rows of null doc_id are linked with nothing and have the component null.
Repeated rows are in one class and keep together. Rows of one doc_id and unlike texts are documents
of their own: each has the component of its own text, and the smallest doc_id in it names it. An empty
table gives an empty one. Extra columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .components import components, let_go
from .exchange import slices
from .text import LOWER, mix, trim, utf8, window_hashes, word_hashes, words

WIDTH, THRESHOLD = 5, 85  # op7's contract; callers without one pass their own threshold
MISSED, UNLIKE = 1e-5, 1e-4  # of pairs at the threshold: share that no band finds, and that the signatures reject
PACKED = 96  # minima in a signature
BITS = 4
PER_LONG = 64 // BITS
BLOCK, BLOCK_HASHES = 1024, 200_000  # about so many members and shingles of a bucket meet as many others in a task
SMALL = 1_000_000  # rows of two or three longs that may be broadcast; more are joined by shuffles
FEATURES = "doc_id long, text_key long, n_shingles long, f1 long, f2 long, signature array<long>, bands array<long>"


def seeds(n: int) -> np.ndarray:
    return mix(np.arange(1, n + 1, dtype=np.uint64))


def banding(threshold: int) -> tuple[int, int]:
    """Bands and minima in each, of PACKED minima or more, that miss a pair at the threshold with MISSED at most."""
    rows = 5 if threshold >= 85 else 4
    share = (threshold / 100) ** rows
    bands = 1 if share >= 1 else math.ceil(math.log(MISSED) / math.log1p(-share))
    return max(bands, -(-PACKED // rows)), rows


def floor(threshold: int) -> float:
    """The estimate below which a pair at the threshold stays with UNLIKE at most; half a step under the last that passes."""
    differ = (1 - threshold / 100) * (1 - 1 / (1 << BITS))
    passed, most = 0.0, -1
    while passed < 1 - UNLIKE:
        most += 1
        passed += math.comb(PACKED, most) * differ**most * (1 - differ) ** (PACKED - most)
    return (1 - (most + 0.5) / PACKED - 1 / (1 << BITS)) / (1 - 1 / (1 << BITS))


def shingles(column, width: int) -> tuple[np.ndarray, np.ndarray, int]:
    """Hashes of each document's distinct shingles, where documents begin in them."""
    data, offsets = utf8(column)
    data = LOWER[data]
    start, end, doc = words(data, offsets)
    hashes = word_hashes(data, start, end)
    windows, at = window_hashes(hashes, doc, width)
    n = len(offsets) - 1
    count = np.bincount(doc, minlength=n)
    head = np.cumsum(count) - count
    of = doc[at] if len(at) else at
    bounds, out, sizes = np.searchsorted(of, np.arange(n + 1)), [], np.zeros(n, np.int64)
    for i in range(n):
        if bounds[i + 1] > bounds[i]:
            own = np.unique(windows[bounds[i] : bounds[i + 1]])
        elif count[i]:
            short = np.uint64(count[i])
            for h in hashes[head[i] : head[i] + count[i]]:
                short = mix(np.array([short ^ h]))[0]
            own = np.array([short], np.uint64)
        else:
            continue
        out.append(own)
        sizes[i] = len(own)
    return np.concatenate(out) if out else np.zeros(0, np.uint64), np.append(0, np.cumsum(sizes))


def set_hashes(hashes: np.ndarray, bounds: np.ndarray, seed: np.uint64) -> np.ndarray:
    """A 64-bit hash of each set, 0 of an empty one."""
    out, full = np.zeros(len(bounds) - 1, np.uint64), np.diff(bounds) > 0
    if full.any():
        out[full] = np.add.reduceat(mix(hashes ^ seed), bounds[:-1][full])
    return out


def minima(hashes: np.ndarray, bounds: np.ndarray, n: int) -> np.ndarray:
    """n minima of every set that isn't empty; one row a set."""
    heads = bounds[:-1][np.diff(bounds) > 0]
    out, seed = np.zeros((len(heads), n), np.uint64), seeds(2 * n)
    if len(heads):
        for p in range(n):
            out[:, p] = np.minimum.reduceat((hashes ^ seed[2 * p]) * (seed[2 * p + 1] | np.uint64(1)), heads)
    return out


def pack_bits(least: np.ndarray) -> np.ndarray:
    """The low BITS bits of each minimum, mixed first, packed into longs."""
    low = mix(least[:, :PACKED]) & np.uint64((1 << BITS) - 1)
    low = low.reshape(len(least), PACKED // PER_LONG, PER_LONG) << (np.arange(PER_LONG, dtype=np.uint64) * np.uint64(BITS))
    return np.bitwise_or.reduce(low, axis=2)


def features(docs: DataFrame, width: int = WIDTH, threshold: int = THRESHOLD) -> DataFrame:
    """doc_id, a hash of the text, n_shingles, a 128-bit hash of the set, signature and band hashes (none for empty sets)."""
    n_bands, n_rows = banding(threshold)
    first, second = seeds(2)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size = np.asarray(pa.compute.fill_null(pa.compute.binary_length(batch["text"]), 0)).astype(np.int64)
            for i, j in slices(np.append(0, np.cumsum(size)), 2_000_000):
                part = batch.slice(i, j - i)
                hashes, bounds = shingles(part["text"], width)
                n = np.diff(bounds)
                full = n > 0
                f1, f2 = set_hashes(hashes, bounds, first), set_hashes(hashes, bounds, second)
                least = minima(hashes, bounds, n_bands * n_rows)
                bands = least.reshape(len(least), n_bands, n_rows)
                key = np.broadcast_to(seeds(n_bands), (len(least), n_bands)).copy()
                for r in range(n_rows):
                    key = mix(key ^ bands[:, :, r])

                def lists(x: np.ndarray) -> pa.Array:
                    ends = np.append(0, np.cumsum(full)) * x.shape[1]
                    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(x.ravel().view(np.int64)))

                yield pa.RecordBatch.from_arrays(
                    [part["doc_id"], part["text_key"], pa.array(n), pa.array(f1.view(np.int64)), pa.array(f2.view(np.int64)), lists(pack_bits(least)), lists(key)],
                    ["doc_id", "text_key", "n_shingles", "f1", "f2", "signature", "bands"])
        trim()

    return _rows(docs).mapInArrow(run, FEATURES)


def text_key(text: str = "text") -> Column:
    return F.xxhash64(F.col(text).cast("string"))


def _rows(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_key().alias("text_key"), F.col("text").cast("string").alias("text"))


def bounded(rows: DataFrame) -> DataFrame:
    """A side of a join, broadcast if it was counted to be SMALL; it must be cheap to read twice."""
    return F.broadcast(rows) if rows.limit(SMALL + 1).count() <= SMALL else rows


def estimate(x: str, y: str) -> Column:
    """Similarity from two packed signatures: the share of equal BITS-bit numbers, less chance collisions."""
    fields = sum(1 << (BITS * i) for i in range(PER_LONG))
    fields -= 1 << 64 if fields >= 1 << 63 else 0
    unequal = F.lit(0)
    for i in range(PACKED // PER_LONG):
        d = F.col(x)[i].bitwiseXOR(F.col(y)[i])
        folded = d
        for b in range(1, BITS):
            folded = folded.bitwiseOR(F.shiftrightunsigned(d, b))
        unequal = unequal + F.bit_count(folded.bitwiseAND(F.lit(fields).cast("long")))
    chance = 1 / (1 << BITS)
    return ((1 - unequal / PACKED) - chance) / (1 - chance)


def node(doc_id: str, f: str) -> Column:
    """A class in the graph: its smallest doc_id and a hash of its set, so that unlike sets of one doc_id are two."""
    return F.struct(F.col(doc_id).alias("id"), F.col(f).alias("f"))


def _shared(classes: DataFrame) -> DataFrame:
    """key, rep, its n_shingles and the bucket's smallest member a, of the buckets with several members."""
    buckets = classes.select("id", "f1", "n_shingles", F.explode("bands").alias("key"))
    least = buckets.groupBy("key").agg(F.min("id").alias("ai"), F.min_by("f1", "id").alias("af"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    return buckets.join(least, "key").select("key", node("id", "f1").alias("rep"), "n_shingles", node("ai", "af").alias("a"))


def full_sets(docs: DataFrame, needed: DataFrame, width: int) -> DataFrame:
    """rep and s, the full set, of the classes `needed` (rep)."""
    first = seeds(1)[0]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size = np.asarray(pa.compute.fill_null(pa.compute.binary_length(batch["text"]), 0)).astype(np.int64)
            for i, j in slices(np.append(0, np.cumsum(size)), 2_000_000):
                part = batch.slice(i, j - i)
                hashes, bounds = shingles(part["text"], width)
                f = set_hashes(hashes, bounds, first)
                sets = pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(hashes.view(np.int64)))
                yield pa.RecordBatch.from_arrays([part["doc_id"], pa.array(f.view(np.int64)), sets], ["id", "f", "s"])
        trim()

    ids = bounded(needed.select(F.col("rep.id").alias("doc_id")).distinct())
    found = _rows(docs).join(ids, "doc_id", "left_semi").mapInArrow(run, "id long, f long, s array<long>")
    return found.where(F.size("s") > 0).groupBy(node("id", "f").alias("rep")).agg(F.first("s").alias("s"))


def confirmed(sets: DataFrame, pairs: DataFrame, threshold: int) -> DataFrame:
    """The pairs (a, b) whose full sets reach the threshold in hundredths."""
    first, second = sets.select(F.col("rep").alias("a"), F.col("s").alias("x")), sets.select(F.col("rep").alias("b"), F.col("s").alias("y"))
    both = F.size(F.array_intersect("x", "y"))
    return pairs.join(first, "a").join(second, "b").where(100 * both >= threshold * (F.size("x") + F.size("y") - both)).select("a", "b")


def _blocks(placed: DataFrame, classes: DataFrame) -> DataFrame:
    """key, rep, n_shingles, component c -> key, main, q, m and g: a block of a bucket's members outside its largest component `main`, and one of all.

    Components are told apart by a hash within their bucket.
    """
    sized = placed.select("key", "rep", "n_shingles", F.xxhash64("c").alias("c"))
    counts = sized.groupBy("key", "c").agg(F.count(F.lit(1)).alias("n"), F.sum("n_shingles").alias("w"))
    most = counts.groupBy("key").agg(F.count(F.lit(1)).alias("k"), F.sum("n").alias("n"), F.sum("w").alias("w"), F.max(F.struct("n", "w", "c")).alias("top"))
    parts = lambda n, w: F.greatest(F.ceil(n / BLOCK), F.ceil(w / BLOCK_HASHES))
    cut = most.where("k > 1").select("key", F.col("top.c").alias("main"), parts(F.col("n"), F.col("w")).alias("ms"),
                                     parts(F.expr("n - top.n"), F.expr("w - top.w")).alias("qs"))
    open_ = sized.join(cut, "key").select("key", "rep", "c", "main", "qs", "ms").checkpoint()  # both sides read it, so neither plans it anew
    place, every = lambda n: F.pmod(F.xxhash64("rep"), n), lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    asking = open_.where("c != main").select("key", "main", place("qs").alias("q"), every("ms").alias("m"), F.lit(True).alias("asks"), "rep", "c")
    asked = open_.select("key", "main", every("qs").alias("q"), place("ms").alias("m"), F.lit(False).alias("asks"), "rep", "c")
    known = classes.select(node("id", "f1").alias("rep"), "n_shingles", "signature", "bands")
    rows = asking.unionByName(asked).join(known, "rep")
    return rows.groupBy("key", "main", "q", "m").agg(F.collect_list(F.struct("asks", "rep.id", "rep.f", "c", "n_shingles", "signature", "bands")).alias("g"))


def _passing(g: pa.StructArray, key: int, main: int, threshold: int) -> tuple[np.ndarray, np.ndarray]:
    """Places in g of the pairs of unlike components that sizes and signatures allow, each in the first band that it shares only."""
    asks, id_, f, c, n = (np.asarray(g.field(k)) for k in range(5))
    signature, bands = (np.asarray(g.field(k).flatten()).reshape(len(g), -1) for k in (5, 6))
    rank = np.empty(len(g), np.int64)
    rank[np.lexsort((f, id_))] = np.arange(len(g))
    x, y = np.flatnonzero(asks), np.flatnonzero(~asks)
    ok = (c[x][:, None] != c[y]) & ((c[y] == main) | (rank[x][:, None] < rank[y]))
    ok &= 100 * np.minimum(n[x][:, None], n[y]) >= threshold * np.maximum(n[x][:, None], n[y])
    unequal, fields = np.zeros(ok.shape, np.int64), np.uint64(sum(1 << (BITS * i) for i in range(PER_LONG)))
    for s in range(signature.shape[1]):
        d = (signature[x, s][:, None] ^ signature[y, s]).view(np.uint64)
        unequal += np.bitwise_count(np.bitwise_or.reduce([d, *(d >> np.uint64(b) for b in range(1, BITS))]) & fields)
    ok &= (1 - unequal / PACKED - 1 / (1 << BITS)) / (1 - 1 / (1 << BITS)) >= floor(threshold)
    before, own = np.zeros(ok.shape, bool), np.zeros(ok.shape, bool)
    for s in range(bands.shape[1]):
        same = bands[x, s][:, None] == bands[y, s]
        own |= same & ~before & (bands[y, s] == key)
        before |= same
    a, b = np.nonzero(ok & own)
    return x[a], y[b]


def _links(g: pa.StructArray, a: np.ndarray, b: np.ndarray, threshold: int) -> np.ndarray:
    """Pairs (a, b) whose full sets reach the threshold, as few as join the components that all such pairs join."""
    sets = g.field(7)
    size = np.asarray(pa.compute.list_value_length(sets)).astype(np.int64)
    _, of, n = np.unique(np.asarray(sets.flatten()), return_inverse=True, return_counts=True)
    several = n > 1  # only these can be common to two sets: one bit each
    column, owner = np.cumsum(several) - 1, np.repeat(np.arange(len(g)), size)
    owner, at = owner[several[of]], column[of[several[of]]]
    bits = np.zeros((len(g), (int(several.sum()) >> 6) + 1), np.uint64)
    np.bitwise_or.at(bits, (owner, at >> 6), np.uint64(1) << (at & 63).astype(np.uint64))
    _, part = np.unique(np.asarray(g.field(3)), return_inverse=True)
    out, step = [], max(1, 4_000_000 // bits.shape[1])
    for k in range(0, len(a), step):
        i, j = a[k : k + step], b[k : k + step]
        apart = part[i] != part[j]
        i, j = i[apart], j[apart]
        common = np.bitwise_count(bits[i] & bits[j]).sum(1, dtype=np.int64)
        good = 100 * common >= threshold * (size[i] + size[j] - common)
        i, j = i[good], j[good]
        _, one = np.unique(part[i] * len(g) + part[j], return_index=True)  # one link for each two components
        for x, y in zip(i[one].tolist(), j[one].tolist()):
            if part[x] != part[y]:
                part[part == part[y]] = part[x]
                out.append((x, y))
    return np.array(out, np.int64).reshape(-1, 2)


def _across_blocks(blocks: DataFrame, sets: DataFrame, threshold: int) -> DataFrame:
    """Confirmed links (a, b) between unlike components in blocks.

    First each task names the members of its two blocks that have a partner by sizes and signatures;
    only their full sets go to the block, once each, and the task there confirms its pairs. No pair
    leaves a task but a link that joins two of its components.
    """
    at = ["key", "main", "q", "m"]

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for batch in batches:
            for i in range(len(batch)):
                row, g = [batch[k][i].as_py() for k in at], batch["g"].slice(i, 1).flatten()
                yield row, g, *_passing(g, row[0], row[1], threshold)

    def name(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row, g, a, b in each(batches):
            if len(a):
                some = np.unique(np.append(a, b))
                fixed = [pa.array(np.full(len(some), k, np.int64)) for k in row]
                yield pa.RecordBatch.from_arrays([*fixed, g.take(pa.array(some))], [*at, "d"])
        trim()

    def confirm(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, g, a, b in each(batches):
            found = _links(g, a, b, threshold)
            if len(found):
                ends = [g.take(pa.array(found[:, k])) for k in (0, 1)]
                yield pa.RecordBatch.from_arrays([pa.StructArray.from_arrays([e.field(1), e.field(2)], ["id", "f"]) for e in ends], ["a", "b"])
        trim()

    fields = "asks boolean, id long, f long, c long, n_shingles long, signature array<long>, bands array<long>"
    named = blocks.mapInArrow(name, f"key long, main long, q long, m long, d struct<{fields.replace(' ', ':').replace(',:', ',')}>")
    full = named.withColumn("rep", node("d.id", "d.f")).join(sets, "rep")
    whole = full.groupBy(*at).agg(F.collect_list(F.struct("d.*", "s")).alias("g"))
    return whole.mapInArrow(confirm, "a struct<id:long,f:long>, b struct<id:long,f:long>")


def grouped(docs: DataFrame, width: int = WIDTH, threshold: int = THRESHOLD) -> DataFrame:
    """Row by row doc_id, text_key, n_shingles and group: the least (id, f) of the component; null for empty sets and null doc_ids."""
    found = features(docs, width, threshold).checkpoint()
    classes = found.where("n_shingles > 0 and doc_id is not null").groupBy("f1", "f2", "n_shingles").agg(
        F.min("doc_id").alias("id"), F.first("signature").alias("signature"), F.first("bands").alias("bands")).checkpoint()
    signatures = classes.select(node("id", "f1").alias("rep"), "signature")

    let_go(docs.sparkSession)  # here and below: what plans and stages left, before the next large plan
    shared = _shared(classes).checkpoint()
    star = shared.where("rep != a").select("a", F.col("rep").alias("b")).distinct().checkpoint()  # each class that any pair can hold is in it
    sets = full_sets(docs, star.select(F.explode(F.array("a", "b")).alias("rep")), width).checkpoint()
    let_go(docs.sparkSession)
    signed = star.join(signatures.toDF("a", "x"), "a").join(signatures.toDF("b", "y"), "b")
    links = confirmed(sets, signed.where(estimate("x", "y") >= floor(threshold)).select("a", "b"), threshold)
    parts = components(links)
    placed = shared.join(parts, F.col("rep") == F.col("node"), "left").select("key", "rep", "n_shingles", F.coalesce("component", "rep").alias("c"))
    blocks = _blocks(placed, classes)
    let_go(docs.sparkSession)
    rest = _across_blocks(blocks, sets, threshold).checkpoint()
    if not rest.isEmpty():
        parts = components(parts.select(F.col("node").alias("a"), F.col("component").alias("b")).unionByName(rest))
    member = classes.select("f1", "f2", "n_shingles", node("id", "f1").alias("rep")).join(parts, F.col("rep") == F.col("node"), "left").select(
        "f1", "f2", "n_shingles", F.coalesce("component", "rep").alias("group"))
    rows = found.select("doc_id", "text_key", "n_shingles", "f1", "f2")
    alone = F.col("doc_id").isNull() | (F.col("n_shingles") == 0)
    return rows.where(~alone).join(member, ["f1", "f2", "n_shingles"]).select("doc_id", "text_key", "n_shingles", "group").unionByName(
        rows.where(alone).select("doc_id", "text_key", "n_shingles", F.lit(None).cast("struct<id:long,f:long>").alias("group")))


def near_duplicates(docs: DataFrame, width: int = WIDTH, threshold: int = THRESHOLD) -> DataFrame:
    """doc_id, n_shingles, component_id (the smallest doc_id reachable over links) and kept (doc_id is it)."""
    component = F.coalesce(F.col("group.id"), F.col("doc_id"))
    return grouped(docs, width, threshold).select(
        "doc_id", "n_shingles", component.alias("component_id"), F.coalesce(component == F.col("doc_id"), F.lit(True)).alias("kept"))


def without_near_duplicates(docs: DataFrame, width: int = WIDTH, threshold: int = THRESHOLD) -> DataFrame:
    """docs with one row of each group: that of the smallest doc_id, of its texts the one of the smallest hash, of equal rows any.

    Rows without words or doc_id are in no group and stay.
    """
    rows = grouped(docs, width, threshold).where("group is not null").select("group", F.struct("doc_id", "text_key").alias("k")).checkpoint()
    first = rows.groupBy("group").agg(F.min("k").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    several = rows.join(first, "group").checkpoint()
    key = lambda c: c.select(F.col("k.doc_id").alias("_id"), F.col("k.text_key").alias("_t"))
    gone = bounded(key(several.where("k != first")).distinct().checkpoint())
    twice = bounded(key(several.where("k = first").groupBy("k").agg(F.count(F.lit(1)).alias("n")).where("n > 1")).checkpoint())
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    left = docs.select(row, F.col("doc_id").cast("long").alias("_id"), text_key().alias("_t")).join(gone, ["_id", "_t"], "left_anti")
    again = left.join(twice, ["_id", "_t"], "left_semi").dropDuplicates(["_id", "_t"])
    return left.join(twice, ["_id", "_t"], "left_anti").unionByName(again).select("row.*")
