"""Suffix-array dedup: two-stage suffix sorting and adjacent common prefixes, over a whole corpus.

Texts are UTF-8 bytes. A byte goes if a string of `length` bytes that covers it also starts
anywhere else, in the same document or another; matches never cross documents, overlaps count,
and strings are judged on the input.

Equal strings must meet in one task, without a row for each suffix of the corpus. Every string of
200 bytes has an anchor: the 64-byte piece in it with the smallest hash, leftmost if tied, so equal
strings have equal anchors at equal places. A context is the run of strings that share one anchor
occurrence. Round one asks, for each anchor, whether it occurs elsewhere and whether the whole
context does. Whole contexts that recur are settled; contexts whose anchor recurs with other
surroundings are sent, one copy of each, to the task of their anchor, which sorts their suffixes
by two-stage sorting, finds neighbours that share the full length, and answers with the strings
that recur. Anchors of 64-bit hashes only choose what meets; whole contexts stand for their bytes
by 64 more bits of hash.

An anchor with over `crowd` different contexts, as at the edges of a passage that very many documents
share, isn't sent to one task. Its strings are dealt over all buckets by 64-bit hashes of their bytes,
each batch's distinct ones packed with their counts, and those that occur twice or more recur. So no
group grows with the number of documents that share a passage.

Two-stage sorting: suffixes smaller than their successors are sorted directly by their first
`length` bytes; the others are induced by one scan over the buckets of first bytes.

Null and empty texts have no bytes. Rows of equal doc_id and repeated rows are documents of their
own, so exact repeats of 200 bytes or more go in every copy. A very long text is one batch. An empty table gives an empty
one. Extra columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import exchange as ex
from .text import INVERSE, MULTIPLIER, mix, powers, trim, utf8

LENGTH, ANCHOR = 200, 64
COPIED, BLOCK = 32_000_000, 1_000_000  # bytes that one direct sort copies, suffixes compared at a time
DIGEST = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"
DIGEST_TYPE = pa.schema([
    ("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string())])
SPANS = "doc_id long, n_bytes long, spans array<struct<start:long,end:long>>"
SPANS_TYPE = pa.schema([
    ("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("spans", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))])
SENT = "_b int, _k int, anchor long, first int, before int, strings int, again boolean, bytes binary, vals binary"
SENT_TYPE = pa.schema([
    ("_b", pa.int32()), ("_k", pa.int32()), ("anchor", pa.int64()), ("first", pa.int32()), ("before", pa.int32()),
    ("strings", pa.int32()), ("again", pa.bool_()), ("bytes", pa.binary()), ("vals", pa.binary())])
#: Answers of round one.
ALONE, SETTLED, SETTLED_SEND, SEND, CROWD, SETTLED_CROWD = 0, 1, 2, 3, 4, 5
MANY = 4096  # contexts of one anchor that one task sorts at most


# Two-stage suffix sorting -----------------------------------------------------------------

def smaller_than_next(text: np.ndarray) -> np.ndarray:
    """Whether each suffix is smaller than the one after it; the last one isn't."""
    n = len(text)
    change = np.flatnonzero(text[1:] != text[:-1])
    rises = text[change + 1] > text[change]
    out = np.zeros(n, bool)
    if len(change):
        out[: change[-1] + 1] = np.repeat(rises, np.diff(np.append(-1, change)))
    return out


def sort_directly(padded: np.ndarray, at: np.ndarray, start: int, depth: int) -> None:
    """Orders `at` in place by the bytes from `start` to `depth` of the suffixes there.

    Bytes of at most COPIED together are copied out and sorted; more are first dealt by 8 bytes, so
    that memory follows the number of suffixes and not their length.
    """
    width = depth - start
    if width <= 0 or len(at) < 2:
        return
    if width <= 8 or len(at) * width <= COPIED:
        keys = np.ascontiguousarray(np.lib.stride_tricks.sliding_window_view(padded, width)[at + start]).view(f"S{width}").ravel()
        at[:] = at[np.argsort(keys, kind="stable")]
        return
    key = np.ascontiguousarray(np.lib.stride_tricks.sliding_window_view(padded, 8)[at + start]).view(">u8").ravel().astype(np.uint64)
    by = np.argsort(key, kind="stable")
    at[:], key = at[by], key[by]
    cuts = np.concatenate([[0], np.flatnonzero(key[1:] != key[:-1]) + 1, [len(at)]])
    del key, by
    for i, j in ex.slices(cuts, COPIED // width):
        sort_directly(padded, at[cuts[i] : cuts[j]], start + 8 if j == i + 1 else start, depth)


def two_stage_sort(text: np.ndarray, depth: int = LENGTH) -> np.ndarray:
    """All suffixes of the bytes in `text`, ordered by their first `depth` bytes."""
    n = len(text)
    if not n:
        return np.zeros(0, np.int64)
    small = smaller_than_next(text)
    padded = np.concatenate([text, np.zeros(depth, np.uint8)])
    direct = np.flatnonzero(small)
    sort_directly(padded, direct, 0, depth)
    total = np.bincount(text, minlength=256)
    heads = np.cumsum(total) - total
    out = np.full(n, -1, np.int64)
    by_char = np.bincount(text[direct], minlength=256)
    tails = heads + total - by_char
    at = 0
    for c in np.flatnonzero(by_char):
        out[tails[c] : tails[c] + by_char[c]] = direct[at : at + by_char[c]]
        at += by_char[c]
    free = heads.copy()

    def induce(suffixes: np.ndarray) -> None:
        before = suffixes[suffixes > 0] - 1
        before = before[~small[before]]
        if not len(before):
            return
        chars = text[before]
        order = np.argsort(chars, kind="stable")
        before, count = before[order], np.bincount(chars, minlength=256)
        start = np.cumsum(count) - count
        for c in np.flatnonzero(count):
            out[free[c] : free[c] + count[c]] = before[start[c] : start[c] + count[c]]
            free[c] += count[c]

    last = int(text[-1])  # smaller than every other suffix with its first byte
    out[free[last]] = n - 1
    free[last] += 1
    for c in np.flatnonzero(total):
        done = heads[c]
        while done < free[c]:  # suffixes that begin with a run of c come from those just placed
            until = free[c]
            induce(out[done:until])
            done = until
        induce(out[tails[c] : tails[c] + by_char[c]])
    return out


def adjacent_prefixes(text: np.ndarray, order: np.ndarray, most: int = LENGTH) -> np.ndarray:
    """Common prefix length of each suffix in `order` and the one before it, up to `most`; 0 for the first."""
    view = np.lib.stride_tricks.sliding_window_view(np.concatenate([text, np.zeros(most + 8, np.uint8)]), 8)
    out, live = np.zeros(len(order), np.int64), np.arange(1, len(order))
    if len(order) > BLOCK + 1:  # in blocks that begin with the last suffix of the one before
        for a in range(0, len(order) - 1, BLOCK):
            out[a + 1 : a + BLOCK + 1] = adjacent_prefixes(text, order[a : a + BLOCK + 1], most)[1:]
        return out
    for depth in range(0, most, 8):
        one = np.ascontiguousarray(view[order[live] + depth]).view("<u8").ravel()
        two = np.ascontiguousarray(view[order[live - 1] + depth]).view("<u8").ravel()
        apart = one ^ two
        ends = apart != 0
        lowest = apart[ends] & (~apart[ends] + np.uint64(1))
        out[live] = depth + 8
        out[live[ends]] = depth + (np.log2(lowest.astype(float)) / 8).astype(np.int64)
        live = live[~ends]
        if not len(live):
            break
    room = len(text) - np.maximum(order[1:], order[:-1])
    out[1:] = np.minimum(out[1:], np.minimum(room, most))
    return out


# Anchors ----------------------------------------------------------------------------------

def sliding_argmin(x: np.ndarray, width: int) -> np.ndarray:
    """Place of the leftmost minimum of every `width` consecutive values."""
    n = len(x) - width + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    best, at, size = x.copy(), np.arange(len(x)), 1
    while size * 2 <= width:  # minima of windows of powers of two
        right = best[size:] < best[: len(best) - size]
        best, at = np.where(right, best[size:], best[: len(best) - size]), np.where(right, at[size:], at[: len(at) - size])
        size *= 2
    gap = width - size
    right = best[gap : gap + n] < best[:n]
    return np.where(right, at[gap : gap + n], at[:n])


class Contexts:
    """Anchors of a batch: places `anchor`, the first and the number of strings of each, hashes."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, length: int):
        parts = []
        for i, j in ex.slices(offsets, 250_000):
            base, end = offsets[i], offsets[j]
            part = data[base:end]
            if len(part) < length:
                continue
            prefix = np.zeros(len(part) + 1, np.uint64)
            np.cumsum((part.astype(np.uint64) + np.uint64(1)) * powers(MULTIPLIER, len(part)), out=prefix[1:])
            back = powers(INVERSE, len(part))
            gram = mix((prefix[ANCHOR:] - prefix[:-ANCHOR]) * back[: len(part) - ANCHOR + 1])
            place = sliding_argmin(gram, length - ANCHOR + 1)
            starts = np.arange(len(place))
            of = np.searchsorted(offsets[i : j + 1] - base, starts, "right") - 1
            inside = starts + length <= (offsets[i + 1 : j + 1] - base)[of]
            starts, place = starts[inside], place[inside]
            if not len(starts):
                continue
            new = np.ones(len(starts), bool)
            new[1:] = (place[1:] != place[:-1]) | (starts[1:] != starts[:-1] + 1)
            head = np.flatnonzero(new)
            count = np.diff(np.append(head, len(starts)))
            first, anchor = starts[head], place[head]
            span = (prefix[first + count + length - 1] - prefix[first]) * back[first]
            whole = mix(span ^ mix((count.astype(np.uint64) << np.uint64(32)) + (anchor - first).astype(np.uint64)))
            # Anchors are small hashes by choice: mixed again, they spread over the buckets.
            parts.append((anchor + base, first + base, count, mix(gram[anchor]), whole))
        zero = np.zeros(0, np.int64)
        self.anchor, self.first, self.count, self.gram, self.whole = (
            [np.concatenate(x) for x in zip(*parts)] if parts else [zero, zero, zero, zero.astype(np.uint64), zero.astype(np.uint64)])
        #: One key for each distinct (anchor hash, context hash): keys in order of the anchor hash.
        order = np.lexsort((self.whole, self.gram))
        gram, whole = self.gram[order], self.whole[order]
        new = np.ones(len(order), bool)
        new[1:] = (gram[1:] != gram[:-1]) | (whole[1:] != whole[:-1])
        self.of = np.empty(len(order), np.int64)
        self.of[order] = np.cumsum(new) - 1
        self.example = order[new]
        self.keys, self.wholes = gram[new], whole[new]
        self.times = np.bincount(self.of, minlength=len(self.keys))


def _judge(table: pa.Table, crowd: int) -> pa.Table:
    """Round one. Of each (anchor, context) of each batch: does the anchor, does the context recur?"""
    asked = ex.Asked(table, np.dtype([("whole", "<u8"), ("many", "u1")]))
    whole, many = asked.values["whole"], asked.values["many"].astype(np.int64)
    n = len(whole)
    order = np.lexsort((np.arange(n), whole, asked.keys))
    key, context = asked.keys[order], whole[order]
    new_key, new_context = np.ones(n, bool), np.ones(n, bool)
    new_key[1:] = key[1:] != key[:-1]
    new_context[1:] = new_key[1:] | (context[1:] != context[:-1])
    key_head, context_head = np.flatnonzero(new_key), np.flatnonzero(new_context)
    of_key, of_context = np.cumsum(new_key) - 1, np.cumsum(new_context) - 1
    kinds = np.add.reduceat(new_context.astype(np.int64), key_head)[of_key]
    times = np.add.reduceat(many[order] + 1, context_head)[of_context]
    reply = np.full(n, ALONE, np.uint8)
    reply[(times >= 2)] = SETTLED
    reply[(times >= 2) & (kinds >= 2) & new_context] = SETTLED_SEND
    reply[(times == 1) & (kinds >= 2)] = SEND
    reply[kinds > crowd] = np.where(times >= 2, SETTLED_CROWD, CROWD)[kinds > crowd]
    out = np.empty(n, np.uint8)
    out[order] = reply
    return asked.answer(out)


def _compare(table: pa.Table, length: int, block: int = 300_000) -> pa.Table:
    """Round two. Suffix-sorts the contexts of each anchor; which strings of batch contexts recur?"""
    order = np.argsort(table["anchor"].to_numpy(), kind="stable")
    table = table.take(pa.array(order))
    anchor, sizes = table["anchor"].to_numpy(), np.array([len(x.as_py()) + 1 for x in table["bytes"]])
    heads = np.flatnonzero(np.append(True, anchor[1:] != anchor[:-1]))
    cuts, rows, i = np.append(heads, len(anchor)), [], 0
    total = np.append(0, np.cumsum(sizes))
    while i < len(heads):  # anchors are never cut, blocks of small ones share one sort
        j = i + 1
        while j < len(heads) and total[cuts[j + 1]] - total[cuts[i]] <= block:
            j += 1
        part = table.slice(cuts[i], cuts[j] - cuts[i])
        rows.append(_compare_block(part, length))
        i = j
    return pa.concat_tables(rows)


def _compare_block(table: pa.Table, length: int) -> pa.Table:
    parts = [x.as_py() for x in table["bytes"]]
    text = np.frombuffer(b"\xff".join(parts) + b"\xff", np.uint8)  # 0xFF is in no UTF-8
    size = np.array([len(x) + 1 for x in parts])
    base = np.cumsum(size) - size
    strings = table["strings"].to_numpy()
    of = np.repeat(np.arange(len(parts)), strings)
    starts = np.repeat(base, strings) + np.arange(len(of)) - np.repeat(np.cumsum(strings) - strings, strings)
    owner = np.full(len(text), -1, np.int64)
    owner[starts] = of
    order = two_stage_sort(text, length)
    order = order[owner[order] >= 0]
    equal = adjacent_prefixes(text, order, length) >= length
    group = np.cumsum(~equal) - 1
    weight = np.where(table["again"].to_numpy(zero_copy_only=False), 2, 1)[owner[order]]
    recurs = np.bincount(group, weight)[group] >= 2
    hit, who = order[recurs], owner[order[recurs]]
    open_ = ~table["again"].to_numpy(zero_copy_only=False)[who]
    hit, who = hit[open_], who[open_]
    where = table["first"].to_numpy()[who] + hit - base[who]
    batch = table["_b"].to_numpy()[who]
    by = np.argsort(batch, kind="stable")
    numbers, head = np.unique(batch[by], return_index=True)
    found = [np.sort(x).astype("<i4").tobytes() for x in np.split(where[by], head[1:])] if len(numbers) else []
    return pa.table([pa.array(numbers.astype(np.int32)), pa.array(np.full(len(numbers), -1, np.int32)), pa.array(found, pa.binary())], schema=ex.ANSWER_TYPE)


def _crowded(data: np.ndarray, contexts: Contexts, code: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Where each string of a batch's contexts with crowded anchors begins, one occurrence of each context, and its hash."""
    at = contexts.example[np.flatnonzero((code == CROWD) | (code == SETTLED_CROWD))]
    count = contexts.count[at]
    if not len(at):
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    size = count + length - 1
    inner = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
    part = data[np.repeat(contexts.first[at], size) + inner]
    prefix = np.zeros(len(part) + 1, np.uint64)
    np.cumsum((part.astype(np.uint64) + np.uint64(1)) * powers(MULTIPLIER, len(part)), out=prefix[1:])
    step = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
    here = np.repeat(np.cumsum(size) - size, count) + step
    return np.repeat(contexts.first[at], count) + step, mix((prefix[here + length] - prefix[here]) * powers(INVERSE, len(part) + 1)[here])


def _recurring(table: pa.Table) -> pa.Table:
    """Of the strings that batches sent by hash: does each occur twice or more?"""
    asked = ex.Asked(pa.table([table["_b"], table["_k"], table["first"], table["bytes"], table["vals"]], schema=ex.ASK_TYPE), np.uint8)
    order, heads, group = asked.grouped()
    return asked.answer((np.add.reduceat(asked.values[order].astype(np.int64), heads) >= 2)[group], bits=True)


def _removed(table: pa.Table, replies: pa.Table, buckets: int, length: int):
    """Of a batch in order: its bytes, where documents begin, which bytes go."""
    data, offsets = utf8(table["text"])
    contexts = Contexts(data, offsets, length)
    cover = np.zeros(len(data) + 1, np.int32)
    kind = replies["_k"].to_numpy()
    codes = ex.heard(replies.filter(pa.array((kind >= 0) & (kind < buckets))), contexts.keys, buckets)
    code = codes[contexts.of]
    done = (code == SETTLED) | (code == SETTLED_SEND) | (code == SETTLED_CROWD)
    np.add.at(cover, contexts.first[done], 1)
    np.subtract.at(cover, (contexts.first + contexts.count + length - 1)[done], 1)
    for found in replies.filter(pa.array(kind < 0))["reply"]:
        at = np.frombuffer(found.as_py(), "<i4")
        np.add.at(cover, at, 1)
        np.subtract.at(cover, at + length, 1)
    starts, hashes = _crowded(data, contexts, codes, length)
    if len(starts):
        keys, of = np.unique(hashes, return_inverse=True)
        crowd = replies.filter(pa.array(kind >= buckets))
        crowd = crowd.set_column(1, "_k", pa.array(crowd["_k"].to_numpy() - np.int32(buckets)))
        at = starts[ex.heard(crowd, keys, buckets, bits=True)[of]]
        np.add.at(cover, at, 1)
        np.subtract.at(cover, at + length, 1)
    return data, offsets, np.cumsum(cover)[:-1] > 0


def _plan(docs: DataFrame, length: int, batch_mb: float, more: dict[str, Column], crowd: int = MANY):
    """The batches, the replies to them, and how many buckets they asked."""
    if length < 2 * ANCHOR:
        raise ValueError(f"strings of at least {2 * ANCHOR} bytes")
    batches = ex.Batches(docs, batch_mb, **more)
    buckets = batches.buckets(1 / 50, 400_000)

    def send(table: pa.Table) -> pa.Table:
        c = Contexts(*utf8(ex.ordered(table)["text"]), length)
        values = np.zeros(len(c.keys), [("whole", "<u8"), ("many", "u1")])
        values["whole"], values["many"] = c.wholes, c.times > 1
        return ex.questions(table["_b"][0].as_py(), c.keys, buckets, values)

    def ship(table: pa.Table, replies: pa.Table) -> pa.Table:
        table = ex.ordered(table)
        data, offsets = utf8(table["text"])
        c = Contexts(data, offsets, length)
        code = ex.heard(replies, c.keys, buckets)
        keys = np.flatnonzero((code == SETTLED_SEND) | (code == SEND))
        at, raw = c.example[keys], data.tobytes()
        first, count = c.first[at], c.count[at]
        n = len(keys)
        shift = np.uint64(65 - buckets.bit_length())
        bucket = (c.keys[keys] >> shift).astype(np.int32) if buckets > 1 else np.zeros(n, np.int32)
        b = table["_b"][0].as_py()
        some, times = np.unique(_crowded(data, c, code, length)[1], return_counts=True)
        hashed = ex.questions(b, some, buckets, np.minimum(times, 2).astype(np.uint8))
        none = lambda t: pa.nulls(len(hashed), t)
        return pa.concat_tables([pa.table([
            hashed["_b"], pa.array(hashed["_k"].to_numpy() + np.int32(buckets)), none(pa.int64()), hashed["n"], none(pa.int32()), none(pa.int32()),
            none(pa.bool_()), hashed["keys"], hashed["vals"]], schema=SENT_TYPE), pa.table([
            pa.array(np.full(n, b, np.int32)), pa.array(bucket), pa.array(c.keys[keys].view(np.int64)),
            pa.array(first.astype(np.int32)), pa.array((c.anchor[at] - first).astype(np.int32)), pa.array(count.astype(np.int32)),
            pa.array(code[keys] == SETTLED_SEND), pa.array([raw[a : a + k + length - 1] for a, k in zip(first.tolist(), count.tolist())], pa.binary()),
            pa.nulls(n, pa.binary())], schema=SENT_TYPE)])

    judged = ex.answers(batches.each(send, ex.ASK), lambda t: _judge(t, crowd))
    sent = ex.finish(batches, judged, ship, SENT)
    def compare(table: pa.Table) -> pa.Table:
        out = _recurring(table) if table["_k"][0].as_py() >= buckets else _compare(table, length)
        trim()
        return out

    compared = sent.groupBy("_k").applyInArrow(compare, ex.ANSWER)
    return batches, judged.unionByName(compared), buckets


def _run(docs: DataFrame, length: int, batch_mb: float, row, schema: str, kind: pa.Schema, crowd: int = MANY) -> DataFrame:
    batches, replies, buckets = _plan(docs, length, batch_mb, {}, crowd)

    def work(table: pa.Table, replies: pa.Table) -> pa.Table:
        table = ex.ordered(table)
        data, offsets, gone = _removed(table, replies, buckets, length)
        rows = [(doc_id, int(offsets[i + 1] - offsets[i]), *row(data[offsets[i] : offsets[i + 1]], gone[offsets[i] : offsets[i + 1]]))
                for i, doc_id in enumerate(table["doc_id"].to_pylist())]
        return pa.table([pa.array(c, t) for c, t in zip(zip(*rows) if rows else [()] * len(kind), kind.types)], schema=kind)

    return ex.finish(batches, replies, work, schema)


def _edges(gone: np.ndarray) -> np.ndarray:
    return np.flatnonzero(np.diff(np.concatenate([[0], gone.view(np.int8), [0]])))


def dedup_bytes(docs: DataFrame, length: int = LENGTH, batch_mb: float = 4) -> DataFrame:
    """doc_id, n_bytes and the spans of bytes that go, as (start, end)."""

    def row(data: np.ndarray, gone: np.ndarray):
        edge = _edges(gone)
        return ([{"start": int(s), "end": int(e)} for s, e in zip(edge[::2], edge[1::2])],)

    return _run(docs, length, batch_mb, row, SPANS, SPANS_TYPE)


def dedup_texts(docs: DataFrame, length: int = LENGTH, batch_mb: float = 4) -> DataFrame:
    """The rows and columns of docs with what is left as text; of a character cut by a span, every byte stays.

    Texts of which nothing is left become empty; null texts stay null.
    """
    names = [c for c in docs.columns if c not in ("doc_id", "text")]
    batches, replies, buckets = _plan(docs, length, batch_mb, {f"c{i}": F.col(f"`{c}`") for i, c in enumerate(names)})
    kind = batches.rows.schema

    def left(data: np.ndarray, gone: np.ndarray) -> str:
        head = np.flatnonzero((data & 0xC0) != 0x80)  # a character goes only if all of its bytes go
        if len(head):
            gone = np.repeat(np.logical_and.reduceat(gone, head), np.diff(np.append(head, len(data))))
        return data[~gone].tobytes().decode()

    def work(table: pa.Table, replies: pa.Table) -> pa.Table:
        table = ex.ordered(table)
        data, offsets, gone = _removed(table, replies, buckets, length)
        null = table["text"].is_null().to_pylist()
        texts = [None if n else left(data[a:b], gone[a:b]) for n, a, b in zip(null, offsets[:-1], offsets[1:])]
        table = table.drop_columns("_b")
        return table.set_column(table.schema.get_field_index("text"), "text", pa.array(texts, pa.string()))

    out = ex.finish(batches, replies, work, kind)
    return out.select(*[F.col(f"c{names.index(c)}" if c in names else c).alias(c) for c in docs.columns])


def dedup_byte_digests(docs: DataFrame, length: int = LENGTH, batch_mb: float = 4, crowd: int = MANY) -> DataFrame:
    """The same as digests: doc_id, n_bytes, n_removed, n_spans, kept_sha256."""

    def row(data: np.ndarray, gone: np.ndarray):
        return int(gone.sum()), len(_edges(gone)) // 2, hashlib.sha256(data[~gone].tobytes()).hexdigest()

    return _run(docs, length, batch_mb, row, DIGEST, DIGEST_TYPE, crowd)
