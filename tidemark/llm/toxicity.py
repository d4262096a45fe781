"""Toxicity by the nearest labelled examples: exact TF-IDF cosine over block-max inverted indexes.

Words are runs of ASCII letters, digits, `_` and non-ASCII characters of the lower-cased text. Terms
are the words and, told apart from them, their first 4, 5 and 6 bytes, so families of words count as
well. Every term of the sampled examples is in the vocabulary, but for those in more than `common` of
the examples of either label, and every sampled example, of either label, is in the index. An example or a text weighs a term
(1 + ln tf) * idf * telling and is scaled to length 1; `telling` lies between `least` and 1 and grows
with the likelihood ratio of the term's counts under the two labels, so that what tells the labels
apart outweighs a text's topic, and texts without it are still compared by all that they share.

The index is a posting list for each term, by blocks of BLOCK examples with the largest weight of the
term in the block. The sum of these bounds every cosine in a block; the AHEAD blocks of highest bounds
are opened first, then all that can still reach the k-th best cosine, so the k nearest are exact. Equal
cosines go by doc_id, then by text. Their votes, weighted by cosine, go through a rising curve fitted
on leave-one-out votes and the labels' true shares; the neighbours are the evidence.

The model reads at most `examples` labelled texts of each label, those of the smallest hashes of
(doc_id, text), whatever repeats; this is the documented bound of the training sample. Labels of one
doc_id that disagree count as toxic; null labels and null doc_ids don't count. A text that shares no
term with any example gets the share that such texts have in training, or the label's share; null and
empty texts are such. Repeated rows have one score. Texts of any length are scored whole. Without
labelled texts, or with those of one label alone, every score is that label's share (0 if there are
none). Extra columns are ignored.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .exchange import slices
from .text import mix, trim, utf8, word_hashes, word_spans

EXAMPLES, NEAREST, BLOCK, AHEAD = 1500, 15, 64, 4
COMMON, LEAST, HALF = 0.05, 0.02, 18.0
PREFIXES = (4, 5, 6)
SLICE = 2_000_000  # bytes of text that a task works on at a time
VERDICT = "score double, evidence array<long>, similarity array<double>"
#: Bytes of words: ASCII letters, digits and _, and all of non-ASCII characters.
IN_WORD = np.array([b >= 128 or chr(b).isalnum() or b == 95 for b in range(256)])


def word_terms(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Terms of the distinct words, a row of 1 + len(PREFIXES) hashes each (0: none); each word's row and its text."""
    data, offsets = utf8(pa.compute.utf8_lower(pa.compute.fill_null(column, "")))
    start, end, of = word_spans(IN_WORD[data], offsets)
    hashes = word_hashes(data, start, end)
    _, first, row = np.unique(hashes, return_index=True, return_inverse=True)
    order = np.argsort(first)  # in the order of the text, as word_hashes takes them
    first, row = first[order], np.argsort(order)[row]
    start, end = start[first], end[first]
    terms = np.zeros((len(first), 1 + len(PREFIXES)), np.uint64)
    terms[:, 0] = hashes[first]
    for k, n in enumerate(PREFIXES):
        long = end - start >= n
        terms[long, k + 1] = mix(word_hashes(data, start[long], start[long] + n) + np.uint64(n))
    return terms, row, of


def counts(column: pa.Array | pa.ChunkedArray, vocabulary: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Text number, number of the term in the sorted vocabulary, and its occurrences, by text and term."""
    terms, row, of = word_terms(column)
    place = np.searchsorted(vocabulary, terms)
    met = (terms > 0) & (vocabulary[np.minimum(place, len(vocabulary) - 1)] == terms) if len(vocabulary) else np.zeros(terms.shape, bool)
    pairs = [of[m] * len(vocabulary) + place[row[m], k] for k in range(terms.shape[1]) if len(m := np.flatnonzero(met[row, k]))]
    at, n = np.unique(np.concatenate(pairs), return_counts=True) if pairs else (np.zeros(0, np.int64), np.zeros(0, np.int64))
    return *np.divmod(at, max(len(vocabulary), 1)), n


def pieces(column: pa.Array) -> Iterator[tuple[int, pa.Array]]:
    """Slices with about SLICE bytes of text and their first text's number."""
    size = np.asarray(pa.compute.fill_null(pa.compute.binary_length(column), 0)).astype(np.int64)
    for i, j in slices(np.append(0, np.cumsum(size)), SLICE):
        yield i, column.slice(i, j - i)


def likelihood_ratio(a: np.ndarray, b: np.ndarray, n_a: int, n_b: int) -> np.ndarray:
    """Twice the log likelihood ratio of a term's document counts under two labels against one rate."""
    def part(k, n, p):
        p = np.clip(p, 1e-12, 1 - 1e-12)
        return k * np.log(p) + (n - k) * np.log(1 - p)

    pooled = (a + b) / (n_a + n_b)
    return 2 * (part(a, n_a, a / n_a) + part(b, n_b, b / n_b) - part(a, n_a, pooled) - part(b, n_b, pooled))


def ranges(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """start[0], start[0] + 1, .., start[1], ..: size[i] numbers from each."""
    ends = np.cumsum(size)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(start - (ends - size), size)


class BlockMaxIndex:
    """Posting lists of sparse unit vectors, by term and block of BLOCK vectors, with each block's largest weight."""

    def __init__(self, vector: np.ndarray, term: np.ndarray, weight: np.ndarray, ids: np.ndarray, terms: int):
        """vector, term, weight: the entries, by vector and term; ids: one for each vector, by which equal scores go."""
        self.ids, n = ids, len(ids)
        heaviest = np.full(n, -1)
        order = np.lexsort((-term, weight, vector))
        heaviest[vector[order]] = term[order]  # the last one of each vector stays
        kind = np.lexsort((np.arange(n), heaviest))  # vectors of one heaviest term lie together, so that blocks differ
        place = np.empty(n, np.int64)
        place[kind] = np.arange(n)
        self.vector, self.terms = kind, terms
        self.blocks = -(-max(n, 1) // BLOCK)
        at = place[vector]
        order = np.lexsort((at, term))
        self.at, self.weight = at[order].astype(np.int32), weight[order]
        self.postings = np.bincount(term, minlength=terms).astype(np.int32)
        self.derive()

    def derive(self) -> None:
        """Where the postings of each term and block begin, how many they are, and the largest weight in them."""
        group = np.repeat(np.arange(self.terms), self.postings) * self.blocks + self.at // BLOCK
        self.start = np.flatnonzero(np.diff(group, prepend=-1)).astype(np.int32)
        self.size = np.diff(np.append(self.start, len(group))).astype(np.int32)
        self.block = (group[self.start] % self.blocks).astype(np.int32)
        self.most = np.maximum.reduceat(self.weight, self.start) if len(self.start) else np.zeros(0)
        self.first = np.searchsorted(group[self.start] // self.blocks, np.arange(self.terms + 1))

    def __getstate__(self) -> dict:
        return {k: v for k, v in vars(self).items() if k not in ("start", "size", "block", "most", "first")}

    def __setstate__(self, state: dict) -> None:
        vars(self).update(state)
        self.derive()

    def nearest(self, term: np.ndarray, weight: np.ndarray, k: int, without: int = -1) -> tuple[np.ndarray, np.ndarray]:
        """Vectors and cosines of the k nearest with a cosine above 0, largest first, equal ones by id."""
        length = self.first[term + 1] - self.first[term]
        entry = ranges(self.first[term], length)
        own, block = np.repeat(weight, length), self.block[entry]
        bound = np.bincount(block, own * self.most[entry], self.blocks) * (1 + 1e-9)
        ahead = np.zeros(self.blocks, bool)
        ahead[np.argsort(-bound, kind="stable")[:AHEAD]] = True
        found, scores, kth = np.zeros(0, np.int64), np.zeros(0), 0.0
        for opened in (lambda: ahead & (bound > 0), lambda: ~ahead & (bound > 0) & (bound >= kth)):
            pick = np.flatnonzero(opened()[block])
            if not len(pick):
                continue
            some = entry[pick]
            size = self.size[some]
            post = ranges(self.start[some], size)
            score = np.bincount(self.at[post], np.repeat(own[pick], size) * self.weight[post], len(self.vector))
            hit = np.flatnonzero(score > max(kth - 1e-12, 0))
            vector = self.vector[hit]
            found, scores = np.append(found, vector[vector != without]), np.append(scores, score[hit[vector != without]])
            best = np.lexsort((found, self.ids[found], -scores))[:k]
            found, scores = found[best], scores[best]
            kth = scores[-1] if len(scores) == k else 0.0
        return found, scores


class Model:
    """What the examples teach; its size is bounded by their number and their texts."""

    def __init__(self, texts: list[str], toxic: np.ndarray, ids: np.ndarray, share: float, nearest: int = NEAREST,
                 common: float = COMMON, least: float = LEAST, half: float = HALF):
        """share: of the toxic label among all labelled rows that may be learned from."""
        self.nearest, self.share, self.base, self.terms = nearest, share, share, np.zeros(0, np.uint64)
        self.toxic, self.ids = toxic, ids
        n = np.array([(toxic == 0).sum(), (toxic == 1).sum()])
        if not n.all():
            return
        column = pa.array(texts, pa.string())
        known = np.zeros(0, np.uint64)
        for _, part in pieces(column):
            known = np.union1d(known, word_terms(part)[0])
        known = known[known > 0]
        found = [(c[0] + i, *c[1:]) for i, part in pieces(column) for c in [counts(part, known)]]
        text, term, tf = (np.concatenate(x) for x in zip(*found))
        a, b = (np.bincount(term[toxic[text] == y], minlength=len(known)).astype(float) for y in (1, 0))
        keep = (a <= common * n[1]) | (b <= common * n[0])
        gain = likelihood_ratio(a, b, n[1], n[0])
        telling = least + (1 - least) * gain**2 / (gain**2 + half**2)
        number = np.cumsum(keep) - 1
        text, term, tf = text[keep[term]], number[term[keep[term]]], tf[keep[term]]
        self.terms, self.idf = known[keep], (np.log((1 + n.sum()) / (1 + a + b)) * telling)[keep]
        weight = self.weigh(text, term, tf, len(texts))
        self.index = BlockMaxIndex(text, term, weight, ids, len(self.terms))
        class_weight = np.where(toxic == 1, share / n[1], (1 - share) / n[0])
        bounds = np.searchsorted(text, np.arange(len(texts) + 1))
        found = [self.index.nearest(term[p:q], weight[p:q], nearest, i) for i, (p, q) in enumerate(zip(bounds[:-1], bounds[1:]))]
        alone = np.array([not len(s) for _, s in found])
        self.base = float((class_weight[alone] @ (toxic[alone] == 1) + 1e-3 * share) / (class_weight[alone].sum() + 1e-3))
        votes = np.array([self.vote(*f) for f in found])
        self.fit(votes[~alone], toxic[~alone] == 1, class_weight[~alone])

    def weigh(self, text: np.ndarray, term: np.ndarray, tf: np.ndarray, n: int) -> np.ndarray:
        weight = (1 + np.log(tf)) * self.idf[term]
        return weight / np.sqrt(np.bincount(text, weight * weight, n))[text]

    def fit(self, votes: np.ndarray, hit: np.ndarray, weight: np.ndarray) -> None:
        """A rising step curve from votes to shares, by pooling neighbours that fall; steps lean a little to the middle."""
        at, of = np.unique(votes, return_inverse=True)
        weight = weight / max(weight.sum(), 1e-12) * len(weight)
        total, good = np.bincount(of, weight, len(at)), np.bincount(of, weight * hit, len(at))
        pools: list[list[float]] = []  # last vote, weight, weight of hits
        for x, w, g in zip(at, total, good):
            pools.append([x, w, g])
            while len(pools) > 1 and pools[-2][2] * pools[-1][1] >= pools[-1][2] * pools[-2][1]:
                x, w, g = pools.pop()
                pools[-1] = [x, pools[-1][1] + w, pools[-1][2] + g]
        self.steps = np.array([x for x, _, _ in pools[:-1]])
        self.shares = np.array([(g + 0.25) / (w + 0.5) for _, w, g in pools]) if pools else np.array([self.share])

    def vote(self, vectors: np.ndarray, scores: np.ndarray) -> float:
        return float(scores @ np.where(self.toxic[vectors] == 1, 1.0, -1.0) / scores.sum()) if len(scores) else 0.0

    def score(self, column: pa.Array) -> tuple[list[float], list[list[int]], list[list[float]]]:
        """Of each text the probability of the toxic label, doc_ids of the nearest examples, their cosines."""
        n = len(column)
        out: tuple[list, list, list] = ([self.base] * n, [[] for _ in range(n)], [[] for _ in range(n)])
        if not len(self.terms):
            return out
        text, term, tf = counts(column, self.terms)
        weight = self.weigh(text, term, tf, n)
        bounds = np.searchsorted(text, np.arange(n + 1))
        for i, (p, q) in enumerate(zip(bounds[:-1], bounds[1:])):
            if q > p:
                vectors, scores = self.index.nearest(term[p:q], weight[p:q], self.nearest)
                if len(scores):
                    out[0][i] = float(self.shares[np.searchsorted(self.steps, self.vote(vectors, scores))])
                    out[1][i], out[2][i] = self.ids[vectors].tolist(), scores.tolist()
        return out


def learn(docs: DataFrame, labels: DataFrame, learnable: Column, examples: int = EXAMPLES, nearest: int = NEAREST) -> Model:
    """A model from labels (doc_id, toxic) of the rows for which `learnable`, of doc_id, holds."""
    known = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull()).where(learnable).groupBy(
        F.col("doc_id").cast("long").alias("doc_id")).agg(F.max((F.col("toxic") > 0).cast("int")).alias("toxic"))
    shares = {r["toxic"]: r["n"] for r in known.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    key = F.xxhash64("doc_id", "text")
    ranked = texts.select("doc_id", key.alias("h")).join(known, "doc_id").distinct()  # no text is shuffled
    few = [ranked.where(F.col("toxic") == y).orderBy("h", "doc_id").limit(examples) for y in (0, 1)]
    chosen = F.broadcast(few[0].unionByName(few[1]))
    rows = texts.withColumn("h", key).join(chosen, ["doc_id", "h"]).dropDuplicates(["doc_id", "h"])  # at most `examples` of each label
    total = sum(shares.values())
    share = shares.get(1, 0) / total if total else 0.0

    def fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = [r for b in batches for r in zip(b["doc_id"].to_pylist(), b["text"].to_pylist(), b["toxic"].to_pylist())]
        found.sort(key=lambda r: (r[0], r[1] or ""))
        model = Model([t or "" for _, t, _ in found], np.array([y for *_, y in found], np.int64), np.array([i for i, *_ in found], np.int64), share, nearest)
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(model, 5)], pa.binary())], ["model"])
        trim()

    made = rows.select("doc_id", "text", "toxic").repartition(1).mapInArrow(fit, "model binary").first()  # one task: the sample is bounded
    return pickle.loads(made["model"]) if made else Model([], np.zeros(0, np.int64), np.zeros(0, np.int64), share, nearest)


def verdict(docs: DataFrame, model: Model, text: str = "text") -> Column:
    """A column of struct(score, evidence, similarity) for a text column."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # bounded by `examples`

    @F.arrow_udf(VERDICT)
    def judge(column: pa.Array) -> pa.Array:
        p, ids, near = [], [], []
        for _, part in pieces(column):
            for out, more in zip((p, ids, near), shared.value.score(part)):
                out.extend(more)
        trim()
        return pa.StructArray.from_arrays([pa.array(p, pa.float64()), pa.array(ids, pa.list_(pa.int64())), pa.array(near, pa.list_(pa.float64()))], ["score", "evidence", "similarity"])

    return judge(F.col(text).cast("string"))
