"""Recall, samples, exact scores and decoding against plain Python; every operator on odd tables."""

import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from tidemark.llm import bpe, fingerprint, imi, language, lm, minhash, packing, suffix, toxicity, windows

WORD = re.compile(r"[^\x20\x09-\x0D]+")
BYTE, WORDS = (public_tokenizers.path(f"{n}.json") for n in ("byte_bpe_50k", "word_bpe_49k"))
CLASH = "doc_id long, text string, lang string, toxic int, _b int, _id long, _t long, row string, rows binary, key long, h long, score double, `group` string, n_chars long"
OPERATORS = {
    "toxicity": lambda d: d.select("doc_id", toxicity.verdict(d, toxicity.learn(d, d.select("doc_id", "toxic"), F.lit(True)))["score"]),
    "bpe": lambda d: bpe.round_trip(d, BYTE, 50),
    "lm": lambda d: lm.lm_scores(d, F.col("doc_id") % 3 == 0, 0.002),
    "windows": lambda d: windows.dedup_window_digests(d, 20, 0.002),
    "language": lambda d: d.select("doc_id", language.verdict(d, language.learn(d, F.lit(True)))["lang_pred"]),
    "packing": lambda d: packing.pack(d, WORDS),
    "minhash": lambda d: minhash.near_duplicates(d),
    "survivors": lambda d: minhash.without_near_duplicates(d),
    "fingerprint": lambda d: fingerprint.fingerprints(d, 0.002),
    "suffix": lambda d: suffix.dedup_byte_digests(d, 200, 0.002),
    "texts": lambda d: suffix.dedup_texts(d, 200, 0.002),
}


def rows_of(texts):
    return [(i, t, "en", i and i % 2, 1, 2, 3, "r", b"x", 4, 5, 0.5, "g", 6) for i, t in texts]


@pytest.mark.parametrize("name", sorted(OPERATORS))
def test_odd_tables(spark, name):
    """Empty tables, null ids and texts, repeated rows, one doc_id with unlike texts, one very long text, columns with the names used inside."""
    run = OPERATORS[name]
    assert run(spark.createDataFrame([], CLASH)).count() == 0
    long = " ".join(f"w{i % 977}" for i in range(60_000))
    texts = [(None, None), (None, "a b c"), (None, "a b c"), (1, ""), (1, " "), (2, long), (3, long + " end"), (4, "one two"), (4, "one two"), (4, "three " * 40), (5, "x" * 100_000)]
    out = run(spark.createDataFrame(rows_of(texts), CLASH).repartition(3)).collect()
    if name in ("packing", "survivors"):
        assert {r["doc_id"] for r in out} >= {None, 1, 4, 5}
    else:
        assert Counter(r["doc_id"] for r in out) == Counter(i for i, _ in texts)
    only_null = run(spark.createDataFrame(rows_of([(None, None)]), CLASH))
    assert only_null.count() == 1


def test_one_survivor_of_each_group(spark):
    a, b = " ".join(f"a{i}" for i in range(100)), " ".join(f"b{i}" for i in range(100))
    rows = [(5, a), (5, a), (5, b), (3, a), (9, b + " more"), (7, ""), (7, ""), (None, a), (8, "alone here")]
    left = minhash.without_near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), threshold=80)
    assert sorted(map(tuple, left.collect()), key=str) == sorted([(3, a), (5, b), (7, ""), (7, ""), (None, a), (8, "alone here")], key=str)
    got = minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), threshold=80).collect()
    assert sorted((r["doc_id"], r["component_id"]) for r in got if r["doc_id"] is not None) == [(3, 3), (5, 3), (5, 3), (5, 5), (7, 7), (7, 7), (8, 8), (9, 5)]


def test_neighbours_at_the_default_share(spark):
    """Recall at least 0.9 against brute force, for vectors with and without structure; clustered ones visit less."""
    rng = np.random.default_rng(5)
    plain = rng.normal(size=(3000, 16))
    centres = rng.normal(size=(40, 16)) * 4
    clustered = centres[rng.integers(0, 40, 3000)] + rng.normal(size=(3000, 16)) * 0.4
    for x in (plain, clustered):
        df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x.astype(np.float32))], "vec_id long, embedding array<float>")
        got = imi.search(df, F.col("vec_id") % 50 == 0).collect()
        u = x.astype(np.float32).astype(float)
        u /= np.linalg.norm(u, axis=1, keepdims=True)
        found = Counter()
        for q in range(0, 3000, 50):
            s = u @ u[q]
            s[q] = -2
            want = set(np.argsort(-s)[:5].tolist())
            found[q] = len(want & {r["vec_id"] for r in got if r["query_id"] == q})
        assert sum(found.values()) / (5 * len(found)) >= 0.9
    y = imi.unit(clustered)
    one, two = imi.k_means(y[:, :8].copy(), 15), imi.k_means(y[:, 8:].copy(), 15)
    cell = imi.nearest_centre(y[:, :8], one) * 15 + imi.nearest_centre(y[:, 8:], two)
    assert imi.needed_share(y, one, two, np.bincount(cell, minlength=225).reshape(15, 15), 5, 0.97) < 0.3


def test_repeated_queries(spark):
    rng = np.random.default_rng(6)
    x = rng.normal(size=(40, 4)).astype(np.float32).tolist()
    rows = [(i, v) for i, v in enumerate(x)] + [(0, x[0]), (0, x[7]), (60, x[9]), (60, x[9])]
    got = imi.search(spark.createDataFrame(rows, "vec_id long, embedding array<float>"), F.col("vec_id").isin(0, 60), share=1.0).collect()
    assert Counter((r["query_id"], r["rank"]) for r in got) == Counter({(0, k): 2 for k in range(1, 6)} | {(60, k): 1 for k in range(1, 6)})
    assert [r["vec_id"] for r in got if (r["query_id"], r["rank"]) == (60, 1)] == [9]


def test_language_sample_is_bounded_and_whole(spark):
    """One doc_id on all rows of a language neither empties nor floods its sample."""
    rows = [(1, f"la maison {i} de ceux", "fr") for i in range(300)] + [(i, f"the house {i} of those", "en") for i in range(300)] + [(i, "das haus", "de") for i in range(3)]
    model = language.learn(spark.createDataFrame(rows, "doc_id long, text string, lang string"), F.lit(True), 50)
    assert model.names == ["de", "en", "fr"]
    asked = spark.createDataFrame([("la maison de ceux",), ("the house of those",)], "text string")
    assert [r[0] for r in asked.select(language.verdict(asked, model)["lang_pred"]).collect()] == ["fr", "en"]
    single = language.learn(spark.createDataFrame(rows[:9], "doc_id long, text string, lang string"), F.lit(True))
    assert {tuple(r) for r in asked.select(language.verdict(asked, single)["lang_pred"]).collect()} == {("fr",)}
    none = language.learn(spark.createDataFrame([], "doc_id long, text string, lang string"), F.lit(True))
    assert {tuple(r) for r in asked.select(language.verdict(asked, none)["lang_pred"]).collect()} == {("und",)}


def test_decoding_is_loss_weighted(spark):
    """The language of the least trust-weighted logistic loss over its codeword's bits, by loops."""
    import pyarrow as pa

    texts = {"en": "the house and the garden of this", "fr": "la maison et le jardin de ces", "de": "das haus und der garten von dem", "es": "la casa y el jardin de los"}
    rows = [(i, f"{t} {i}", n) for i in range(20) for n, t in texts.items()]
    model = language.learn(spark.createDataFrame(rows, "doc_id long, text string, lang string"), F.lit(True))
    asked = [*texts.values(), "el garten of the jardin", "q"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(asked)], "doc_id long, text string")
    got = {r["doc_id"]: r["v"] for r in df.select("doc_id", language.verdict(df, model).alias("v")).collect()}
    for i, t in enumerate(asked):
        (_, _, x), = language.features(pa.array([t]))
        margin = model.margins(x)[0]
        loss = [sum(model.trust[n][b] * math.log1p(math.exp(-margin[b] * model.code[n][b])) for b in range(model.code.shape[1])) for n in range(4)]
        p = [math.exp(min(loss) - v) for v in loss]
        assert got[i]["lang_pred"] == model.names[int(np.argmin(loss))]
        assert abs(got[i]["score"] - max(p) / sum(p)) < 1e-5
        order = sorted(p, reverse=True)
        assert got[i]["ambiguous"] == ((order[0] - order[1]) / sum(p) < language.LEAD)
    code = language.codewords(6)
    assert min((a != b).sum() for i, a in enumerate(code) for b in code[:i]) >= 4


def test_lm_score_by_exact_counts(spark):
    """Scores against the formula over exact quantised counts, and the sum of a context's probabilities."""
    rng = random.Random(4)
    rows = [(i, " ".join(rng.choices([f"w{k}" for k in range(60)], weights=[1 / (k + 1) for k in range(60)], k=rng.randrange(1, 200)))) for i in range(80)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: r for r in lm.lm_scores(df, F.col("doc_id") >= 60, 0.01).collect()}
    words = {i: WORD.findall(t) + [None] for i, t in rows}
    c = Counter(w for i in range(60) for w in words[i])
    two = Counter(p for i in range(60) for p in zip([None] + words[i][:-1], words[i]))
    n, v = sum(c.values()), len(c)
    back = lambda k: float(lm.bigram_count(np.array([int(math.floor(math.log2(k))) + 1]))[0]) if k else 0.0
    raw = Counter()
    for (h, _), k in two.items():
        raw[h] += back(k)
    mass = {h: float(lm.context_mass(lm.context_level(np.array([s])))[0]) for h, s in raw.items()}

    def p(h, w):
        base, s = (c[w] + 1) / (n + v + 1), mass.get(h, 0.0)
        return (back(two[h, w]) + (max(c[h] - s, 0) + 1) * base) / (max(c[h], s) + 1)

    off = []
    for i, ws in words.items():
        want = sum(math.log10(min(1, p(h, w))) for h, w in zip([None] + ws[:-1], ws))
        off.append(abs(got[i]["score"] - want) / len(ws))
    assert min(off) < 1e-12 and np.median(off) < 0.01 and max(off) < 0.05  # but for false positives of the filter
    for h in [None, *(f"w{k}" for k in range(60))]:
        assert sum(p(h, w) for w in c) <= 1 + 1e-9


def test_lm_beats_the_base_on_held_out_text(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    held = F.expr("crc32(cast(doc_id as string)) % 7 = 2")
    r = lm.lm_scores(docs, held).where("held_out").agg(F.sum("score").alias("s"), F.sum("base_score").alias("b"), F.sum("n_tokens").alias("n")).first()
    print("log10 a token:", r["s"] / r["n"], "base:", r["b"] / r["n"])
    assert r["s"] / r["n"] > r["b"] / r["n"] + 0.3


def test_packing_counts_sequences_as_a_loop(spark):
    """Placement of every piece by the stated rule, with limits that bind, and no more than a sequence a group over the lower bound."""
    rng = np.random.default_rng(3)
    for limits, weights, rule in (([100.0, 6.0, 3000.0], [1, 1, 1], "norm"), ([100.0, 100.0, 10000.0], [1, 0.01, 0.01], "norm"), ([100.0, 6.0, 5000.0], [1, 1, 1], "dot")):
        sizes = np.sort(rng.integers(1, 50, 300))[::-1]
        bins, offsets = packing.best_fit(sizes, np.array(limits), np.array(weights, float), rule)
        left: list[list[float]] = []
        for i, t in enumerate(sizes.tolist()):
            need = [t, 1, t * t]
            value = []
            for j, room in enumerate(left):
                if all(r >= x for r, x in zip(room, need)):
                    s = [w / m for w, m in zip(weights, limits)]
                    value.append((sum(((r - x) * k) ** 2 for r, x, k in zip(room, need, s)) if rule == "norm" else -sum(r * x * k * k for r, x, k in zip(room, need, s)), j))
            if value:
                least = min(x for x, _ in value)
                j = next(j for x, j in value if x <= least * (1 + 1e-12) + 1e-15 or x == least)
            else:
                left.append(list(limits))
                j = len(left) - 1
            assert bins[i] == j and offsets[i] == limits[0] - left[j][0], (rule, i)
            left[j] = [r - x for r, x in zip(left[j], need)]
        if limits[1] == 100:
            assert len(left) <= math.ceil(sizes.sum() / 100) + 1
    docs = spark.createDataFrame([(i, "word " * int(k)) for i, k in enumerate(rng.integers(1, 3000, 200))], "doc_id long, text string")
    rows = packing.pack(docs, WORDS).collect()
    assert len({r["sequence_id"] for r in rows}) <= math.ceil(sum(r["length"] for r in rows) / 4096) + 1


def test_fingerprints_by_brute_force(spark):
    """Fingerprints, edited ones and likeness by sums of powers and sets of span hashes."""
    rng = random.Random(9)
    texts = ["".join(rng.choice("abé文 ") for _ in range(rng.choice([0, 3, 24, 25, 200, 900]))) for _ in range(14)] + ["same text " * 30] * 2
    got = {r["doc_id"]: r for r in fingerprint.fingerprints(spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)], "doc_id long, text string, _b int"), 0.002).collect()}

    def spans(t):
        out, c = [], [ord(x) for x in t]
        for a in range(max(1, len(c) - fingerprint.SPAN + 1)):
            part, h = c[a : a + fingerprint.SPAN], 0
            for prime in fingerprint.PRIMES:
                h = (h << 31) ^ (sum((x + 1) * pow(fingerprint.BASE, j, prime) for j, x in enumerate(part)) % prime)
            h ^= len(part) << 40
            z = h % (1 << 64)
            z = ((z ^ (z >> 30)) * 0xBF58476D1CE4E5B9) % (1 << 64)
            z = ((z ^ (z >> 27)) * 0x94D049BB133111EB) % (1 << 64)
            out.append((z ^ (z >> 31)) >> 32)
        return sorted(set(out))[: fingerprint.KEPT] if c else []

    def alike(x, y):
        a, b = spans(x), spans(y)
        if x == y or not a or not b:
            return float(len(a) == len(b))
        both = sorted(set(a) | set(b))[: fingerprint.KEPT]
        return sum(h in a and h in b for h in both) / len(both)

    for i, t in enumerate(texts):
        following = texts[(i + 1) % len(texts)]
        k = len(t) // 4
        edited = t[: len(t) - k] + following[:k]
        r = got[i]
        assert abs(r["near_edited"] - alike(t, edited)) < 1e-9 and abs(r["near_next"] - alike(t, following)) < 1e-9
        assert r["fingerprint"].endswith("-" + "".join(f"{h:08x}" for h in spans(t))) and r["edited_fingerprint"].endswith("-" + "".join(f"{h:08x}" for h in spans(edited)))
        assert (r["fingerprint"] == r["edited_fingerprint"]) == (t == edited)
        assert r["common_prefix"] == next((j for j in range(len(t)) if j >= len(edited) or t[j] != edited[j]), min(len(t), len(edited)))


@pytest.mark.parametrize("crowd", [4096, 3, 0])
def test_suffixes_with_crowded_anchors(spark, crowd):
    """One passage in many surroundings, some of them shared too, against counts of all strings."""
    import hashlib

    rng = random.Random(12)
    say = lambda n: "".join(rng.choice("abcdefgh é") for _ in range(n))
    passage, tail = say(500), say(40)
    texts = [say(rng.randrange(0, 150)) + passage + (tail if i % 3 else "") + say(rng.randrange(0, 150)) for i in range(40)] + [passage, "", None, say(900)] + ["same " * 100] * 3
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    got = {r["doc_id"]: r for r in suffix.dedup_byte_digests(docs, 200, 0.004, crowd).collect()}
    raw, count = [(t or "").encode() for t in texts], Counter()
    for b in raw:
        count.update(b[k : k + 200] for k in range(len(b) - 199))
    for i, b in enumerate(raw):
        gone = np.zeros(len(b), bool)
        for k in range(len(b) - 199):
            if count[b[k : k + 200]] > 1:
                gone[k : k + 200] = True
        assert got[i]["n_removed"] == gone.sum() and got[i]["kept_sha256"] == hashlib.sha256(np.frombuffer(b, np.uint8)[~gone].tobytes()).hexdigest(), i


def test_neighbours_on_odd_tables(spark):
    """Columns with the names used inside; null, zero, infinite and short vectors; repeated ids with equal and unlike vectors; ties; few candidates."""
    schema = "vec_id long, embedding array<double>, cell int, part int, q string, parts int, query_id long, rank int, score string, d int"
    rng = np.random.default_rng(3)
    v = {i: rng.normal(size=6).round(2).tolist() for i in range(40)}
    v[11], v[12] = v[10], v[10]  # ties
    rows = [*v.items(), (None, v[3]), (50, None), (100, [0.0] * 6), (150, [1.0, float("inf"), 0.0, 0.0, 0.0, 0.0]), (200, [float("nan")] + [1.0] * 5), (250, [1.0, None, 1.0, 1.0, 1.0, 1.0]), (300, [1.0, 2.0]), (350, []),
            (10, v[10]), (20, v[20]), (30, v[31])]
    df = spark.createDataFrame([(i, x, 1, 2, "q", 3, 4, 5, "s", 6) for i, x in rows], schema).repartition(3)
    got = imi.search(df, F.col("vec_id") % 10 == 0, nearest=4, share=1.0).collect()
    known = [(i, np.array(x)) for i, x in rows if i is not None and x is not None and len(x) == 6 and all(y is not None and math.isfinite(y) for y in x) and any(x)]
    want = []
    for i, x in {(i, tuple(x)) for i, x in known if i % 10 == 0}:
        near = [(round(float(np.dot(x, y) / np.linalg.norm(x) / np.linalg.norm(y)), 9), j) for j, y in known if j != i]
        want += [(i, r + 1, j, s) for r, (s, j) in enumerate(sorted(near, key=lambda t: (-t[0], t[1]))[:4])]
    assert sorted((r["query_id"], r["rank"], r["vec_id"], round(r["score"], 9)) for r in got) == sorted(want)
    assert {r["query_id"] for r in got} == {0, 10, 20, 30} and sum(r["query_id"] == 30 for r in got) == 8
    assert imi.search(spark.createDataFrame([], schema), F.lit(True)).count() == 0
    assert imi.search(df.where("vec_id >= 100"), F.lit(True)).count() == 0
    assert [tuple(r)[:3] for r in imi.search(df.where("vec_id in (1, 2)"), F.col("vec_id") == 1, share=0.01).collect()] == [(1, 1, 2)]
