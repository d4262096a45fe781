"""Operator 11 against filtering document by document in every order."""

import random
import re
from collections import Counter
from itertools import permutations

import numpy as np

from tidemark.llm import audit

WORD = re.compile(r"[^\x20\x09-\x0D]+")
DOCS = "doc_id long, text string, lang string, part string, n int, digest string, good int, toxic int, A string"
LABELS = "doc_id long, quality int, toxic int, part string, _id long"


def by_hand(docs, labels):
    least = {}
    for i, text, _ in docs:
        if i is not None:
            least[text or ""] = min(least.get(text or "", i), i)
    rows = []
    for i, text, lang in docs:
        t, w = text or "", WORD.findall(text or "")
        fails = {"A": len(w) < 200, "B": 100 * len(set(w)) < 50 * len(w), "C": 100 * sum("A" <= c <= "Z" for c in t) > 3 * len(t),
                 "D": any(c in "#$%&*|" for c in t), "E": i is not None and least[t] < i}
        rows.append((lang or "", fails, any(k == i and q == 1 for k, q, _ in labels if k is not None), any(k == i and x == 1 for k, _, x in labels if k is not None)))
    out = {}
    for part in {r[0] for r in rows}:
        mine, shapley = [r for r in rows if r[0] == part], Counter()
        for order in map("".join, permutations("ABCDE")):
            left = mine
            for step, f in enumerate(order, 1):
                gone, left = [r for r in left if r[1][f]], [r for r in left if not r[1][f]]
                failing = sum(r[1][f] for r in mine)
                out[part, order, step] = [len(left), len(gone), failing - len(gone), sum(r[1][f] and sum(r[1].values()) == 1 for r in mine), sum(r[2] for r in gone), sum(r[3] for r in gone)]
                shapley[f] += len(gone)
        for (p, order, step), v in out.items():
            if p == part:
                v.append(shapley[order[step - 1]])
    return {k: tuple(v) for k, v in out.items()}


def test_audit(spark):
    rng = random.Random(8)
    texts = [" ".join(rng.choice(["aa", "Bb", "c#", "dé", f"w{rng.randrange(900)}"]) for _ in range(rng.choice([3, 150, 199, 200, 201, 400]))) for _ in range(60)]
    texts += [None, "", " \t", "x " * 300, " ".join(f"w{i}" for i in range(250)), " ".join(f"w{i // 2}" for i in range(400)), "É" * 97 + "ABC", "É" * 96 + "ABCD", "y " * 70_000]
    docs = [(i, rng.choice(texts), rng.choice(["en", "fr", None, ""])) for i in range(200)]
    docs += [(None, texts[0], "en")] * 3 + [(None, None, "fr"), (5, texts[0], "en"), (5, texts[0], "fr"), *[(900, texts[1], "en")] * 4, (1, texts[1], "de"), (901, None, "de"), (902, "", "de")]
    labels = [(i, rng.choice([0, 1, None]), rng.choice([0, 1])) for i in range(0, 200, 2)] + [(5, 1, 0), (5, 0, 1), (None, 1, 1), (900, 1, 1)]
    rng.shuffle(docs)
    frame = spark.createDataFrame([(*d, "p", 1, "d", 1, 1, "a") for d in docs], DOCS).repartition(4)
    told = spark.createDataFrame([(*x, "p", 2) for x in labels], LABELS)
    got = {(r["part"], r["filter_order"], r["step"]): tuple(r)[3:] for r in audit.audit(frame, told).collect()}
    assert got == by_hand(docs, labels)
    assert audit.audit(spark.createDataFrame([], DOCS), told).count() == 0
    unlabelled = audit.audit(frame, spark.createDataFrame([], LABELS)).collect()
    assert len(unlabelled) == len(got) and not any(r["good_lost"] or r["toxic_lost"] for r in unlabelled)


def test_contractions_are_sums_of_cells():
    tensor = np.random.default_rng(1).integers(0, 99, (3, 2, 2, 2, 2, 2))
    picks = [(audit.PASS, audit.FAIL, audit.ALL, audit.PASS, audit.ALL), (audit.ALL,) * 5]
    got = audit.contracted(tensor, picks)
    assert got[:, 0].tolist() == tensor[:, 0, 1, :, 0, :].sum((1, 2)).tolist() and got[:, 1].tolist() == tensor.reshape(3, -1).sum(1).tolist()
