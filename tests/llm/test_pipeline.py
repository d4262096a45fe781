"""Stages of the pipeline on small fixtures, against plain Python."""

import random
import re

import pytest

import corpus_pipeline
from tidemark.llm import minhash


def test_near_duplicates_of_080_to_085_go(spark):
    """Copies with 4 to 7 edits lie at 0.75 to 0.86 of their original, most of those to drop under 0.85."""
    rng, rows = random.Random(3), []
    for i in range(40):
        w = [f"w{rng.randrange(10**6)}" for _ in range(260)]
        rows.append((2 * i, " ".join(w)))
        for k in range(4 + i % 4):
            w[20 + 30 * k] = f"new{k}"
        rows.append((2 * i + 1, " ".join(w)))
    sets = [{tuple(w[k : k + 5]) for k in range(len(w) - 4)} for w in (t.split() for _, t in rows)]
    likeness = lambda i, j: 100 * len(sets[i] & sets[j]) / len(sets[i] | sets[j])
    gone = {j for j in range(len(sets)) for i in range(j) if likeness(i, j) >= 80}
    assert sum(likeness(j - 1, j) < 85 for j in gone) >= 10 and len(gone) < 40
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    left = corpus_pipeline.drop_near_duplicates(spark, docs, "")
    assert sorted(map(tuple, left.collect())) == [r for r in rows if r[0] not in gone]


def test_near_duplicates_plans_stay_small(spark, monkeypatch):
    """Of a family with many components, no step's plan repeats what an earlier one can keep: the driver holds each plan, and anew after each of its stages."""
    rng, rows, exchanges = random.Random(11), [], []
    base = [f"w{rng.randrange(400)}" for _ in range(260)]
    for i in range(80):
        w = list(base)
        for _ in range(rng.choice([4, 6, 8, 9])):
            w[rng.randrange(len(w))] = f"new{rng.randrange(10**9)}"
        rows.append((i, " ".join(w)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    keep = type(docs).checkpoint

    def counted(df, *args, **more):
        exchanges.append(len(re.findall(r"\bExchange ", df._jdf.queryExecution().executedPlan().toString())))
        return keep(df, *args, **more)

    monkeypatch.setattr(type(docs), "checkpoint", counted)
    left = corpus_pipeline.drop_near_duplicates(spark, docs, "")
    assert 1 < left.count() < 80
    assert 1 < max(exchanges) <= 10


@pytest.mark.parametrize("threshold", [50, 80, 85, 95, 100])
def test_bands_find_pairs_at_the_threshold(threshold):
    bands, rows = minhash.banding(threshold)
    assert (1 - (threshold / 100) ** rows) ** bands <= 1e-5 and bands * rows >= minhash.PACKED


def test_all_stages_against_plain_python(spark, tmp_path):
    """run()'s rows from rejected, toxic, copied and overlapping documents, with an extra column of a clashing name."""
    from tokenizers import Tokenizer

    import public_tokenizers

    rng, rows, labels = random.Random(21), [], []
    words = ["".join(rng.choice("abcdefghijklmno") for _ in range(rng.randrange(2, 8))) for _ in range(300)]
    say = lambda n: " ".join(rng.choices(words, k=n))
    passage = say(70)
    for i in range(120):
        bad = i % 4 == 1
        text = " ".join([say(60), *(["vilified", "vilest", "vile"] if bad else []), say(20)])
        rows.append((i, text, rng.choice(["en", "fr"]), 1))
        labels.append((i, int(bad)))
    for i in range(6):
        rows.append((200 + i, say(20) + " " + passage + " " + say(20), "en", 1))
    rows += [(300, None, None, 1), (301, "12 34", "en", 1), (302, "", "fr", 1), (310, rows[0][1], "en", 1), (310, rows[0][1], "en", 1), (311, rows[2][1] + " more", "en", 1), (311, say(50), "en", 1)]
    docs = [(i, t, lang, "src", len(t or ""), b) for i, t, lang, b in rows]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long, _b int").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    table = spark.read.parquet(f"{tmp_path}/documents.parquet")

    stay = [(i, t) for i, t, *_ in docs if t and any(c.isalpha() for c in t)]
    bad = {i for i, y in labels if y}
    after = corpus_pipeline.drop_toxic(spark, corpus_pipeline.identify_language(spark, table, ""), str(tmp_path))
    assert after.columns == table.columns and after.dtypes == table.dtypes
    kept = sorted((r["doc_id"], r["text"]) for r in after.collect())
    clean = sorted(x for x in stay if x[0] not in bad)
    assert set(kept) >= set(clean) and len([k for k in kept if k[0] in bad]) <= 3

    sets = [{tuple(w[k : k + 5]) for k in range(len(w) - 4)} for w in (t.split() for _, t in kept)]
    group = list(range(len(kept)))
    for j in range(len(kept)):
        for i in range(j):
            if 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                a, b = sorted((group[i], group[j]))
                group = [a if g == b else g for g in group]
    single = [kept[g] for g in sorted(set(group))]
    near = corpus_pipeline.drop_near_duplicates(spark, after, "")
    assert near.columns == table.columns and sorted((r["doc_id"], r["text"]) for r in near.collect()) == sorted(single)

    count: dict[bytes, int] = {}
    for _, t in single:
        for k in range(len(t.encode()) - 199):
            piece = t.encode()[k : k + 200]
            count[piece] = count.get(piece, 0) + 1
    left = []
    for i, t in single:
        raw, gone = t.encode(), set()
        for k in range(len(raw) - 199):
            if count[raw[k : k + 200]] > 1:
                gone.update(range(k, k + 200))
        left.append((i, bytes(b for k, b in enumerate(raw) if k not in gone).decode()))
    assert any(len(a) < len(b) for (_, a), (_, b) in zip(left, single))
    texts = corpus_pipeline.drop_repeated_passages(spark, near, "")
    assert texts.columns == table.columns and sorted((r["doc_id"], r["text"]) for r in texts.collect()) == sorted(left)
    assert all(r["n_chars"] == len(r["text"]) for r in texts.collect())

    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want = sorted((i, len(library.encode(t, add_special_tokens=False).ids) + 1) for i, t in left)
    assert sorted((r["doc_id"], r["length"]) for r in got) == want
    assert len({r["sequence_id"] for r in got}) == -(-sum(n for _, n in want) // 4096)


@pytest.mark.parametrize("name,stage", corpus_pipeline.STAGES)
def test_stages_on_odd_tables(spark, tmp_path, name, stage):
    """Empty tables, nulls in every column, repeated rows."""
    kind = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame([(1, 0), (1, 0), (None, 1), (2, None)], "doc_id long, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert stage(spark, spark.createDataFrame([], kind), str(tmp_path)).count() == 0
    rows = [(None, None, None, None, None), (None, "words here", None, None, None), (1, "some text", "en", None, 9), (1, "some text", "en", None, 9), (1, None, "en", "s", None), (2, "", "en", "s", 0)]
    out = stage(spark, spark.createDataFrame(rows, kind), str(tmp_path)).collect()
    assert {r["doc_id"] for r in out} >= {None, 1}
