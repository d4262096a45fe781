"""Operator 12 against the two libraries and counting in dictionaries."""

import hashlib
import random
from collections import Counter

import numpy as np
import public_tokenizers
import sentencepiece
from tokenizers import Tokenizer

from tidemark.llm import alignment

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
CLASH = "doc_id long, text string, batch string, bucket string, frames int, kind string, part int, n_best string"


def by_hand(rows):
    """The contract, with tokens of the libraries."""
    a_lib, b_lib = Tokenizer.from_file(A), sentencepiece.SentencePieceProcessor(model_file=B)
    a_lib.encode_special_tokens = True
    plain = {c: b for b, c in alignment_bytes().items()}
    a_names = {i: t for t, i in a_lib.get_vocab().items()}
    docs, count = [], Counter()
    for doc_id, text in rows:
        a = a_lib.encode(" " + text, add_special_tokens=False).ids if text else []
        b = b_lib.encode(text) if text else []
        a_bytes = [bytes(plain[c] for c in a_names[i]) for i in a]
        b_bytes = [bytes([int(p[3:5], 16)]) if b_lib.is_byte(i) else p.replace("▁", " ").encode() for i, p in zip(b, map(b_lib.id_to_piece, b))]
        data = (" " + (text or "")).encode()
        if not text or b"".join(a_bytes) != data or b"".join(b_bytes) != data:
            docs.append((doc_id, [], [], [], ""))
            continue
        ends = [np.cumsum([*map(len, x)]).tolist() for x in (a_bytes, b_bytes)]
        groups, links, i, j = [], [], 0, 0
        for end in sorted({*ends[0]} & {*ends[1]}):
            p, q = ends[0].index(end, i), ends[1].index(end, j)
            groups.append(",".join(map(str, a[i : p + 1])) + "|" + ",".join(map(str, b[j : q + 1])))
            links.append((a[p], b[q]))
            i, j = p + 1, q + 1
        count.update(links)
        docs.append((doc_id, a, b, links, hashlib.sha256(";".join(groups).encode()).hexdigest()))
    best = Counter()
    for (_, b_id), n in count.items():
        best[b_id] = max(best[b_id], n)
    return [(d, len(a), len(b), len(links), len(links), sum(count[x] == best[x[1]] for x in links), sum(count[x] for x in links), sha) for d, a, b, links, sha in docs]


def alignment_bytes():
    from tidemark.llm.bpe import byte_chars

    return byte_chars()


def test_alignment(spark):
    rng = random.Random(3)
    words = ["the", "Alpha", "beta,", "naïve", "文字", "🎉", "x" * 30, "12345", "<|endoftext|>", "\n\n", "don't", "  ", "Straße"]
    rows = [(i // 2 if i % 7 else None, " ".join(rng.choice(words) for _ in range(rng.randrange(80)))) for i in range(60)]
    rows += [(1, None), (2, ""), (3, "has ▁ in it"), (4, " lead"), (5, "\0"), (6, "long " * 9000), *[(7, "the hot the hot")] * 40]
    df = spark.createDataFrame([(d, t, "c", "c", 1, "c", 2, "c") for d, t in rows], CLASH).repartition(3)
    out = alignment.align(df, A, B, slice_bytes=2000, buckets=4, fan=2)  # many parts, so that lists of counts merge in rounds
    assert sorted(map(str, by_hand(rows))) == sorted(str(tuple(r[c] for c in alignment.LINKED_TYPE.names)) for r in out.collect())
    whole = alignment.align(df, A, B)
    assert sorted(map(str, whole.collect())) == sorted(map(str, out.collect()))
    assert alignment.align(spark.createDataFrame([], CLASH), A, B).count() == 0
    nothing = alignment.align(spark.createDataFrame([(None, None), (1, "▁")], "doc_id long, text string"), A, B).collect()
    assert sorted(tuple(r)[1:] for r in nothing) == [(0, 0, 0, 0, 0, 0, "")] * 2


def test_merge_of_runs():
    """Runs in blocks, with keys that several blocks and several runs hold."""
    rng = np.random.default_rng(4)
    for _ in range(40):
        runs, want = [], Counter()
        for _ in range(rng.integers(1, 7)):
            keys = np.sort(rng.integers(0, 40, rng.integers(0, 60))).astype(np.uint64)
            n = rng.integers(1, 5, len(keys))
            for k, x in zip(keys.tolist(), n.tolist()):
                want[k] += x
            size = int(rng.integers(1, 9))
            runs.append(iter([(keys[i : i + size], n[i : i + size]) for i in range(0, len(keys), size)]))
        keys, n = alignment.joined(alignment.merged(runs))
        assert keys.tolist() == sorted(want) and n.tolist() == [want[k] for k in sorted(want)]


def test_long_texts_by_halves(spark):
    lib = Tokenizer.from_file(A)
    lib.encode_special_tokens = True
    text = " ".join(f"word{i % 613} <|endoftext|>" for i in range(12_000))
    assert alignment.Aligner(alignment.codec(A), alignment.piece_codec(B)).encoded(text).tolist() == lib.encode(text, add_special_tokens=False).ids
