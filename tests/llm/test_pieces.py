"""Operator 13 against the sentencepiece library: ids, spans, decoding and the character maps that the library ships."""

import random

import numpy as np
import public_tokenizers
import pytest
import sentencepiece

from tidemark.llm import pieces

PATH = public_tokenizers.path("piece_bpe_32k.model")
RNG = random.Random(11)
ODD = ["", " ", "  a  b ", "▁▁x ▁", "\0a\0", "<s></s><0x41><unk>", "文字 🎉 é́ ퟿", " \n\t x\r\n", "x" * 5000, " " * 3000, "a  b   c" + " " * 37 + "x  " * 9, "🎉🎉" * 50]
ODD += ["".join(RNG.choice("ab    ▁é文🎉\n<x0>\0́ing") for _ in range(RNG.randrange(60))) for _ in range(500)]
CLASH = "doc_id long, text string, ids string, starts int, ends int, decoded string, n_chars long"


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=PATH)


def test_ids_spans_and_text(library):
    codec = pieces.PieceCodec(PATH)
    for text in ODD:
        ids, starts, ends = codec.encode(text)
        told = library.encode(text, return_type="proto")
        assert ids.tolist() == library.encode(text)
        assert [*zip(starts.tolist(), ends.tolist())] == [(p.begin, p.end) for p in told.pieces]
        assert codec.decode(ids) == library.decode(ids.tolist())


def test_decoding_of_any_ids(library):
    codec = pieces.PieceCodec(PATH)
    for _ in range(1500):
        ids = [RNG.choice([RNG.randrange(32000), RNG.randrange(260), 3 + RNG.randrange(256), 29871]) for _ in range(RNG.randrange(12))]
        assert codec.decode(np.array(ids, np.int32)) == library.decode(ids)


@pytest.mark.parametrize("rule", ["nmt_nfkc", "nfkc", "nfkc_cf", "nmt_nfkc_cf"])
@pytest.mark.parametrize("flags", [(True, True, True), (False, True, False), (False, False, True), (True, False, True)])
def test_compiled_character_maps(rule, flags):
    """Longest prefixes, squeezed white space and the place of every normalised character."""
    prefix, squeeze, escape = flags
    theirs = sentencepiece.SentencePieceNormalizer(rule_name=rule, add_dummy_prefix=prefix, remove_extra_whitespaces=squeeze, escape_whitespaces=escape)
    spec = theirs.serialized_normalizer_spec
    compiled = dict(pieces.fields(spec() if callable(spec) else spec))[2]
    ours = pieces.Normaliser(compiled, prefix, squeeze, escape)
    places = lambda text: np.cumsum([0, *(len(c.encode()) for c in text)]).tolist()
    for text in ODD[:60] + ["".join(RNG.choice("ＡＢ　  ﬁ①½ ががéÅẞΣ ​\t\n\x01\x7f한글ab") for _ in range(RNG.randrange(40))) for _ in range(300)]:
        data, origin = ours(text.encode())
        told, offsets = theirs.normalize(text, with_offsets=True)
        chars = {byte: i for i, byte in enumerate(places(text))}
        assert data.decode() == told
        assert [chars[int(origin[k])] for k in places(told)] == list(offsets)


def test_merges_without_and_with_equal_scores():
    """Units whose pieces have scores of their own merge by rank as by the agenda; a piece across white space makes the text one unit."""
    scores = {t: (s, i + 256) for i, (t, s) in enumerate([("a", -9.0), ("b", -9.0), ("▁", -9.0), ("ab", -1.0), ("ba", -1.0), ("aba", -2.0), ("b▁a", -0.5), ("é", -9.0)])}
    merger = pieces.Merger(scores, list(range(256)))
    for _ in range(300):
        text = "".join(RNG.choice("ab▁éx") for _ in range(RNG.randrange(1, 12)))
        assert merger(text).tolist() == merger.merge(text)


def test_operator(spark, library):
    texts = [None, *ODD[:40], "w " * 60_000]
    rows = [(i if i % 5 else None, t, "c", 1, 2, "d", 3) for i, t in enumerate(texts)] * 2
    out = pieces.round_trip(spark.createDataFrame(rows, CLASH).repartition(3), PATH).collect()
    want = [(i, library.encode(t or ""), library.decode(library.encode(t or ""))) for i, t, *_ in rows]
    assert sorted(map(str, want)) == sorted(str((r["doc_id"], r["ids"], r["decoded"])) for r in out)
    assert all(len(r["ids"]) == len(r["starts"]) == len(r["ends"]) for r in out)
    back = pieces.decode(pieces.encode(spark.createDataFrame(rows, CLASH), PATH), PATH).collect()
    assert sorted(map(str, want)) == sorted(str((r["doc_id"], r["ids"], r["decoded"])) for r in back)
    assert pieces.round_trip(spark.createDataFrame([], CLASH), PATH).count() == 0
    assert pieces.decode(spark.createDataFrame([(1, None)], "doc_id long, ids array<int>"), PATH).first()["decoded"] == ""
