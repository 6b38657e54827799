"""N best segmentations against all of them, and decoding against the text and the library."""

import hashlib
import zlib

import numpy as np
import public_tokenizers
import pytest
import sentencepiece

from riskflow.llm import common, segmentation as S

PATH = public_tokenizers.path("piece_bpe_32k.model")
TEXTS = ["Hello World", "a", "", None, "  two  spaces ", "été 日本語 ﬁ 🙂", "tab\tnew\nline\n\nx", "the theater, then", "x\x00y", "over and over and over"]


def every(pieces, text):
    """All (score, ids) of a text's lattice."""
    if not text:
        return [(0.0, ())]
    out = []
    for k in range(1, len(text) + 1):
        if text[:k] in pieces.score:
            own = [(pieces.score[text[:k]][0], (pieces.score[text[:k]][1],))]
        elif k == 1:
            own = [(pieces.unknown, tuple(np.frombuffer(pieces.spelled(text[0]), '<u4').tolist()))]
        else:
            continue
        out += [(a + s, i + ids) for a, i in own for s, ids in every(pieces, text[k:])]
    return out


@pytest.mark.parametrize("n", [1, 2, 5])
def test_the_n_best_of_all_segmentations(n):
    pieces = S.Pieces(PATH, n)
    for text in TEXTS:
        whole = pieces.model.normalize(text or "")
        if len(whole) > 18:
            continue
        want = sorted(every(pieces, whole), reverse=True)
        for _ in range(2):  # the second time from memory
            words, best = pieces.segment(text)
            assert [s for s, _ in best] == [s for s, _ in want[:n]], text
            found = [(s, tuple(pieces.ids(words, changed).tolist())) for s, changed in best]
            assert len(set(found)) == len(found) and set(found) <= set(want)


def test_stretches_leave_no_piece_out():
    pieces = S.Pieces(PATH, 3)
    for word in ["▁theater", "▁x,y.z", "foo)bar", "▁▁▁a", "日本"]:
        assert "".join(pieces.cut(word)) == word
        ends = np.cumsum([len(c) for c in pieces.cut(word)])[:-1].tolist()
        for x in range(len(word)):
            for y in range(x + 1, len(word) + 1):
                if word[x:y] in pieces.score:
                    assert not any(x < e < y for e in ends)


def test_stretches_together_are_as_alone():
    pieces = S.Pieces(PATH, 3)
    texts = [*(t or "" for t in TEXTS), "the quick brown fox's 1,000 naïve cafés; Straße, x" * 3, "a" * 200, "日本🙂é"]
    stretches = [c for t in texts for word in t.split(" ") for c in pieces.cut("▁" + word)]
    assert pieces.forwards(stretches) == [pieces.forward(s) for s in stretches]
    words = ["▁" + w for t in texts for w in t.split(" ")]
    assert pieces.cuts(words) == [pieces.cut(w) for w in words]
    learned, alone = S.Pieces(PATH, 3), S.Pieces(PATH, 3)
    learned.learn(learned.normalized(texts))
    for text in texts:
        (words, best), (own, want) = learned.segment(text), alone.segment(text)
        assert [s for s, _ in best] == [s for s, _ in want] and learned.ids(words).tolist() == alone.ids(own).tolist()


def test_a_long_run_of_one_letter():
    pieces = S.Pieces(PATH, 2)
    best, second, ids = pieces.forward("a" * 400_000)
    assert best >= second and pieces.decode(np.frombuffer(ids, "<u4")) == "a" * 400_000


def test_texts_come_back():
    pieces, library = S.Pieces(PATH), sentencepiece.SentencePieceProcessor(model_file=PATH)
    for text in [*TEXTS, "long word " * 5000, "y" * 3000]:
        words, best = pieces.segment(text)
        ids = pieces.ids(words)
        assert pieces.decode(ids) == (text or "")
        assert library.decode(ids.tolist()) == (text or "")
        assert all(pieces.decode(pieces.ids(words, c)) == (text or "") for _, c in best)


def test_cheapest_choices():
    lists = [[0, 3, 4], [0, 1], [0, 2, 9]]
    want = sorted(a + b + c for a in lists[0] for b in lists[1] for c in lists[2])
    assert [c for c, _ in S._cheapest(lists, 8)] == want[:8]
    assert S._cheapest([], 3) == [(0.0, ())]


def test_rows(spark):
    docs = spark.createDataFrame([(k if k else None, t, 1.0) for k, t in enumerate([*TEXTS, TEXTS[0]])], "doc_id long, text string, score double")
    pieces = S.Pieces(PATH)
    for r in docs.select("text", S.segmented(docs.text, PATH).alias("f")).collect():
        words, best = pieces.segment(r.text)
        ids = pieces.ids(words)
        assert (r.f.n_pieces, r.f.ids_crc32, r.f.score) == (len(ids), zlib.crc32(ids.tobytes()), best[0][0]) and r.f.round_trip
        assert r.f.nbest_scores == [s for s, _ in best] and r.f.decoded_sha256 == hashlib.sha256((r.text or "").encode()).hexdigest()
    assert docs.where("false").select(S.segmented(docs.text, PATH, full=True)).collect() == []


def test_documents_come_back(spark):
    rows = S.op6_segmentation(spark, "/root/testdata/sf0.001").collect()
    assert len(rows) == common.read(spark, "/root/testdata/sf0.001", "documents").count() and all(r.round_trip for r in rows)
