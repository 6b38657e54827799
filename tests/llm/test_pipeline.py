"""The pipeline against plain versions of its stages, each on what the plain version of the one before it kept."""

from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest

import corpus_pipeline as P
from riskflow.llm import common, quality, segmentation
from tests.llm.test_decontamination import split
from tests.llm.test_simhash import plain_components, plain_fingerprint

DATA = "/root/testdata/sf0.001"


def plain_near(rows):
    codes = [plain_fingerprint(r["text"]) for r in rows]
    first = {}
    for r, c in sorted(zip(rows, plain_components(codes), strict=True), key=lambda x: (x[0]["doc_id"] is None, x[0]["doc_id"])):
        first.setdefault(c, r)
    return list(first.values())


def plain_cut(rows):
    raws = [(r["text"] or "").encode() for r in rows]
    seen = defaultdict(int)
    for raw in raws:
        for k in range(len(raw) - 399):
            seen[hash(raw[k : k + 400])] += 1
    out = []
    for r, raw in zip(rows, raws, strict=True):
        gone = bytearray(len(raw))
        for k in range(len(raw) - 399):
            if seen[hash(raw[k : k + 400])] > 1:
                gone[k : k + 400] = b"\1" * 400
        text = bytes(b for b, g in zip(raw, gone, strict=True) if not g).decode("utf-8", "ignore")
        out.append({**r, "text": None if r["text"] is None else text, "n_chars": r["n_chars"] if r["text"] is None else len(text)})
    return out


def plain_clean(rows, items):
    windows = {tuple(w[s : s + min(13, len(w))]) for w in map(split, items) for s in range(len(w) - min(13, len(w)) + 1) if w}
    sizes = {len(w) for w in windows}
    out = []
    for r in rows:
        own, hit = split(r["text"]), set()
        for n in sizes:
            for k in range(len(own) - n + 1):
                if tuple(own[k : k + n]) in windows:
                    hit |= set(range(k, k + n))
        if not hit or 20 * len(hit) < len(own):
            out.append(r)
    return out


def same(frame, rows):
    key = lambda r: (r["doc_id"] is None, r["doc_id"])
    assert frame.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    assert sorted((r.asDict() for r in frame.collect()), key=key) == sorted(rows, key=key)


@pytest.fixture(scope="module")
def stages(spark):
    assert [name for name, _ in P.STAGES] == ["quality", "near_duplicates", "suffixes", "decontamination", "pieces"]
    out, docs = [], common.read(spark, DATA, "documents")
    for name, stage in P.STAGES:
        out.append(docs)
        docs = common.written(stage(spark, docs, DATA), name)
    return [*out, docs]


def test_stages(spark, stages):
    rows = [r.asDict() for r in stages[0].collect()]
    field = quality.trained(stages[0].select("doc_id", "text"), common.read(spark, DATA, "labels"))
    rows = [r for r in rows if field.scores([r["text"] or ""])[0] >= 0.3]
    same(stages[1], rows)
    rows = plain_near(rows)
    same(stages[2], rows)
    rows = plain_cut(rows)
    same(stages[3], rows)
    rows = plain_clean(rows, [r.text for r in common.read(spark, DATA, "benchmark").collect()])
    same(stages[4], rows)
    model = segmentation.Pieces(public_tokenizers.path("piece_bpe_32k.model"))
    found = {r.doc_id: r for r in stages[5].collect()}
    assert len(found) == len(rows) and 0 < len(rows) < stages[0].count()
    for r in rows:
        words, best = model.segment(r["text"])
        one = found[r["doc_id"]]
        assert (one.ids, one.score, one.nbest_scores, one.text) == (model.ids(words).tolist(), best[0][0], [s for s, _ in best], r["text"] or "")
    assert sorted(map(tuple, P.run(spark, DATA).select("doc_id", "score").collect())) == sorted((r.doc_id, r.score) for r in found.values())


def test_odd_rows_pass_every_stage(spark):
    long = " ".join(f"word{k}" for k in range(300))
    rows = [(1, long, "en", "s", 5, 9), (1, long, "en", "s", 5, 9), (None, long, None, None, None, None), (None, None, None, None, None, None), (3, "", "en", "s", 0, 1), (4, "x", "en", "s", 1, 1), (5, "fine words in a line. " * 30 + "é" * 300, "en", "s", 1, 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, row int")
    kept = {(r.doc_id, r.text) for r in P.distinct(spark, docs, DATA).collect()}
    assert kept == {(1, long), (3, ""), (4, "x"), (5, rows[6][1])}
    for _, stage in P.STAGES[:-1]:
        assert stage(spark, docs, DATA).columns == docs.columns
    cut = sorted(((r.doc_id, r.text, r.n_chars) for r in P.unrepeated(spark, docs, DATA).collect()), key=repr)
    assert cut == sorted([(1, "", 0), (1, "", 0), (None, "", 0), (None, None, None), (3, "", 0), (4, "x", 1), (5, rows[6][1][-1:] and cut_tail(rows[6][1]), len(cut_tail(rows[6][1])))], key=repr)
    empty = docs.where("false")
    for _, stage in P.STAGES:
        assert np.sum([1 for _ in stage(spark, empty, DATA).collect()]) == 0


def cut_tail(text):
    return plain_cut([{"text": text, "n_chars": 0}])[0]["text"]
