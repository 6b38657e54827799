"""Removed bytes against a dictionary of all windows."""

import hashlib
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from riskflow.llm import suffixes as S


def plain(texts):
    raws = [(t or "").encode() for t in texts]
    seen = Counter(r[k : k + 400] for r in raws for k in range(len(r) - 399))
    out = []
    for r in raws:
        gone = np.zeros(len(r) + 2, bool)
        for k in range(len(r) - 399):
            if seen[r[k : k + 400]] > 1:
                gone[k + 1 : k + 401] = True
        kept = bytes(b for b, g in zip(r, gone[1:], strict=False) if not g)
        out.append((len(r), int(gone.sum()), int((np.diff(gone.astype(int)) == 1).sum()), hashlib.sha256(kept).hexdigest()))
    return out


def corpus(rng):
    word = lambda: "".join(rng.choice("abcdeé") for _ in range(rng.randrange(1, 8)))
    text = lambda n: " ".join(word() for _ in range(n))
    shared = [text(120) for _ in range(4)] + [text(75)[:400], text(80)[:399], text(90)[:401]]
    texts = [text(rng.randrange(300)) for _ in range(15)]
    for _ in range(25):
        texts.append(text(rng.randrange(60)) + "".join(rng.choice(shared) + text(rng.randrange(3)) for _ in range(rng.randrange(1, 4))))
    base = text(400)
    for _ in range(12):
        k = rng.randrange(len(base))
        texts.append(base[:k] + rng.choice("xyz") + base[k + 1 :])
    twins = [shared[0], shared[0], base, base[:700], base[300:], "é" * 500, "a" * 900, "ab" * 400, "aab" * 350, "the " * 300, "", None, " "]
    return texts + twins


@pytest.mark.parametrize("group", [S.GROUP, 2])
def test_removed_bytes(spark, group):
    texts = corpus(random.Random(3))
    rows = [(k if k % 7 else None, t, "x") for k, t in enumerate(texts)] + [(50, texts[50], "x"), (50, texts[50], "x"), (51, texts[3], "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, spans string").repartition(5)
    result = lambda raw, gone, kept: (len(raw), len(raw) - len(kept), len(gone), hashlib.sha256(kept).hexdigest())
    got = S.cut(docs, result, "n_bytes long, n_removed long, n_spans long, kept_sha256 string", group).select("row.doc_id", "cut.*", "row.spans")
    want = [(d, *x, "x") for (d, _, _), x in zip(rows, plain([t for _, t, _ in rows]), strict=True)]
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(want, key=repr)
    none = S.cut(docs.where(F.lit(False)), result, "n_bytes long, n_removed long, n_spans long, kept_sha256 string")
    assert none.collect() == []


def test_edges_of_a_shared_passage_stay_small_groups(spark, monkeypatch):
    rng, group, compare = random.Random(5), 8, S._compare
    noise = lambda n: "".join(rng.choice("abcdefgh ") for _ in range(n))
    passage = noise(900)
    texts = [noise(500) + passage + noise(500) for _ in range(60)] + [noise(700)]

    def watched(frames):
        frames = list(frames)
        for lead, n in Counter(x for frame in frames for x in frame["lead"]).items():
            assert n <= group, (n, lead)
        yield from compare(iter(frames))

    monkeypatch.setattr(S, "_compare", watched)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    result = lambda raw, gone, kept: (len(raw), len(raw) - len(kept), len(gone), hashlib.sha256(kept).hexdigest())
    got = S.cut(docs, result, "n_bytes long, n_removed long, n_spans long, kept_sha256 string", group).select("row.doc_id", "cut.*")
    assert sorted(map(tuple, got.collect())) == [(d, *x) for d, x in enumerate(plain(texts))]


def test_repeated_rows_give_their_spans_once(spark):
    rng = random.Random(8)
    text = "".join(rng.choice("abcdef ") for _ in range(3000))
    docs = spark.createDataFrame([(None, text)] * 40, "doc_id long, text string").repartition(3)
    (row,) = S.repeated_spans(docs).collect()
    spans = [(x.start, x.stop) for x in row.spans]
    assert len(spans) == len(set(spans)) < 40
    assert S.merged(row.spans) == [(0, 3000)]


def test_texts_longer_than_a_segment(monkeypatch):
    rng = random.Random(1)
    monkeypatch.setattr(S, "SEGMENT", 5000)
    raw = "".join(rng.choice("ab ") for _ in range(20000))
    import pandas as pd

    rows = pd.concat(S._find(iter([pd.DataFrame({"key_id": [1], "key_hash": [2], "text": [raw]})])))
    windows = sorted(k for a, b in zip(rows["a"], rows["b"], strict=True) for k in range(a, b + 1))
    assert windows == list(range(20000 - 399))


def test_long_text_behind_a_full_buffer():
    import pandas as pd

    rng = np.random.default_rng(2)
    text = lambda n: rng.integers(97, 123, n, np.uint8).tobytes().decode()
    texts = [text(S.SEGMENT - 1), text(S.SEGMENT + 399)]
    got = pd.concat(S._find(iter([pd.DataFrame({"key_id": [0, 1], "key_hash": [5, 5], "text": texts})])))
    for k, t in enumerate(texts):
        own = got[got["key_id"] == k].sort_values("a")
        assert own["a"].iloc[0] == 0 and own["b"].iloc[-1] == len(t) - 400
        assert (own["a"].to_numpy()[1:] == own["b"].to_numpy()[:-1] + 1).all()
        assert ((own["p"] >= own["b"]) & (own["p"] <= own["a"] + 336)).all()


def test_multikey_quicksort():
    rng = np.random.default_rng(4)
    sides = rng.integers(0, 3, (500, 16)).astype(np.uint8)
    sides[100:200] = sides[0]
    group = np.sort(rng.integers(0, 5, 500))
    order, shared = S._shared(sides, group)
    rows = [(g, s.tobytes()) for g, s in zip(group, sides, strict=True)]
    assert [rows[k] for k in order] == sorted(rows)
    for x, y, n in zip(order, order[1:], shared[1:], strict=False):
        same = next((k for k in range(16) if sides[x][k] != sides[y][k]), 16)
        assert n == (same if group[x] == group[y] else -1)
