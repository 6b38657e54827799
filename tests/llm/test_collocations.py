import random
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from riskflow.llm import collocations as C

COLUMNS = ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]


def pieces(text):
    text = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    for c in ".,;:!?\n\x0b\x0c\r":
        text = text.replace(c, "\n")
    return [[w for w in piece.replace("\t", " ").split(" ") if w] for piece in text.split("\n")]


def plain(rows, least, longest, top):
    n, f = Counter(), defaultdict(Counter)
    for text, lang in rows:
        lang = "und" if lang is None else lang
        for words in pieces(text):
            n[lang] += len(words)
            for size in range(1, longest + 1):
                for s in range(len(words) - size + 1):
                    f[lang][tuple(words[s : s + size])] += 1
    out = []
    for lang, counts in f.items():
        candidates = {p: a for p, a in counts.items() if len(p) > 1 and a >= least}
        gone = {p[s : s + k] for p, a in candidates.items() for k in range(2, len(p)) for s in range(len(p) - k + 1) if 100 * a >= 100 * counts[p[s : s + k]]}
        scored = []
        for p, a in candidates.items():
            if p not in gone:
                score, k = min((1000 * a * n[lang] // (counts[p[:k]] * counts[p[k:]]), k) for k in range(1, len(p)))
                scored.append((-score, -a, " ".join(p).encode(), counts[p[:k]], counts[p[k:]]))
        out += [(lang, rank, p.decode(), -a, l, r, n[lang], -s) for rank, (s, a, p, l, r) in enumerate(sorted(scored)[:top], 1)]
    return sorted(out)


def texts(seed, count=400):
    rng = random.Random(seed)
    words = ["the", "The", "of", "New", "york", "city", "ünï", "a", "b", "x9", "́", " ", "z\x1cz"]
    gaps = [" ", " ", " ", "  ", "\t", ", ", ".", "\n", "\r\n", " ; "]
    rows = []
    for _ in range(count):
        text = "".join(rng.choice(words) + rng.choice(gaps) for _ in range(rng.randint(0, 60)))
        rows.append((text if rng.random() > 0.05 else None, rng.choice(["en", "en", "de", None])))
    return rows + [("new york city\n" * 40, "en")] * 3 + [("", "en"), (None, None), (" \t.", "fr")]


def frame(spark, rows):
    data = [(None if k % 9 == 0 else k % 50, t, lang, "x", k) for k, (t, lang) in enumerate(rows)]
    return spark.createDataFrame(data, "doc_id long, text string, lang string, phrase string, f long").repartition(7)


@pytest.mark.parametrize("least, longest, top", [(20, 5, 2000), (3, 4, 5), (1, 3, 50)])
def test_against_plain_counts(spark, monkeypatch, least, longest, top):
    # small parts, so that texts and pieces are cut, runs are sent more than once and keys take rounds
    monkeypatch.setattr(C, "CHUNK", 300)
    monkeypatch.setattr(C, "HELD", 500)
    monkeypatch.setattr(C, "ROUND", 300)
    monkeypatch.setattr(C, "PHRASES", 40)
    rows = texts(least)
    got = C.collocations(frame(spark, rows), least, longest, top)
    assert got.columns == COLUMNS
    wanted = plain(rows, least, longest, top)
    assert len(wanted) > 10 and sorted(map(tuple, got.collect())) == wanted
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (text VARCHAR, lang VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?)", rows)
    assert sorted(con.execute(f"SELECT {', '.join(COLUMNS)} FROM ({C.sql(least, longest, top)})").fetchall()) == wanted


def test_runs_that_share_a_key_are_told_apart(spark, monkeypatch):
    # every run of a length has the same few keys
    monkeypatch.setattr(C, "_mixed", lambda x: (x % np.uint64(3)) << np.uint64(61))
    rows = texts(1, 60)
    got = C.collocations(frame(spark, rows), 10, 3, 2000)
    assert sorted(map(tuple, got.collect())) == plain(rows, 10, 3, 2000)


def test_empty(spark):
    docs = frame(spark, [("a b", "en")])
    assert C.collocations(docs.limit(0)).count() == 0 and C.collocations(docs).count() == 0


def test_long_text_and_exact_arithmetic(spark):
    rows = [("a b " * 300_000 + "c " * 3_000_000, "en")]
    assert sorted(map(tuple, C.collocations(frame(spark, rows), 100, 2, 10).collect())) == plain(rows, 100, 2, 10)
    big = spark.createDataFrame([("en", 0, "", 9 * 10**12), ("en", 1, "a", 10**12), ("en", 1, "b", 10**12), ("en", 2, "a b", 10**12 - 1)], C.COUNTED)
    (row,) = C.scored(big).collect()
    assert row.score == 1000 * (10**12 - 1) * 9 * 10**12 // 10**24


@settings(max_examples=100, deadline=None)
@given(st.lists(st.lists(st.integers(0, 30), max_size=60), max_size=12), st.integers(2, 8), st.integers(0, 3))
def test_summaries_lose_nothing_frequent(parts, threshold, joined):
    """Whatever the order and the sizes of what is merged, no key that reaches the threshold is lost."""
    true = Counter(k for part in parts for k in part)
    summary = C.Summary(sum(true.values()) // threshold + 1)
    for n, part in enumerate(parts):
        counts = Counter(part)
        summary.add(np.array(list(counts), np.uint64), np.array(list(counts.values()), np.int64))
        if n % (joined + 1) == 0:
            summary.settle()
            assert len(summary.keys) <= summary.capacity
    kept = set(summary.reaching(threshold).tolist())
    assert kept >= {k for k, n in true.items() if n >= threshold}
    assert summary.taken * (summary.capacity + 1) <= sum(true.values())
    for key, count in zip(summary.keys.tolist(), summary.counts.tolist(), strict=True):
        assert count <= true[key] <= count + summary.taken
