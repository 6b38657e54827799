"""The field against enumeration of all labellings, the machine against its definition, both against labels held out."""

import itertools
import os
import random
import zlib

import numpy as np
import pytest

from riskflow.llm import common, labelled, quality, toxicity

DATA = "/root/testdata/sf0.01"


def some_field(rng):
    field = quality.Field.blank(np.sort(rng.normal(size=(quality.STATS, quality.BINS - 1))))
    field.weights = rng.normal(size=field.weights.shape) / 5
    field.outside, field.bias, field.chain = rng.normal(size=2), 0.3, rng.normal(size=(2, 2))
    return field


def test_marginals_sum_over_all_labellings():
    rng = np.random.default_rng(2)
    field = some_field(rng)
    counts = np.array([3, 1, 5, 2])
    stats = rng.normal(size=(counts.sum(), quality.STATS))
    bins = field.bins(stats)
    good, pairs = field.marginals(field.emission(bins, counts), counts)
    want_good, want_pairs, at = [], np.zeros((2, 2)), 0
    for n in counts:
        own = bins[at : at + n]
        at += n
        sums = np.array([
            field.bias + sum(field.weights[1, k, own[t, k]] + (field.weights[0, k, own[t - 1, k]] if t else 0) + (field.weights[2, k, own[t + 1, k]] if t + 1 < n else 0) for k in range(quality.STATS))
            + (field.outside[0] if t == 0 else 0) + (field.outside[1] if t + 1 == n else 0)
            for t in range(n)
        ])
        total, one, two = 0.0, np.zeros(n), np.zeros((2, 2))
        for y in itertools.product((0, 1), repeat=int(n)):
            p = np.exp(sums @ np.array(y) + sum(field.chain[a, b] for a, b in itertools.pairwise(y)))
            total += p
            one += p * np.array(y)
            for a, b in itertools.pairwise(y):
                two[a, b] += p
        want_good += (one / total).tolist()
        want_pairs += two / total
    assert np.allclose(good, want_good) and np.allclose(pairs, want_pairs)


def test_line_stats():
    stats, counts = quality.line_stats(["Ab 1!\nAb 1!", "", "|| é."])
    assert counts.tolist() == [2, 1, 1]
    assert np.allclose(stats[0, :9] * 5, [1, 1, 1, 1, 0, 0, 1, 0, 0])
    assert stats[:2, 12].tolist() == [0, 1] and stats[2, 9] == 0
    assert np.allclose(stats[3, :9] * 6, [0, 0, 0, 1, 2, 2, 0, 1, 0])


def test_quality_of_held_out_documents(spark):
    docs, labels = (common.read(spark, DATA, t) for t in ("documents", "labels"))
    field = quality.trained(docs.select("doc_id", "text"), labels)
    rows = quality.op2_quality(spark, DATA).collect()
    known = {r.doc_id: r.quality for r in labels.collect()}
    assert len(rows) == docs.count()
    held = [(r.predicted, known[r.doc_id]) for r in rows if r.held_out and known.get(r.doc_id) is not None]
    assert len(held) > 40 and np.mean([a == b for a, b in held]) > 0.95
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in rows)
    assert 0 <= field.scores([""])[0] <= 1
    texts = ["a good line of words here", "x " * 200000, "\n" * 5000, "!!!!"]
    assert np.allclose(field.scores(texts), [field.scores([t])[0] for t in texts])


def plain_score(machine, text):
    own = [k for k, b in enumerate(machine.kept) if b in set(toxicity.terms(text))]
    pairs = sum(machine.factors[a] @ machine.factors[b] for a, b in itertools.combinations(own, 2))
    return 1 / (1 + np.exp(-(machine.bias + machine.weights[own].sum() + pairs)))


def test_machine_learns_pairs_that_sums_miss():
    rng = random.Random(1)
    sets, labels = [], []
    for _ in range(3000):
        a, b = rng.random() < 0.5, rng.random() < 0.5
        words = [f"w{rng.randrange(40)}" for _ in range(6)] + ["insult"] * a + ["group"] * b
        sets.append(np.array(toxicity.terms(" ".join(words))))
        labels.append(int(a and b))
    machine = toxicity.fit(sets, np.array(labels))
    one, other, both = machine.scores(["insult w1", "group w1", "insult group w1"])
    assert one < 0.5 and other < 0.5 and both > 0.5
    for text in ["", "insult", "insult group w3 w4", None]:
        assert np.isclose(machine.scores([text])[0], plain_score(machine, text))
    assert np.abs(machine.factors).max() > 0.05


def test_machine_learns_pairs_of_words_that_tell_nothing_alone():
    rng = random.Random(3)
    sets, labels = [], []
    for _ in range(8000):
        a, b = rng.random() < 0.5, rng.random() < 0.5
        words = [f"w{rng.randrange(40)}" for _ in range(6)] + ["left"] * a + ["right"] * b
        sets.append(np.array(toxicity.terms(" ".join(words))))
        labels.append(int(a != b))
    machine = toxicity.fit(sets, np.array(labels))
    assert {toxicity.bucket("left"), toxicity.bucket("right")} <= set(machine.kept.tolist()) and len(machine.kept) < 6
    none, left, right, both = machine.scores(["w1", "left w1", "right w2", "left right w1"])
    assert none < 0.4 and both < 0.4 and left > 0.6 and right > 0.6


def test_unrelated_words_are_no_pair():
    rng = np.random.default_rng(5)
    sets = [np.unique(rng.integers(0, 300, 20)) for _ in range(2000)]
    labels = (rng.random(2000) < 0.1).astype(int)
    flat, of = np.concatenate(sets), np.repeat(np.arange(2000), [len(s) for s in sets])
    counts = np.bincount(flat, minlength=toxicity.BUCKETS)
    assert len(toxicity.in_company(flat, of, counts, labels)) == 0
    assert len(toxicity.in_company(flat[:0], of[:0], counts * 0, labels)) == 0


def test_toxicity_of_held_out_documents(spark):
    rows = toxicity.op3_toxicity(spark, DATA).collect()
    known = {r.doc_id: r.toxic for r in common.read(spark, DATA, "labels").collect()}
    held = [(r.predicted, known[r.doc_id]) for r in rows if r.held_out and known.get(r.doc_id) is not None]
    assert len(rows) == 1000 and np.mean([a == b for a, b in held]) > 0.95
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in rows)


@pytest.mark.skipif(not os.path.isdir("/root/testdata/check_s"), reason="larger tables not here")
def test_toxicity_learned_from_many_labels(spark):
    docs, labels = (common.read(spark, "/root/testdata/check_s", t) for t in ("documents", "labels"))
    machine = toxicity.trained(docs.select("doc_id", "text"), labels, 6000)
    held = labels.where(common.held_out(labels.doc_id)).orderBy("doc_id").limit(1500).join(docs, "doc_id").select("text", "toxic").toPandas()
    assert np.mean((machine.scores(held["text"].tolist()) >= 0.5) == held["toxic"]) > 0.97


def test_odd_rows(spark):
    docs = spark.createDataFrame([(1, "fine text", 0.5), (1, "fine text", 0.5), (None, None, 0.1), (2, "", 0.1), (3, "BAD!! BAD!!", 0.1)], "doc_id long, text string, score double")
    labels = spark.createDataFrame([(1, 1, 0), (3, 0, 1), (None, 0, 0), (2, None, None), (1, 1, 0)], "doc_id long, quality int, toxic int")
    for label in ("quality", "toxic"):
        got = labelled.sample(docs, labels, label, 10).collect()
        assert {r.text for r in got} <= {"fine text", "BAD!! BAD!!"}
    for module in (quality, toxicity):
        for known in (labels, labels.where("false")):
            model = module.trained(docs, known)
            scores = [r[0] for r in docs.select(module.score(model)).collect()]
            assert len(scores) == 5 and all(0 <= s <= 1 for s in scores) and scores[0] == scores[1] and np.isclose(scores[2], scores[3])
            if known is not labels:
                assert set(scores) == {0.5}
        assert docs.where("false").select(module.score(model)).collect() == []
