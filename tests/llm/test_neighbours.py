"""Neighbours against brute force."""

import os

import numpy as np
import pytest

from riskflow.llm import common
from riskflow.llm import neighbours as N


def brute(rows, every, k):
    ids = [i for i, _ in rows]
    vectors = np.array([v for _, v in rows], float)
    unit = vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
    out = {}
    for n, i in enumerate(ids):
        if i % every == 0:
            scores = unit @ unit[n]
            out[i] = sorted(((-round(float(s), 9), j) for j, s in zip(ids, scores, strict=True) if j != i))[:k]
    return out


def recall(got, want):
    hits = sum(len({j for q, _, j, _ in got if q == i} & {j for _, j in best}) for i, best in want.items())
    return hits / max(1, sum(map(len, want.values())))


def test_clusters_copies_and_odd_rows(spark):
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(20, 16))
    rows = [(k, (centres[k % 20] + rng.normal(size=16) * 0.1).round(4).tolist()) for k in range(400)]
    rows += [(k, rows[0][1]) for k in range(400, 460)] + [(460, (np.array(rows[3][1]) * 4).tolist())]
    odd = [(None, rows[0][1]), (1000, None), (1050, [0.0] * 16), (1100, [float("nan")] + [1.0] * 15), (1150, [None] + [1.0] * 15), (1200, [1.0] * 15), (1250, [float("inf")] * 16), (1300, []), (5, rows[5][1]), (0, rows[0][1])]
    frame = spark.createDataFrame([(i, v, 1.0) for i, v in rows + odd], "vec_id long, embedding array<double>, score double").repartition(3)
    got = [tuple(r) for r in N.nearest(frame, 10, 5).collect()]
    want = brute(rows, 10, 5)
    assert {q for q, *_ in got} == set(want)
    assert recall(got, want) > 0.97
    for i in want:
        own = sorted((r, j, s) for q, r, j, s in got if q == i)
        assert [r for r, _, _ in own] == [1, 2, 3, 4, 5]
        assert [(-round(s, 9), j) for _, j, s in own] == sorted((-round(s, 9), j) for _, j, s in own)
    copies = sorted((r, j) for q, r, j, _ in got if q == 410)
    assert [j for _, j in copies] == [0, 400, 401, 402, 403]


def test_few_and_no_rows(spark):
    frame = spark.createDataFrame([(0, [1.0, 0.0]), (1, [1.0, 1.0]), (2, [1e-200, 1e-200])], "vec_id long, embedding array<double>")
    got = sorted(tuple(r) for r in N.nearest(frame, 50, 5).collect())
    assert [(q, r) for q, r, _, _ in got] == [(0, 1), (0, 2)] and {j for _, _, j, _ in got} == {1, 2} and np.isclose(got[1][3], 0.5**0.5)
    assert N.nearest(frame.where("false"), 50, 5).collect() == []
    assert N.nearest(frame.where("vec_id = 0"), 50, 5).collect() == []


def test_probing_yields_every_code_within_the_radius():
    rng = np.random.default_rng(8)
    vectors = rng.normal(size=(3000, 24))
    index = N.Index(vectors, N.learn(vectors))
    for n in range(20):
        rows, scores = index.search(vectors[n], 3)
        exact = vectors @ vectors[n] / np.linalg.norm(vectors, axis=1) / np.linalg.norm(vectors[n])
        assert rows[0] == n and np.allclose(scores, exact[rows])
        assert set(rows) == set(np.argsort(-exact)[:3])


@pytest.mark.parametrize("table", ["sf0.01", "check_s"])
def test_recall(spark, table):
    folder = f"/root/testdata/{table}"
    if not os.path.isdir(folder):
        pytest.skip("table not here")
    rows = [(r.vec_id, r.embedding) for r in common.read(spark, folder, "embeddings").collect()]
    got = [tuple(r) for r in N.op5_neighbours(spark, folder).collect()]
    assert recall(got, brute(rows, 50, 5)) >= 0.98
