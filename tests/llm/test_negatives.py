import random

import duckdb
import numpy as np
import pytest

from riskflow.llm import negatives as N


def plain(rows, every, positives=5, negatives=5, percent=80):
    """Brute force over (vec_id, label, q)."""
    least = {}
    for i, label, q in rows:
        least[i] = min(least.get(i, (label, q)), (label, q))
    sizes = [len(q) for _, q in least.values()]
    usual = max(sorted(set(sizes)), key=sizes.count) if sizes else 0
    items = {i: (label, q) for i, (label, q) in least.items() if len(q) == usual}
    out = []
    for a, (label, q) in items.items():
        if a % every:
            continue
        scores = sorted((-sum(x * y for x, y in zip(q, p, strict=True)), i, other) for i, (other, p) in items.items() if i != a)
        for s, i, _ in [x for x in scores if x[2] == label][:positives]:
            near = [x for x in scores if x[2] != label and percent * -s <= 100 * -x[0] <= 100 * -s][:negatives]
            out += [(a, i, rank, other, -s, -t) for rank, (t, other, _) in enumerate(near, 1)]
    return sorted(out)


def vectors(seed, n, d=8, spread=4, labels=3):
    rng = random.Random(seed)
    centres = [[rng.randint(-40, 40) for _ in range(d)] for _ in range(6)]
    return [(i, rng.randrange(labels), [c + rng.randint(-spread, spread) for c in rng.choice(centres)]) for i in range(n)]


def items(spark, rows):
    return spark.createDataFrame([(i, label, q, "x") for i, label, q in rows], "vec_id long, label long, q array<long>, rep string").repartition(5)


@pytest.mark.parametrize("seed, n, d, spread", [(1, 600, 8, 4), (2, 500, 3, 1), (3, 400, 16, 60)])
def test_against_brute_force(spark, monkeypatch, seed, n, d, spread):
    monkeypatch.setattr(N, "LEAF", 8)
    monkeypatch.setattr(N, "BRANCH", 4)
    monkeypatch.setattr(N, "SHARD", 40)
    monkeypatch.setattr(N, "CELLS", 7)
    monkeypatch.setattr(N, "SAMPLE", 100)
    rows = vectors(seed, n, d, spread)
    wanted = plain(rows, 10)
    assert wanted
    got = N.mined(items(spark, rows).drop("rep"), 10)
    assert got.dtypes == [(c.split()[0], {"long": "bigint"}.get(c.split()[1], c.split()[1])) for c in N.NEGATIVES.split(", ")]
    assert sorted(map(tuple, got.collect())) == wanted


def test_copies_repeats_and_odd_rows(spark, monkeypatch):
    monkeypatch.setattr(N, "SHARD", 30)
    rows = vectors(4, 200, 4, 3) + [(1000 + i, i % 3, [5, 5, 5, 5]) for i in range(300)] + [(2000, 1, [0, 0, 0, 0]), (2010, 1, [1, 2, 3]), (2020, 9, [3, 3, 3, 3])]
    rows += [(10, 0, [-99, 0, 0, 0]), (10, 0, [-99, 0, 0, 0]), (-20, 2, [7, 0, -3, 1])]
    assert sorted(map(tuple, N.mined(items(spark, rows), 10).collect())) == plain(rows, 10)


def test_large_numbers(spark):
    rows = [(i, i % 2, [(i * 7919) % 101 * 10**7, -(i * 104729) % 97 * 10**7, 10**8]) for i in range(120)]
    assert sorted(map(tuple, N.mined(items(spark, rows), 10).collect())) == plain(rows, 10)
    huge = [(0, 0, [2**62, 1]), (1, 0, [2**62, 1]), (2, 1, [2**62, 2]), (10, 1, [-(2**63), 0])]
    assert (0, 1, 1, 2, 2**63 - 1, 2**63 - 1) in set(map(tuple, N.mined(items(spark, huge), 10).collect()))


def test_query_on_odd_rows_and_sql(spark, tmp_path):
    rng = random.Random(7)
    rows = [(i, rng.randrange(10), [rng.uniform(-1, 1) for _ in range(6)]) for i in range(1, 1500)]
    rows += [(3000, None, [1.0] * 6), (3100, 1, None), (3200, 1, [None] + [1.0] * 5), (3300, 2, [float("nan")] * 6), (3400, 2, [float("inf")] * 6), (None, 1, [1.0] * 6), (3500, 3, []), (3600, 3, [0.0] * 6)]
    rows += [(5000 + i, 4, [0.5] * 6) for i in range(200)]
    spark.createDataFrame([(*r, "x") for r in rows], "vec_id long, embedding_label int, embedding array<float>, rep string").withColumnRenamed("embedding_label", "label").write.parquet(f"{tmp_path}/embeddings.parquet")
    got = sorted(map(tuple, N.op13_negatives(spark, str(tmp_path)).collect()))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{tmp_path}/embeddings.parquet/*.parquet'")
    columns = [c.split()[0] for c in N.NEGATIVES.split(", ")]
    assert got and got == sorted(con.execute(f"SELECT {', '.join(columns)} FROM ({N.SQL})").fetchall())


def test_empty(spark, tmp_path):
    spark.createDataFrame([], "vec_id long, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    assert N.op13_negatives(spark, str(tmp_path)).count() == 0


def test_tree_keeps_its_radii_and_leaves_nodes_out():
    rows = vectors(9, 3000, 5, 2, 1)
    points = np.array([q for _, _, q in rows], np.int64)
    tree = N.Tree(points, np.zeros(len(rows), np.int64), [[i] for i, _, _ in rows])
    lifted = N.lifted(tree.whole, tree.norm2)

    def below(node):
        if tree.leaf[node] is not None:
            return list(range(*tree.leaf[node]))
        return [row for child in tree.children[node] for row in below(child)]

    assert sorted(below(0)) == list(range(len(rows)))
    for node, centre in enumerate(tree.centres):
        own = np.sqrt(((lifted[below(node)] - centre) ** 2).sum(1))
        assert own.max() <= tree.radii[node] + 1e-6
        assert all(tree.radii[c] <= tree.radii[node] * 2 for c in tree.children[node])
    anchor = points[17]
    got = tree.search(anchor, 0, True, [(-(2**63), 2**63 - 1)], 5)[0]
    scores = points @ anchor
    assert got == [(int(scores[k]), k) for k in sorted(range(len(rows)), key=lambda k: (-scores[k], k))[:5]]
    # on clustered vectors most leaves are never looked at
    assert tree.verified < len(rows) / 3
