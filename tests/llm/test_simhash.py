"""Fingerprints, links and components against all pairs."""

import random

import numpy as np
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from riskflow.llm import simhash as S
from riskflow.llm.components import components


def plain_fingerprint(text):
    words = [w for w in __import__("re").split(r"[ \t-\r]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")) if w]
    if not words:
        return 0
    runs = [words[k : k + 3] for k in range(max(1, len(words) - 2))]
    hashes = [xxh64_intdigest(" ".join(r).encode(), 42) for r in runs]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(codes):
    root = list(range(len(codes)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(codes)):
        for j in range(i):
            if bin((codes[i] ^ codes[j]) & (2**64 - 1)).count("1") <= 2:
                root[find(i)] = find(j)
    return [find(i) for i in range(len(codes))]


def test_fingerprint():
    for text in [None, "", " \n", "One", "ONE two", "É One two", "a b c a b c a b c", "x\x0by\x1cz w " * 500, " ".join(map(str, range(40000)))]:
        assert S.fingerprint(text) & (2**64 - 1) == plain_fingerprint(text)


def test_masks_leave_room_for_the_radius():
    for mask in [0, *S.finer(0), *S.finer(S.finer(0)[3])]:
        more = S.finer(mask)
        free = [b for b in range(64) if not mask >> b & 1]
        for a in free:
            for b in free:
                assert any(not m >> a & 1 and not m >> b & 1 for m in more)


def clustered(rng, n):
    codes = set()
    while len(codes) < n:
        centre = rng.getrandbits(64)
        for _ in range(rng.choice([1, 2, 5, 60])):
            for _ in range(rng.randrange(4)):
                centre ^= 1 << rng.randrange(64)
            codes.add(centre)
    return sorted(codes)[:n]


def test_links_give_the_components_of_all_pairs(spark):
    rng = random.Random(5)
    codes = clustered(rng, 600)
    signed = [S._signed(c) for c in codes]
    want = plain_components(codes)
    frame = spark.createDataFrame([(c,) for c in signed], "fp long")
    for group in (4096, 8):
        roots = {r.node: r.root for r in components(S.links(frame, group)).collect()}
        got = [roots.get(c, c) for c in signed]
        assert len(set(got)) == len(set(want)) == len(set(zip(got, want, strict=True)))


def test_components_of_chains_and_hubs(spark):
    pairs = [(k, k + 1) for k in range(0, 60)] + [(100, k) for k in range(101, 180)] + [(7, 7), (None, 3), (200, 201), (201, 200)]
    got = {(r.node, r.root) for r in components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    assert got == {(k, 0) for k in range(61)} | {(k, 100) for k in range(100, 180)} | {(200, 200), (201, 200)}


def test_spanning_within_groups():
    rng = random.Random(9)
    codes = clustered(rng, 300)
    starts = np.array([0, 3, 4, 150])
    root = S.spanning(np.array(codes, np.uint64), starts)
    for a, b in zip(starts, [*starts[1:], 300], strict=True):
        want = plain_components(codes[a:b])
        got = root[a:b].tolist()
        assert len(set(got)) == len(set(want)) == len(set(zip(got, want, strict=True)))


def test_rows(spark):
    base = " ".join(f"w{k}" for k in range(400))
    rows = [(5, base), (3, base), (3, base), (9, base + " end"), (None, base), (None, None), (None, ""), (8, "other words here " * 9), (1, "Ö"), (2, None)]
    docs = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, fp int").repartition(4)
    got = sorted(((r.doc_id, r.fp & (2**64 - 1), r.component_id) for r in S.near_duplicates(docs).collect()), key=repr)
    prints = [plain_fingerprint(t) for _, t in rows]
    want = plain_components(prints)
    least = {c: min((d for (d, _), w in zip(rows, want, strict=True) if w == c and d is not None), default=None) for c in want}
    assert got == sorted(((d, p, least[c]) for (d, _), p, c in zip(rows, prints, want, strict=True)), key=repr)
    assert S.near_duplicates(docs.where(F.lit(False))).collect() == []
