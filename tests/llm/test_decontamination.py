"""Hit words and items against a search of every window at every place."""

import hashlib
import random
import re

from pyspark.sql import functions as F

from riskflow.llm import decontamination as D

LOWER = {k: k + 32 for k in range(65, 91)}


def split(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER))


def plain(text, items):
    words, hit, ids = split(text), set(), set()
    for item_id, item in items:
        own = split(item)
        k = min(13, len(own))
        for s in range(len(own) - k + 1 if own else 0):
            for p in range(len(words) - k + 1):
                if words[p : p + k] == own[s : s + k]:
                    hit |= set(range(p, p + k))
                    ids |= {str(item_id)} - {"None"}
    n = len(words)
    return n, len(hit), len(ids), hashlib.sha256(",".join(sorted(ids)).encode()).hexdigest(), bool(hit) and 20 * len(hit) >= n


def test_documents(spark):
    rng = random.Random(11)
    word = lambda: rng.choice(["the", "of", "a", "É1", "é1", "Straße", "STRASSE", "K2", "K2", "x9", "tree", "river"])
    text = lambda n: rng.choice([" ", "-", ", "]).join(word() for _ in range(n))
    items = [(k, text(rng.randrange(13, 40))) for k in range(30)] + [(100, "only FIVE words right here"), (101, "pair up"), (102, "lonely"), (103, ""), (104, None), (9, "same id " * 7), (None, "no id at all but words " * 3), (105, "the " * 20), (106, text(13)), (106, text(13))]
    docs = []
    for _ in range(60):
        parts = [text(rng.randrange(30))]
        for _ in range(rng.randrange(3)):
            item = split(rng.choice(items)[1])
            k = rng.randrange(3)
            parts += [" ".join(item[k : k + rng.choice([12, 13, 14, 40])]).upper(), text(rng.randrange(60))]
        docs.append(" / ".join(parts))
    docs += ["", None, "...", "the " * 300, "lonely", "Pair up and only five words right here", "é1", text(4000) + items[0][1]]
    rows = [(k if k % 9 else None, t, "x") for k, t in enumerate(docs)] + [(1, docs[1], "y"), (1, docs[2], "y")]
    frame = spark.createDataFrame(rows, "doc_id long, text string, word string").repartition(4)
    bench = spark.createDataFrame([(*i, 1) for i in items], "item_id long, text string, n_hit int")
    got = {(r.key_id, r.key_hash): r for r in D.contamination(frame, bench).collect()}
    for r in D.common.keyed(frame).select("*", F.size(D.words(F.col("text"))).alias("n"), D.words(F.col("text")).alias("w")).collect():
        want = plain(r.text, items)
        assert r.w == split(r.text)
        one = got.get((r.key_id, r.key_hash))
        ids = one.item_ids if one else []
        assert (r.n, one.n_hit if one else 0, len(ids), hashlib.sha256(",".join(ids).encode()).hexdigest()) == want[:4], r.text


def test_empty_tables(spark):
    docs = spark.createDataFrame([(1, "a b c")], "doc_id long, text string")
    bench = spark.createDataFrame([(1, "a b c")], "item_id long, text string")
    assert D.contamination(docs.where("false"), bench).collect() == []
    assert D.contamination(docs, bench.where("false")).collect() == []
    assert [(r.n_hit, r.item_ids) for r in D.contamination(docs, bench).collect()] == [(3, ["1"])]


def test_shuffled_positions_leave_the_text_behind(spark, monkeypatch):
    monkeypatch.setattr(D, "BROADCAST", 0)
    key = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(key)
    spark.conf.set(key, "-1")
    try:
        test_documents(spark)
        docs = spark.createDataFrame([(1, "a b c d e f")], "doc_id long, text string")
        found = D.matches(docs, D.shingles(D.windows(spark.createDataFrame([(1, "b c d e"), (2, "f")], "item_id long, text string"))))
        assert sorted((r.position, r.shingle, r.n_words) for r in found.collect()) == [(1, "b c d", 6), (2, "c d e", 6), (5, "f", 6)]
        plan = found._jdf.queryExecution().explainString(spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
        sent = re.findall(r"Exchange\nInput \[\d+\]: \[(.*?)\]", plan)
        assert any("position#" in x for x in sent)
        assert not any(re.search(r"\bwords#", x) for x in sent), sent
    finally:
        spark.conf.set(key, before)


def test_shuffled_shingles(spark, monkeypatch):
    monkeypatch.setattr(D, "BROADCAST", 0)
    test_empty_tables(spark)
