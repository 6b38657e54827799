"""Shards against their definition, and against the SQL."""

import duckdb
import pandas as pd
from pyspark.sql import functions as F

from riskflow.llm import common, sharding as S


def test_documents_of_many_sizes(spark):
    rows = [(k, "x" * (k * 37 % 501), "s") for k in range(500)] + [(None, "n" * 300, "s"), (7, None, "s"), (9, "", "s"), (600, "y" * 5000, "s"), (3, "again", "s")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, shard string").repartition(4)
    placed, found = S.assigned(docs, 2000)
    got = sorted(((r.row.doc_id, r.shard, r.depth) for r in placed.collect()), key=repr)
    table = pd.DataFrame([(d, t) for d, t, _ in rows if d != 600], columns=["doc_id", "text"]).astype({"doc_id": "Int64"})
    con = duckdb.connect()
    con.register("documents", table)
    want = con.sql(S.sql(2000)).fetchall()
    sizes = {r.shard: (r.bytes, r.docs) for r in found.collect()}
    assert sum(n for _, n in sizes.values()) == len(rows) and sum(b for b, _ in sizes.values()) == sum(len(t or "") for _, t, _ in rows)
    big = [r for r in got if r[0] == 600]
    assert len(big) == 1 and sizes[big[0][1]][1] == 1
    near = {w[1] for w in want if not big[0][1].startswith(w[1])}
    assert {(d, s, k) for d, s, k, _, _ in want if s in near} == {r for r in got if r[1] in near}
    assert all(b <= 2000 or s == big[0][1] for s, (b, _) in sizes.items())
    shards = sorted(sizes)
    assert not any(b.startswith(a) for a, b in zip(shards, shards[1:], strict=False))
    folder = common.new_folder(spark, "shards")
    S.write(placed, folder)
    assert spark.read.parquet(folder).count() == len(rows)


def test_the_directory_finds_the_same_shards(spark, monkeypatch):
    docs = spark.createDataFrame([(k, "x" * (k * 37 % 501)) for k in range(300)], "doc_id long, text string").repartition(3)
    broadcast = sorted((r.row.doc_id, r.shard, r.depth) for r in S.assigned(docs, 4000)[0].collect())
    monkeypatch.setattr(S, "DIRECTORY_BITS", -1)
    joined = sorted((r.row.doc_id, r.shard, r.depth) for r in S.assigned(docs, 4000)[0].collect())
    assert broadcast == joined and len(broadcast) == 300 and len({s for _, s, _ in broadcast}) > 8


def test_an_id_above_the_limit(spark):
    docs = spark.createDataFrame([(1, "z" * 100)] * 60 + [(2, "z")], "doc_id long, text string").repartition(3)
    placed, found = S.assigned(docs, 1000)
    assert all(r.bytes <= 1000 for r in found.collect()) and sum(r.docs for r in found.collect()) == 61
    assert placed.count() == 61 and placed.groupBy("shard").agg(F.sum(F.octet_length("row.text")).alias("n")).where("n > 1000").count() == 0


def test_empty_table(spark):
    placed, found = S.assigned(spark.createDataFrame([], "doc_id long, text string"), 1000)
    assert placed.collect() == [] and found.collect() == []
