"""Scans that split large keys give what plain windows give."""

import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from riskflow.operators import ordered
from riskflow.operators.ordered import Running

from .conftest import at, table


@pytest.fixture(scope="module")
def rows(spark):
    rnd = random.Random(5)
    data = []
    for seq in range(1200):
        # one key holds more than a third of the rows, and most of its rows share one time
        key = "hot" if rnd.random() < 0.6 else rnd.choice(["a", "b", "c", None])
        ts = 50 if key == "hot" and rnd.random() < 0.7 else rnd.randrange(100)
        data.append((key, ts, seq, rnd.choice([None, rnd.randrange(50)])))
    return spark.createDataFrame(data, "key string, ts long, seq long, v long").repartition(5).cache()




def expected(rows):
    w = Window.partitionBy("key").orderBy("ts", "seq")
    before, upto = w.rowsBetween(Window.unboundedPreceding, -1), w.rowsBetween(Window.unboundedPreceding, 0)
    return rows.select(
        "seq", F.sum("v").over(before).alias("s"), F.max(F.struct("v", "seq")).over(before).alias("m"),
        F.min("v").over(upto).alias("lo"), F.last("v", True).over(before).alias("l"), F.row_number().over(w).alias("n"),
    )


@pytest.mark.parametrize("limit", [20, 150, 1_000_000])
def test_prefix_matches_plain_windows(rows, limit):
    values = [
        Running("s", "sum", F.col("v")), Running("m", "max", F.struct("v", "seq")), Running("lo", "min", F.col("v"), True),
        Running("l", "last", F.col("v")), Running("n", "sum", F.lit(1), True),
    ]
    done = ordered.prefix(rows, ["key"], ["ts", "seq"], values, limit=limit)
    assert done.columns == [*rows.columns, "s", "m", "lo", "l", "n"]
    assert table(done, "seq", "s", "m", "lo", "l", "n") == table(expected(rows))


def test_large_key_is_cut_into_bounded_chunks(rows):
    cuts = ordered.cut_points(rows, ["key"], ["ts", "seq"], 50)
    sizes = ordered.with_chunk(rows, ["key"], ["ts", "seq"], cuts).groupBy("key", "_chunk").count().collect()
    assert max(r["count"] for r in sizes) <= 150
    assert sum(r["count"] for r in sizes) == 1200
    assert len([r for r in sizes if r["key"] == "hot"]) >= 8


def test_small_keys_are_not_cut(rows):
    assert ordered.cut_points(rows, ["key"], ["ts", "seq"], 10_000) is None


def test_proven_bound_skips_the_size_check(rows, monkeypatch):
    monkeypatch.setattr(ordered, "cut_points", lambda *a: pytest.fail("size check ran"))
    ordered.prefix(rows, ["key"], ["ts", "seq"], [Running("n", "sum", F.lit(1))], limit=5000, bound=1200)


def test_no_key_is_one_sequence(rows):
    done = ordered.numbered(rows, [], ["seq"], limit=100)
    assert [r[1] for r in sorted(map(tuple, done.select("seq", "n").collect()))] == list(range(1, 1201))


def test_empty_input(rows):
    done = ordered.numbered(rows.filter("seq < 0"), ["key"], ["ts", "seq"])
    assert done.collect() == []


def test_first_arrival_keeps_whole_rows(spark):
    df = spark.createDataFrame([("a", 2, "late"), ("a", 1, None), ("b", 5, "only")], "id string, seq long, v string")
    assert table(ordered.first_arrival(df, ["id"], "seq")) == [("a", 1, None), ("b", 5, "only")]


def test_latest_per_key_and_last_samples(spark):
    df = spark.createDataFrame([("a", at(1), 1), ("a", at(5), 2), ("a", at(5), 3), ("b", at(2), 4)], "k string, ts timestamp, seq long")
    assert table(ordered.latest_per_key(df, ["k"], "ts", "seq"), "k", "seq") == [("a", 3), ("b", 4)]
    kept = ordered.last_samples(df.filter("seq <> 3"), ["k"], "ts", 1)
    assert table(kept, "k", "seq") == [("a", 2), ("b", 4)]


def test_latest_arrived_follows_arrival_not_time(spark):
    df = spark.createDataFrame([("u", at(10), 1, "X"), ("u", at(5), 2, "Y"), ("u", at(20), 3, "Z")], "k string, ts timestamp, seq long, c string")
    done = ordered.latest_arrived(df, ["k"], "ts", "seq", ["c"])
    assert table(done, "seq", "prev_c") == [(1, None), (2, "X"), (3, "X")]


def test_first_rows_are_limited_before_the_shuffle(rows):
    done = ordered.first_rows(rows, ["key"], [F.col("ts").desc(), "seq"], 3)
    plan = done._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") == 2  # in every task, and again after the shuffle
    assert done.count() == 15


def test_chunks_are_searched_as_deep_as_there_are_cuts(spark, monkeypatch):
    """And no deeper: the search is made for every row."""
    monkeypatch.setattr(ordered, "MAX_CHUNKS", 1)
    cuts = spark.sql("select 1 as _k_k, transform(sequence(10, 120, 10), x -> named_struct('seq', int(x))) as _cuts")
    df = spark.sql("select k, int(seq) as seq from values (1, 5), (1, 10), (1, 11), (1, 75), (1, 121), (2, 75) as t(k, seq)")
    assert table(ordered.with_chunk(df, ["k"], ["seq"], cuts)) == [(1, 10, 0), (1, 11, 1), (1, 121, 12), (1, 5, 0), (1, 75, 7), (2, 75, 0)]
