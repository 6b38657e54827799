"""Files and tables."""

import json

import pytest
from pyspark.sql import functions as F

from riskflow import schemas
from riskflow.session import rows_per_task, shared_folder
from riskflow.sources import files, tables
from riskflow.sources import ids as I
from riskflow.sources.tables import Batch

from .conftest import at, table


def test_requests_keep_corrupt_lines(spark, tmp_path):
    (tmp_path / "r.json").write_text('{"userId":"u","amount":1.5,"unknown":1}\nnot json\n')
    got = files.read_requests(spark, str(tmp_path), "webhook").cache()
    assert {(r.userId, r._corrupt_record, r.channel) for r in got.collect()} == {("u", None, "webhook"), (None, "not json", "webhook")}


def test_records_round_trip(spark, tmp_path):
    fraud = spark.createDataFrame([("e", at(3, 7), "t", None, "u", 85, ["A", "B"], "v1.0.0")], schemas.FRAUD_EVENT)
    records = files.as_records(fraud)
    assert records.first().key == "t"
    full = records.withColumns({"topic": F.lit("fraud.detected"), "partition": F.lit(2), "offset": F.lit(11)})
    files.write_records(full, path=str(tmp_path / "r"))
    got = files.read_fraud_events(spark, path=str(tmp_path / "r"), streaming=False).first()
    assert (got.event_id, got.reasons, got.seq, got.partition) == ("e", ["A", "B"], 11 * files.MAX_PARTITIONS + 2, 2)
    assert got.occurred_at.microsecond == 7
    assert files.read_dlq(spark, path=str(tmp_path / "r"), streaming=False).count() == 1


def test_samples_logs_spans(spark, tmp_path):
    sample = spark.createDataFrame([(at(0), "c", {"a": "b"}, 1.0)], schemas.SAMPLE)
    sample.write.parquet(str(tmp_path / "s"))
    assert files.read_samples(spark, str(tmp_path / "s")).first().labels == {"a": "b"}
    (tmp_path / "l.json").write_text(json.dumps({"ts": "2024-01-01T00:00:00Z", "service": "x", "line": "{}"}))
    assert files.read_logs(spark, str(tmp_path / "l.json")).first().service == "x"
    spans = spark.createDataFrame([("t", "s", None, "x", "n", "SERVER", "", at(0), 1.0)], schemas.SPAN)
    spans.write.parquet(str(tmp_path / "p"))
    assert files.read_spans(spark, str(tmp_path / "p")).count() == 1


def history(spark, *rows):
    data = [(t, f"e-{t}", "u", None, "USD", "m", "US", at(s), i) for i, (t, s) in enumerate(rows)]
    return spark.createDataFrame(data, schemas.HISTORY)


def test_history_keeps_one_row_per_transaction(spark, tmp_path):
    path = str(tmp_path / "h")
    tables.append_history(history(spark, ("t1", 0), ("t1", 0), ("t2", 5)), path, Batch("w", 0))
    tables.append_history(history(spark, ("t2", 5), ("t3", 90_000)), path, Batch("w", 1))
    tables.append_history(history(spark, ("t2", 5), ("t3", 90_000)), path, Batch("w", 1))  # the batch is repeated
    read = tables.read_table(spark, path, schemas.HISTORY)
    assert table(read, "transaction_id", "batch_id") == [("t1", 0), ("t2", 0), ("t3", 1)]
    assert len(tables._days(spark, path, at(86_400).date(), None)) == 1  # other days are not even listed
    plan = read.filter(F.col("day") > F.lit(at(0).date()))._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull(day" in plan


def test_expired_table(spark, tmp_path):
    path, target = str(tmp_path / "h"), str(tmp_path / "kept")
    tables.append_history(history(spark, ("old", 0), ("edge", 100), ("new", 90_000)), path, Batch("w", 0))
    tables.expire_table(spark, path, schemas.HISTORY, "occurred_at", at(100), target)
    assert table(tables.read_table(spark, target, schemas.HISTORY), "transaction_id") == [("edge",), ("new",)]


def test_a_repeated_batch_replaces_rows_of_other_days(spark, tmp_path):
    path = str(tmp_path / "t")
    day = lambda *rows: spark.createDataFrame([(i, at(s)) for i, s in rows], "event_id string, processed_at timestamp")
    for batch, rows in ((0, [("a", 0)]), (1, [("b", 0), ("c", 90_000)]), (1, [("b", 200_000)])):
        tables.put_batch(day(*rows), path, Batch("w", batch), F.col("processed_at"))
    assert table(tables.read_table(spark, path, schemas.PROCESSED), "event_id", "batch_id") == [("a", 0), ("b", 1)]


def test_a_batch_repeated_after_compaction(spark, tmp_path):
    path, small = str(tmp_path / "h"), str(tmp_path / "small")
    tables.append_history(history(spark, ("t1", 0), ("t2", 5)), path, Batch("w", 0))
    tables.append_history(history(spark, ("t3", 0), ("t4", 0)), path, Batch("w", 1))
    tables.append_history(history(spark, ("t5", 0)), path, Batch("v", 1))
    tables.compact_table(spark, path, schemas.HISTORY, at(10**9).date(), small)
    mine = lambda: table(tables.read_table(spark, small, schemas.HISTORY, before=Batch("w", 1)), "transaction_id")
    assert mine() == [("t1",), ("t2",), ("t5",)]
    # the batch comes again: its own rows don't count against it, others do
    tables.append_history(history(spark, ("t3", 0), ("t2", 5), ("t6", 7)), small, Batch("w", 1))
    assert table(tables.read_table(spark, small, schemas.HISTORY), "transaction_id") == [("t1",), ("t2",), ("t3",), ("t5",), ("t6",)]
    # and once more into one
    again = str(tmp_path / "again")
    tables.compact_table(spark, small, schemas.HISTORY, at(10**9).date(), again)
    assert table(tables.read_table(spark, again, schemas.HISTORY), "transaction_id", "writer") == [(f"t{k}", "compacted") for k in (1, 2, 3, 5, 6)]


def test_expiry_in_place(spark, tmp_path):
    path = str(tmp_path / "m")
    rows = lambda *r: spark.createDataFrame(list(r), "event_id string, processed_at timestamp")
    tables.put_batch(rows(("a", at(0)), ("b", at(86_400)), ("c", at(86_500)), ("none", None)), path, Batch("w", 0), F.col("processed_at"))
    tables.put_batch(rows(("d", at(86_401)), ("e", at(90_000))), path, Batch("w", 1), F.col("processed_at"))
    tables.put_batch(rows(("f", at(86_402)), ("g", at(300_000))), path, Batch("w", 2), F.col("processed_at"))
    before = {f: f.stat().st_mtime_ns for f in (tmp_path / "m").rglob("*.parquet") if "day=2024-01-02" not in str(f)}
    tables.expire_days(spark, path, schemas.PROCESSED, "processed_at", at(86_450))
    # f is in the newest batch, which may be written again: it goes next time
    assert table(tables.read_table(spark, path, schemas.PROCESSED), "event_id") == [(x,) for x in ("c", "e", "f", "g", "none")]
    assert not (tmp_path / "m" / "day=2024-01-01").exists()
    assert all(f.stat().st_mtime_ns == t for f, t in before.items() if "day=2024-01-01" not in str(f))


def ids(spark, *names):
    return spark.createDataFrame([(n,) for n in names], "id string")


@pytest.mark.parametrize("bits", [24, 1])
def test_index_of_ids_is_exact(spark, tmp_path, monkeypatch, bits):
    """Also where filters say yes to nearly everything."""
    monkeypatch.setattr(I, "BITS", bits)
    monkeypatch.setattr(I, "FULL", 20)
    index = I.IdIndex(spark, str(tmp_path / "i"))
    assert index.stored(ids(spark, "x0"), Batch("w", 0)).collect() == []
    for n in range(4):
        index.put(ids(spark, *(f"x{k}" for k in range(n * 100, n * 100 + 100)), None), Batch("w", n))
    index.put(ids(spark, "y"), Batch("v", 0))
    index.put(ids(spark, "z"), Batch("v", 0))  # repeated with other rows
    asked = ids(spark, "x5", "x5", "x150", "x399", "y", "z", "new", None)
    for _ in range(2):
        assert table(index.stored(asked)) == [("x150",), ("x399",), ("x5",), ("z",)]
        assert table(index.stored(asked, Batch("w", 1))) == [("x5",), ("z",)]
        assert table(index.stored(asked, Batch("v", 0))) == [("x150",), ("x399",), ("x5",)]
        index.compact()
    number, buckets = index._generation()
    assert number == 3 and buckets == 32
    index.put(ids(spark, "x300", "late"), Batch("w", 3))  # the newest batch again
    assert table(index.stored(ids(spark, "x300", "x301", "late", "x299"))) == [("late",), ("x299",), ("x300",)]


def test_index_reads_what_may_hold_an_id(spark, tmp_path):
    index = I.IdIndex(spark, str(tmp_path / "i"))
    for n in range(6):
        index.put(spark.range(n * 2000, n * 2000 + 2000).select(F.concat(F.lit("t"), "id").alias("id")), Batch("w", n))
    fresh = spark.range(50_000, 52_000).select(F.concat(F.lit("t"), "id").alias("id"))
    # 2,000 new ids against six parts: 12,000 tests, with some 0.00005 false ones each
    assert index.candidates(fresh).count() <= 6
    near = index.candidates(ids(spark, "t5000"))
    assert near.count() <= 2 and near.filter("part = 'w-2'").count() == 1


def test_alert_and_transaction_tables(spark, tmp_path):
    alert = spark.createDataFrame([("a", "t", "u", 70, "X", at(0), "e", None)], schemas.ALERT)
    for _ in range(2):
        tables.append_alerts(alert, str(tmp_path / "a"), Batch("w", 4))
    assert tables.read_alerts(spark, str(tmp_path / "a")).count() == 1
    assert tables.read_alerts(spark, str(tmp_path / "a"), at(0), at(5)).count() == 1
    assert tables.read_alerts(spark, str(tmp_path / "a"), at(1), None).count() == 0
    tx = spark.createDataFrame([("t", "u", None, "USD", "m", "US", "CARD", at(0))], schemas.TRANSACTION)
    tables.append_transactions(tx, str(tmp_path / "t"), Batch("w", 0))
    assert (tmp_path / "t" / "day=2024-01-01" / "writer=w" / "batch_id=0").is_dir()


def test_settings(spark):
    assert rows_per_task(spark) == 4_000_000
    assert shared_folder(spark) == shared_folder(spark)


def test_filters_hold_their_ids_and_are_made_without_sending_words(spark):
    rows = spark.range(3000).selectExpr("concat('id-', id) as id", "cast(id % 3 as int) as bucket", "if(id % 2 = 0, 'a-1', 'b-2') as part").repartition("bucket", "part")
    made = I.filters(rows)
    assert made.groupBy("bucket", "part").count().filter("count = 1").count() == 6
    met = rows.join(made, ["bucket", "part"]).filter(I._held(F.col("id"), F.col("bits")))
    assert met.count() == 3000
    other = spark.range(3000, 6000).selectExpr("concat('id-', id) as id").crossJoin(made).filter(I._held(F.col("id"), F.col("bits")))
    assert other.count() < 100  # of 18,000
    plan = made._jdf.queryExecution().executedPlan().toString()
    assert "bit_or" not in plan and "Explode" not in plan and "explode" not in plan


def test_staged_rows_keep_their_columns_until_they_are_read(spark):
    parts = [spark.createDataFrame([(k, None, [f"x{k}"])], "a int, b void, c array<string>") for k in range(3)]
    with tables.staged(*parts) as held:
        assert held.columns == ["a", "b", "c"] and held.schema["b"].dataType.simpleString() == "void"
        assert table(held) == [(k, None, [f"x{k}"]) for k in range(3)]
        files = held.inputFiles()
        assert files
    with pytest.raises(Exception, match="(?i)not.*exist|not_exist|not found"):
        spark.read.parquet(files[0])
    with tables.staged(parts[0].limit(0)) as none:
        assert none.count() == 0 and none.columns == ["a", "b", "c"]
