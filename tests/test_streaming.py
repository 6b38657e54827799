"""Streaming jobs over files, one file per micro-batch, compared with batch results and a replay."""

import json
import random
from datetime import timedelta
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from riskflow import schemas
from riskflow.functions import mapping
from riskflow.operators import rules
from riskflow.operators.alerts import Channels
from riskflow.session import shared_folder
from riskflow.sources import files, tables
from riskflow.sources.tables import Batch
from riskflow.streaming import jobs

from .conftest import at, table
from .test_scoring import random_rows, replay


def event(i, row):
    user, t, amount, merchant, country = row
    body = {"eventId": f"e{i}", "occurredAt": t.strftime("%Y-%m-%dT%H:%M:%S.%fZ"), "transactionId": f"t{i}", "userId": user,
            "amount": amount, "currency": "USD", "merchantId": merchant or "none", "country": country or "XX", "paymentMethod": "CARD"}
    return {"key": f"t{i}", "value": json.dumps(body), "topic": "transactions.created", "partition": 0, "offset": i}


def drop(folder, name, records):
    folder.mkdir(exist_ok=True)
    (folder / f"{name}.json").write_text("\n".join(map(json.dumps, records)) + "\n")
    import os

    order = len(list(folder.iterdir()))
    os.utime(folder / f"{name}.json", (1_700_000_000 + order, 1_700_000_000 + order))


@pytest.fixture(scope="module")
def arrivals():
    """Batches that overlap in time: late events reach a user's history."""
    rows = [(u, t, a, m or "none", c or "XX") for u, t, a, m, c in random_rows(8, 300)]
    return rows, [(0, 120), (120, 130), (130, 300)]


def source(spark, folder):
    return files.read_events(spark, path=str(folder), maxFilesPerTrigger=1)


def want(rows, batches):
    order = []
    for lo, hi in batches:
        order += sorted(((*rows[i], i) for i in range(lo, hi)), key=lambda r: (r[1], r[5]))
    return replay(order)


def test_stream_scores_like_a_replay_and_survives_restarts(spark, tmp_path, arrivals):
    rows, batches = arrivals
    inbox = tmp_path / "in"
    folders = [str(tmp_path / n) for n in ("history", "decisions", "checkpoint")]
    published = []
    tombstone = event(998, rows[0]) | {"value": None}
    poison = event(999, rows[0]) | {"value": json.dumps({"transactionId": "bad", "userId": "u"})}
    for n, (lo, hi) in enumerate(batches):
        again = [event(i, rows[i]) | {"offset": 5000 + i} for i in range(0, lo, 7)]  # redelivered later
        drop(inbox, f"b{n}", [event(i, rows[i]) for i in range(lo, hi)] + again + ([poison, tombstone] if n == 1 else []))
        if n != 0:  # the first two files are two batches of one run
            jobs.score_stream(
                source(spark, inbox), *folders, dlq_path=str(tmp_path / "dlq"),
                publish=lambda ev, b: published.extend(r.transactionId for r in ev.collect()),
            ).awaitTermination()
    done = spark.read.parquet(folders[1])
    got = {int(r.event_id[1:]): (r.prior_count, r.risk_score, r.fraudulent, r.reasons) for r in done.collect()}
    assert done.count() == 300 and got == want(rows, batches)
    assert sorted(published) == sorted(f"t{i}" for i, r in got.items() if r[2])
    dead = spark.read.json(str(tmp_path / "dlq"))
    assert table(dead, "topic", "key", "error_code", "offset") == [("transactions.created.dlq", "t999", "NULL_EVENT_ID", 999)]
    assert spark.read.parquet(str(tmp_path / "dlq-tombstones")).agg(F.sum("tombstones")).first()[0] == 1
    assert tables.read_table(spark, folders[0], schemas.HISTORY).count() == 300


def uncommitted(checkpoint):
    """As after a stop between a batch's outputs and its commit: the batch is repeated."""
    for name in (checkpoint / "commits").iterdir():
        name.unlink()


def test_repeated_batch_and_other_stream_change_nothing(spark, tmp_path, arrivals):
    rows, _ = arrivals
    inbox = tmp_path / "in"
    drop(inbox, "b0", [event(i, rows[i]) for i in range(100)])
    folders = [str(tmp_path / n) for n in ("history", "decisions")]
    for name in ("c0", "c0", "c1"):  # repeated, then a stream of its own over the same events
        jobs.score_stream(source(spark, inbox), *folders, str(tmp_path / name), dlq_path=str(tmp_path / "dlq")).awaitTermination()
        if name == "c0":
            uncommitted(tmp_path / "c0")
    assert spark.read.parquet(folders[1]).count() == 100
    assert tables.read_table(spark, folders[0], schemas.HISTORY).count() == 100


def test_one_effect_per_event_and_transaction(spark, tmp_path, arrivals):
    rows, _ = arrivals
    inbox, published = tmp_path / "in", []
    untimed = lambda e: e | {"value": json.dumps({k: v for k, v in json.loads(e["value"]).items() if k != "occurredAt"})}
    other = event(7, rows[7]) | {"offset": 901, "value": event(7, rows[7])["value"].replace('"e7"', '"e901"')}
    within = event(40, rows[40]) | {"offset": 902, "value": event(40, rows[40])["value"].replace('"e40"', '"e902"')}
    drop(inbox, "b0", [untimed(event(i, rows[i])) for i in range(5)] + [event(i, rows[i]) for i in range(5, 20)])
    drop(inbox, "b1", [untimed(event(i, rows[i]) | {"offset": 500 + i}) for i in range(5)] + [event(40, rows[40]), other, within])
    jobs.score_stream(source(spark, inbox), str(tmp_path / "h"), str(tmp_path / "d"), str(tmp_path / "c"), dlq_path=str(tmp_path / "dlq"),
                      config=rules.RuleConfig(), publish=lambda ev, b: published.extend(r.transactionId for r in ev.collect())).awaitTermination()
    done = spark.read.parquet(str(tmp_path / "d"))
    assert sorted(r.event_id for r in done.collect()) == sorted(f"e{i}" for i in [*range(20), 40])
    assert len(published) == len(set(published))
    dead = files.read_dlq(spark, path=str(tmp_path / "dlq"), streaming=False)
    assert table(dead, "key", "offset") == [("t40", 902), ("t7", 901)]
    assert {r.error_code for r in spark.read.json(str(tmp_path / "dlq")).collect()} == {"DUPLICATE_TRANSACTION"}


def test_two_replays_keep_all_rows(spark, tmp_path, arrivals):
    """Each with its own checkpoint and the same name: their batches have the same numbers, not the same place."""
    rows, _ = arrivals
    paths = {n: str(tmp_path / n) for n in ("h", "d", "dlq")}
    work = lambda: jobs.scoring(paths["h"], paths["d"], "replay", dlq_path=paths["dlq"])
    for n, (lo, hi) in enumerate(((0, 5), (5, 12))):
        drop(tmp_path / f"in{n}", "b0", [event(i, rows[i]) for i in range(lo, hi)])
        letters = files.read_dlq(spark, path=str(tmp_path / f"in{n}"))
        jobs.reprocess_dlq(letters, work(), str(tmp_path / f"failed{n}"), str(tmp_path / f"c{n}")).awaitTermination()
    assert sorted(int(r.event_id[1:]) for r in spark.read.parquet(paths["d"]).collect()) == list(range(12))
    assert tables.read_table(spark, paths["h"], schemas.HISTORY).count() == 12


def test_replay_fails_where_spark_does(spark, tmp_path, arrivals):
    """A letter isn't to blame for a failing store: the batch fails, and is repeated."""
    rows, _ = arrivals
    drop(tmp_path / "in", "b0", [event(i, rows[i]) for i in range(3)])

    def lost(ok, n):
        ok.sparkSession.read.parquet(str(tmp_path / "nowhere")).count()

    with pytest.raises(Exception, match="nowhere"):
        jobs.reprocess_dlq(files.read_dlq(spark, path=str(tmp_path / "in")), lost, str(tmp_path / "failed"), str(tmp_path / "c")).awaitTermination()
    assert not (tmp_path / "failed").exists()
    done = []
    jobs.reprocess_dlq(files.read_dlq(spark, path=str(tmp_path / "in")), lambda ok, n: done.append(ok.count()), str(tmp_path / "failed"), str(tmp_path / "c")).awaitTermination()
    assert done == [3]


def test_scorer_repeats_a_batch_after_compaction(spark, tmp_path, arrivals):
    rows, _ = arrivals
    inbox = tmp_path / "in"
    paths = {n: str(tmp_path / n) for n in ("h", "small", "d", "c", "dlq")}
    run = lambda history: jobs.score_stream(source(spark, inbox), history, paths["d"], paths["c"], dlq_path=paths["dlq"], markers_path=str(tmp_path / "m")).awaitTermination()
    drop(inbox, "b0", [event(i, rows[i]) for i in range(20)])
    run(paths["h"])
    drop(inbox, "b1", [event(i, rows[i]) for i in range(20, 30)])
    run(paths["h"])
    first = table(spark.read.parquet(paths["d"]), "event_id", "risk_score", "prior_count")
    tables.compact_table(spark, paths["h"], schemas.HISTORY, at(10**9).date(), paths["small"])
    for name in ("1", ".1.crc"):
        (tmp_path / "c" / "commits" / name).unlink()
    run(paths["small"])
    assert table(spark.read.parquet(paths["d"]), "event_id", "risk_score", "prior_count") == first
    assert tables.read_table(spark, paths["small"], schemas.HISTORY).count() == 30
    assert files.read_dlq(spark, path=paths["dlq"], streaming=False).count() == 0


def test_dead_letters_return_to_the_scorer(spark, tmp_path, arrivals):
    """Letters of one stream are read back and scored by the scorer's own work, on the same history."""
    rows, _ = arrivals
    inbox = tmp_path / "in"
    long = event(3, rows[3]) | {"value": event(3, rows[3])["value"].replace('"USD"', '"USDX"')}
    drop(inbox, "b0", [event(i, rows[i]) for i in range(3)] + [long])
    paths = {n: str(tmp_path / n) for n in ("h", "d", "c", "dlq", "c2", "failed")}
    jobs.score_stream(source(spark, inbox), paths["h"], paths["d"], paths["c"], dlq_path=paths["dlq"]).awaitTermination()
    letters = files.read_dlq(spark, path=paths["dlq"])
    mended = letters.withColumn("value", F.replace("value", F.lit("USDX"), F.lit("USD")))
    work = jobs.scoring(paths["h"], paths["d"], "replay", dlq_path=str(tmp_path / "dlq2"))
    jobs.reprocess_dlq(mended, work, paths["failed"], paths["c2"]).awaitTermination()
    assert sorted(r.event_id for r in spark.read.parquet(paths["d"]).collect()) == ["e0", "e1", "e2", "e3"]
    assert tables.read_table(spark, paths["h"], schemas.HISTORY).count() == 4

    def fails(ok, n):
        raise OSError("store is down")

    jobs.reprocess_dlq(mended, fails, str(tmp_path / "failed2"), str(tmp_path / "c3")).awaitTermination()
    assert table(spark.read.parquet(str(tmp_path / "failed2")), "key", "error_code") == [("t3", "OSError")]


def test_streams_share_a_table(spark, tmp_path):
    """Two channels and a stream with a new checkpoint write into one table."""
    good = {"userId": "u", "amount": 12.5, "currency": "USD", "merchantId": "m", "country": "US", "paymentMethod": "CARD"}
    for channel, n in (("api", 3), ("webhook", 2)):
        (tmp_path / channel).mkdir()
        (tmp_path / channel / "r.json").write_text("\n".join(json.dumps(good | {"userId": f"{channel}{k}"}) for k in range(n)) + "\n")
    paths = [str(tmp_path / n) for n in ("tx", "rejected")]
    for channel, checkpoint in (("api", "c1"), ("webhook", "c2"), ("api", "c3")):
        requests = files.read_requests(spark, str(tmp_path / channel), channel, streaming=True)
        jobs.ingest_stream(requests, paths[0], str(tmp_path / checkpoint), lambda e, n: None, paths[1]).awaitTermination()
    stored = tables.read_table(spark, paths[0], schemas.TRANSACTION)
    assert sorted(r.user_id for r in stored.collect()) == ["api0", "api0", "api1", "api1", "api2", "api2", "webhook0", "webhook1"]
    tables.compact_table(spark, paths[0], schemas.TRANSACTION, at(10**9).date(), str(tmp_path / "small"))
    small = tables.read_table(spark, str(tmp_path / "small"), schemas.TRANSACTION)
    assert table(small, "id") == table(stored, "id") and {r.writer for r in small.collect()} == {"compacted"}


def test_dedup_stream(spark, tmp_path, arrivals):
    rows, _ = arrivals
    inbox = tmp_path / "in"
    drop(inbox, "b0", [event(i, rows[i]) for i in range(40)])
    drop(inbox, "b1", [event(i, rows[i]) for i in range(30, 60)])
    query = (jobs.dedup_stream(source(spark, inbox)).writeStream.format("parquet").option("path", str(tmp_path / "out"))
             .option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start())
    query.awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).count() == 60


def fraud_record(i, **fields):
    body = {"eventId": f"f{i}", "occurredAt": "2024-01-01T00:00:01.000000Z", "transactionId": f"t{i}", "userId": "u", "riskScore": 85,
            "reasons": ["HIGH_AMOUNT", "HIGH_RISK_MERCHANT"], "ruleVersion": "v1.0.0"} | fields
    return {"key": f"t{i}", "value": json.dumps(body), "topic": "fraud.detected", "partition": 0, "offset": i}


def test_alert_stream(spark, tmp_path):
    inbox = tmp_path / "in"
    drop(inbox, "b0", [fraud_record(1), fraud_record(2, reasons=[]), fraud_record(1) | {"offset": 9}, fraud_record(3, eventId=None)])
    drop(inbox, "b1", [fraud_record(2), fraud_record(4, userId=None)])
    events = files.read_fraud_events(spark, path=str(inbox), maxFilesPerTrigger=1)
    channels = Channels(email_enabled=True, email_to=("a@b",))
    jobs.alert_stream(events, str(tmp_path / "alerts"), str(tmp_path / "c"), channels, str(tmp_path / "sent"), dlq_path=str(tmp_path / "dlq")).awaitTermination()
    alerts = tables.read_alerts(spark, str(tmp_path / "alerts"))
    assert table(alerts, "source_event_id", "reasons") == [("f1", "HIGH_AMOUNT,HIGH_RISK_MERCHANT"), ("f2", "UNSPECIFIED_RULE")]
    assert spark.read.parquet(str(tmp_path / "sent")).count() == 4
    assert table(spark.read.json(str(tmp_path / "dlq")), "error_code") == [("NULL_EVENT_ID",), ("NULL_USER_ID",)]


def test_dead_letters_are_reprocessed_once(spark, tmp_path, arrivals):
    rows, _ = arrivals
    inbox = tmp_path / "in"
    good = event(1, rows[1])
    bad = event(2, rows[2]) | {"value": json.dumps({"transactionId": "t2"})}
    empty = event(3, rows[3]) | {"value": None}
    drop(inbox, "b0", [good, bad, empty])
    seen = []
    letters = files.read_dlq(spark, path=str(inbox))
    run = jobs.reprocess_dlq(letters, lambda ok, n: seen.extend(r.event_id for r in ok.collect()), str(tmp_path / "failed"),
                             str(tmp_path / "c"), counts_path=str(tmp_path / "counts"))
    run.awaitTermination()
    assert seen == ["e1"]
    assert table(spark.read.parquet(str(tmp_path / "failed")), "key", "error_code") == [("t2", "NULL_EVENT_ID"), ("t3", "EMPTY_EVENT_PAYLOAD")]
    assert table(spark.read.parquet(str(tmp_path / "counts")), "received", "reprocessed", "failed") == [(3, 1, 2)]


def test_requests_become_keyed_records(spark, tmp_path):
    inbox, out = tmp_path / "in", tmp_path / "out"
    inbox.mkdir()
    (inbox / "r.json").write_text('{"userId":"u","amount":12.5,"currency":"USD","merchantId":"m","country":"US","paymentMethod":"CARD"}\n')
    stream = files.read_requests(spark, str(inbox), "api", streaming=True)
    events = mapping.to_created_events(stream.withColumns({"request_id": F.col("userId"), "created_at": F.lit(at(0))}))
    files.write_events(events, str(tmp_path / "c"), path=str(out)).awaitTermination()
    got = spark.read.json(str(out)).first()
    assert json.loads(got.value)["transactionId"] == got.key and json.loads(got.value)["userId"] == "u"


def test_windowed_alert_counts(spark, tmp_path):
    rows = [(f"a{i}", "t", "u", 70, "X", at(s), "e", None) for i, s in enumerate((0, 10, 70, 8000))]
    spark.createDataFrame(rows, schemas.ALERT).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schemas.ALERT).parquet(str(tmp_path / "in"))
    query = (jobs.alert_windows(stream).writeStream.format("parquet").option("path", str(tmp_path / "out"))
             .option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start())
    query.awaitTermination()
    got = spark.read.parquet(str(tmp_path / "out"))
    assert table(got.select(F.minute("time"), "alerts")) == [(0, 2), (1, 1)]


def test_late_rows_are_kept_apart(spark):
    df = spark.createDataFrame([(at(0), 1), (at(7200), 2), (at(3599), 3), (at(3600), 4), (None, 5)], "ts timestamp, seq long")
    for limit in (None, 2):
        assert table(jobs.mark_late(df, "ts", "seq", limit=limit).filter("late"), "seq") == [(3,)]
    in_time, late = jobs.split_late(df, "ts", at(3600))
    assert (table(in_time, "seq"), table(late, "seq")) == ([(2,), (4,), (5,)], [(1,), (3,)])


def test_with_dlq(spark, tmp_path):
    df = spark.createDataFrame([("e1", "t1"), (None, "t2")], "event_id string, transaction_id string")
    got = []
    jobs.with_dlq(df, Batch("w", 0), F.when(F.col("event_id").isNull(), "NULL_EVENT_ID"), "x", lambda ok: got.extend(ok.collect()), str(tmp_path / "d"))
    assert [r.event_id for r in got] == ["e1"] and spark.read.json(str(tmp_path / "d")).first().topic == "x.dlq"


def test_ingest_stream(spark, tmp_path):
    inbox = tmp_path / "in"
    inbox.mkdir()
    good = {"userId": "u", "amount": 12.5, "currency": "USD", "merchantId": "m", "country": "US", "paymentMethod": "CARD"}
    bad = good | {"amount": -1}
    (inbox / "r.json").write_text("\n".join(map(json.dumps, [good, good, bad])) + "\n")
    paths = [str(tmp_path / n) for n in ("tx", "rejected")]
    for attempt in range(2):
        if attempt:
            uncommitted(tmp_path / "c")
        sent = []
        jobs.ingest_stream(
            files.read_requests(spark, str(inbox), "api", streaming=True), paths[0], str(tmp_path / "c"),
            lambda events, n: sent.extend((r.transactionId, r.occurredAt) for r in events.collect()), paths[1],
        ).awaitTermination()
    stored = tables.read_table(spark, paths[0], schemas.TRANSACTION)
    assert sorted(sent) == sorted((r.id, r.created_at) for r in stored.collect()) and len(set(sent)) == 2
    rejected = spark.read.parquet(paths[1])
    assert [json.loads(r.errors) for r in rejected.collect()] == [{"amount": "amount must be greater than zero"}]


def test_alert_stream_delivers(spark, tmp_path):
    inbox = tmp_path / "in"
    drop(inbox, "b0", [fraud_record(1), fraud_record(2)])

    def mail(alert):
        raise OSError("down")

    jobs.alert_stream(
        files.read_fraud_events(spark, path=str(inbox)), str(tmp_path / "alerts"), str(tmp_path / "c"),
        Channels(email_enabled=True, email_to=("a@b",)), str(tmp_path / "sent"), dlq_path=str(tmp_path / "dlq"), senders={"log": lambda alert: None, "email": mail},
    ).awaitTermination()
    sent = spark.read.parquet(str(tmp_path / "sent")).groupBy("channel", "outcome").count()
    assert table(sent) == [("email", "failed", 2), ("log", "success", 2)]


def shuffled(spark):
    """Bytes of each shuffle file that this session keeps."""
    held = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    kept = [held.apply(i) for i in range(held.size())]
    return {f.getName(): f.length() for f in kept if f.getName().startswith("shuffle_")}


def test_payloads_stay_where_they_are_while_their_events_are_judged(spark, tmp_path):
    """The ids of a batch are sorted and sent, and the rows that are scored without their payload, however long that is."""
    rng, records = random.Random(3), []
    for i in range(400):
        record = event(i, (f"u{i % 9}", at(i), 5.0, "m", "US"))
        records.append(record | {"value": json.dumps(json.loads(record["value"]) | {"pad": rng.randbytes(4000).hex()})})
    drop(tmp_path / "in", "a", [*records, records[7] | {"offset": 5007}])
    before = shuffled(spark)
    jobs.score_stream(source(spark, tmp_path / "in"), *(str(tmp_path / n) for n in ("h", "d", "c")), dlq_path=str(tmp_path / "dlq")).awaitTermination()
    sent = sum(size for name, size in shuffled(spark).items() if name not in before)
    assert spark.read.parquet(str(tmp_path / "d")).count() == 400
    assert sent < 400 * 4000


def test_no_memory_holds_a_batch(spark, tmp_path):
    """Neither the events of a batch nor its decisions are cached while outputs read them; what lies in files meanwhile goes."""
    cached = lambda: set(spark.sparkContext._jsc.getPersistentRDDs())
    before, seen = cached(), []
    records = [event(i, (f"u{i % 3}", at(i), 20_000.0, "MRC-999", "US")) for i in range(30)]
    drop(tmp_path / "in", "a", [*records, records[3] | {"offset": 5003}, records[4] | {"value": None}, records[5] | {"value": "{}"}])
    jobs.score_stream(source(spark, tmp_path / "in"), *(str(tmp_path / n) for n in ("h", "d", "c")), dlq_path=str(tmp_path / "dlq"),
                      publish=lambda events, n: seen.append((cached() - before, events.count()))).awaitTermination()
    assert seen == [(set(), 30)]
    assert spark.read.parquet(str(tmp_path / "d")).count() == 30
    assert [r.error_code for r in spark.read.json(f"{tmp_path}/dlq").collect()] == ["NULL_EVENT_ID"]
    assert spark.read.parquet(f"{tmp_path}/dlq-tombstones").first().tombstones == 1
    fs, place = tables._hadoop(spark, f"{shared_folder(spark)}/staged")
    assert len(fs.listStatus(place)) == 0
