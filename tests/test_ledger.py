"""Ledgers of what is sent: each attempt once, whatever is repeated."""

import json
from datetime import timedelta

import pytest
from pyspark.sql import functions as F

from riskflow import schemas
from riskflow.operators import outbox
from riskflow.operators.alerts import Channels
from riskflow.sources import tables
from riskflow.sources.tables import Batch
from riskflow.streaming import ledger as L

from .conftest import at, table


def rows(spark, n=6):
    events = spark.createDataFrame([(f"e{k}", at(k), f"t{k}", None, f"u{k}", None, "USD", "m", "US", "CARD") for k in range(n)], schemas.CREATED_EVENT)
    return outbox.enqueue(events, "transactions.created")


def sender(path, fails=lambda row: False):
    """Notes what it is given, then fails or not."""

    def send(row):
        with open(path, "a") as out:
            out.write(json.dumps([row["event_id"], row["attempt"]]) + "\n")
        if fails(row):
            raise OSError("down")

    return send


def sent(path):
    return sorted((e, a) for e, a in map(json.loads, path.read_text().splitlines())) if path.exists() else []


@pytest.fixture
def place(spark, tmp_path):
    tables.put_batch(rows(spark), str(tmp_path / "outbox"), Batch("app", 0), F.col("created_at"))
    return str(tmp_path / "outbox"), L.Ledger(spark, str(tmp_path / "ledger")), tmp_path / "sent"


def test_failures_are_retried_when_due(spark, place):
    path, book, log = place
    send = sender(log, lambda row: row["event_id"] in ("e1", "e2") and row["attempt"] < 3)
    for number, seconds in enumerate((100, 101, 102, 103, 104, 200)):
        L.relay(spark, path, book, Batch("r", number), at(seconds), send)
    assert sent(log) == [("e0", 1), *((f"e{k}", a) for k in (1, 2) for a in (1, 2, 3)), ("e3", 1), ("e4", 1), ("e5", 1)]
    done = {r.event_id: r for r in L.relayed(rows(spark), book).collect()}
    assert all(r.status == "PUBLISHED" and r.last_error is None for r in done.values())
    assert done["e1"].attempts == 2 and done["e0"].attempts == 0 and done["e1"].published_at.timestamp() == at(104).timestamp()
    assert L.first_open_day(spark, path, book) is None


def test_rows_not_due_and_the_oldest_first(spark, place):
    path, book, log = place
    L.relay(spark, path, book, Batch("r", 0), at(3), sender(log), 2)
    assert sent(log) == [("e0", 1), ("e1", 1)]
    L.relay(spark, path, book, Batch("r", 1), at(3), sender(log))
    assert sent(log) == [(f"e{k}", 1) for k in range(4)]
    assert L.first_open_day(spark, path, book) == at(4).date()


def test_a_repeated_pass_sends_nothing_twice(spark, place):
    path, book, log = place
    for seconds in (2, 2, 50):  # later, more would be due
        L.relay(spark, path, book, Batch("r", 0), at(seconds), sender(log))
    assert sent(log) == [("e0", 1), ("e1", 1), ("e2", 1)]


def test_a_pass_that_stops_between_intents_and_outcomes(spark, place, monkeypatch):
    path, book, log = place
    put = tables.put_batch

    def stops(df, where, *rest):
        if where.endswith("outcomes"):
            raise KeyboardInterrupt
        put(df, where, *rest)

    monkeypatch.setattr(L.tables, "put_batch", stops)
    with pytest.raises(KeyboardInterrupt):
        L.relay(spark, path, book, Batch("r", 0), at(2), sender(log))
    monkeypatch.undo()
    assert sent(log) == []
    L.relay(spark, path, book, Batch("r", 0), at(90), sender(log))  # takes what it had taken before
    assert sent(log) == [("e0", 1), ("e1", 1), ("e2", 1)]
    # an attempt that was made but not noted comes again under the same number
    L.relay(spark, path, book, Batch("r", 1), at(90), sender(log))
    fs, lost = tables._hadoop(spark, f"{book.path}/outcomes/day=2024-01-01/writer=r/batch_id=1")
    fs.delete(lost, True)
    L.relay(spark, path, book, Batch("r", 1), at(95), sender(log))
    assert sent(log) == sorted([("e0", 1), ("e1", 1), ("e2", 1), *((f"e{k}", 1) for k in (3, 4, 5))] + [(f"e{k}", 1) for k in (3, 4, 5)])


def test_relays_share_the_keys(spark, place):
    path, book, log = place
    for k in range(3):
        L.relay(spark, path, book, Batch(f"r{k}", 0), at(90), sender(log), share=(k, 3))
    assert sent(log) == [(f"e{k}", 1) for k in range(6)]


def test_relay_stream(spark, place, tmp_path):
    path, book, log = place
    (tmp_path / "ticks").mkdir()
    for k in range(2):
        (tmp_path / "ticks" / f"{k}.json").write_text('{"t": 1}\n')
        ticks = spark.readStream.schema("t long").json(str(tmp_path / "ticks"))
        L.relay_stream(ticks, path, book.path, str(tmp_path / "c"), sender(log), trigger={"availableNow": True}).awaitTermination()
        for name in (tmp_path / "c" / "commits").iterdir():  # every batch comes again
            name.unlink()
    assert sent(log) == [(f"e{k}", 1) for k in range(6)]


def test_deliveries_are_bounded_and_grow_apart(spark, tmp_path):
    data = [(f"a{k}", f"t{k}", "u", 50 + 10 * k, "X", at(k), f"e{k}", None) for k in range(4)]
    alerts = spark.createDataFrame(data, schemas.ALERT)
    log = tmp_path / "sent"

    def mail(row):
        with open(log, "a") as out:
            out.write(f"{row['id']} {row['attempt']}\n")
        if row["risk_score"] >= 70:
            raise TimeoutError("busy")

    book = L.Ledger(spark, str(tmp_path / "l"), L.Policy(attempts=3, delay=timedelta(seconds=2), growth=2.0))
    channels = Channels(email_enabled=True, email_to=("x@example.org",))
    for number, seconds in ((0, 0), (0, 9), (1, 1), (2, 2), (3, 5), (4, 6), (5, 900)):
        L.notify(alerts, channels, {"log": lambda row: None, "email": mail}, book, Batch("w", number), at(seconds))
    assert sorted(log.read_text().splitlines()) == ["a0 1", "a1 1", "a2 1", "a2 2", "a2 3", "a3 1", "a3 2", "a3 3"]
    got = table(L.notifications(book), "alert_id", "channel", "outcome", "attempt")
    assert got == sorted([(f"a{k}", "log", "success", 1) for k in range(4)] + [("a0", "email", "success", 1), ("a1", "email", "success", 1), ("a2", "email", "failed", 3), ("a3", "email", "failed", 3)])


def test_items_that_arent_due_are_left_out_before_the_join(spark, place):
    path, book, log = place
    for number, seconds in ((0, 3), (1, 3)):  # the second pass has nothing to send
        L.relay(spark, path, book, Batch("r", number), at(seconds), sender(log), None)
    assert sent(log) == [(f"e{k}", 1) for k in range(4)]
    items = spark.range(20_000).selectExpr("concat('k', id) as key", "id")
    claims = items.filter("id % 40 = 0").select("key")
    left = L._sieved(items, claims, claims.count())
    assert left.join(claims, "key", "left_semi").count() == 500 and left.count() < 3_000
    assert L._sieved(items, claims.limit(0), 0).count() == 0


@pytest.mark.parametrize("most", [0, 2])
def test_passes_with_and_without_a_bitmap_send_the_same(spark, place, monkeypatch, most):
    monkeypatch.setattr(L, "SIEVED", most)
    path, book, log = place
    for number, seconds in enumerate((100, 102, 104)):
        for k in range(2):
            L.relay(spark, path, book, Batch(f"r{k}", number), at(seconds), sender(log, lambda row: row["event_id"] == "e1" and row["attempt"] < 3), None, (k, 2))
    assert sent(log) == [("e0", 1), ("e1", 1), ("e1", 2), ("e1", 3), *((f"e{k}", 1) for k in range(2, 6))]
