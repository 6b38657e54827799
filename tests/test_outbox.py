"""The outbox table: enqueue, due rows, outcomes, purge, backlog."""

import json
from datetime import timedelta
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from riskflow import schemas
from riskflow.operators import outbox

from .conftest import at, table

TRACE = "a1b2c3d4e5f6789012345678a1b2c3d4"


@pytest.fixture(scope="module")
def rows(spark):
    event = ("e1", at(5, 123456), "t1", TRACE, "u1", Decimal("10.5"), "USD", "m", "US", "CARD")
    bare = ("e2", None, "t2", None, "u2", Decimal("1"), "USD", "m", "US", "CARD")
    df = spark.createDataFrame([event, bare], schemas.CREATED_EVENT)
    return outbox.enqueue(df, "transactions.created", now=F.lit(at(9)), baggage=F.lit("  ")).cache()


def test_enqueued_row(rows):
    r = rows.filter("event_id = 'e1'").first()
    assert (r.status, r.attempts, r.topic, r.event_key) == ("PENDING", 0, "transactions.created", "t1")
    assert r.created_at == r.next_attempt_at and r.baggage is None and r.published_at is None
    parts = r.trace_parent.split("-")
    assert parts[0] == "00" and parts[1] == TRACE and len(parts[2]) == 16 and parts[3] == "01"
    payload = json.loads(r.payload)
    assert payload["userId"] == "u1" and payload["occurredAt"] == "2024-01-01T00:00:05.123456Z"


def test_event_without_time_and_trace(rows):
    r = rows.filter("event_id = 'e2'").first()
    assert r.created_at.second == 9 and r.trace_parent is None


def test_context_ids_come_first(spark, rows):
    df = spark.createDataFrame([("e", at(0), "t", TRACE, "u", Decimal(1), "USD", "m", "US", "CARD")], schemas.CREATED_EVENT)
    other = TRACE[::-1]
    got = outbox.enqueue(df, "x", context_trace=F.lit(other), context_span=F.lit("1234567890abcdef"), sampled=F.lit(False)).first()
    assert got.trace_parent == f"00-{other}-1234567890abcdef-00"


def test_due_batch(rows):
    later = rows.withColumn("next_attempt_at", F.when(F.col("event_id") == "e2", F.lit(at(100))).otherwise(F.col("next_attempt_at")))
    assert table(outbox.due_batch(later, at(50)), "event_id") == [("e1",)]
    assert outbox.due_batch(later, at(100), 1).first().event_id == "e1"
    assert outbox.due_batch(later.withColumn("status", F.lit("PUBLISHED")), at(100)).count() == 0


def test_outcomes(spark, rows):
    told = spark.createDataFrame(
        [(r.id, r.event_id == "e1", None if r.event_id == "e1" else "x" * 600, "E") for r in rows.collect()],
        "id string, ok boolean, error string, error_class string")
    failed_before = rows.withColumn("last_error", F.lit("old"))
    got = {r.event_id: r for r in outbox.apply_outcomes(failed_before, told, at(20)).collect()}
    ok, bad = got["e1"], got["e2"]
    assert (ok.status, ok.last_error, ok.attempts, ok.published_at.second) == ("PUBLISHED", None, 0, 20)
    assert (bad.status, bad.attempts, len(bad.last_error), bad.next_attempt_at.second) == ("PENDING", 1, 512, 22)
    untouched = outbox.apply_outcomes(failed_before, told.filter("false"), at(20))
    assert table(untouched) == table(failed_before)


def test_purge_and_backlog(rows):
    published = rows.withColumns({"status": F.lit("PUBLISHED"), "published_at": F.lit(at(0))})
    day = timedelta(hours=24)
    assert outbox.purge_published(published, at(0) + day).count() == 2
    assert outbox.purge_published(published, at(0, 1) + day).count() == 0
    assert outbox.purge_published(rows, at(0) + 9 * day).count() == 2
    got = outbox.outbox_backlog(rows, at(65)).first()
    assert (got.status, got.n, got.attempts) == ("PENDING", 2, 0)
    assert got.oldest_age_seconds == pytest.approx(59.876544)


def test_publish_headers(rows):
    got = {r.event_id: r for r in outbox.publish_headers(rows.withColumn("trace_parent", F.lit(" "))).collect()}
    assert got["e1"].traceparent.startswith(f"00-{TRACE}-") and got["e2"].traceparent is None
    assert got["e1"].baggage_header == ""
