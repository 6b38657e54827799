"""Triage, lists, fan-out, counters and load reports on small fixtures."""

import pytest
from pyspark.sql import functions as F

from riskflow import schemas
from riskflow.operators import alerts as A
from riskflow.operators import counts as C
from riskflow.operators import delivery

from .conftest import at, table


@pytest.fixture(scope="module")
def alerts(spark):
    rows = [
        ("a1", "t1", "u1", 70, "HIGH_AMOUNT,HIGH_RISK_MERCHANT", at(10), "e1", None),
        ("a2", "t2", "u1", 85, "HIGH_AMOUNT,HIGH_VELOCITY", at(50), "e2", "tr"),
        ("a3", "t3", "u2", 100, "HIGH_AMOUNT", at(70), "e3", None),
        ("a4", "t4", "u3", 84, "X,", at(70), "e4", None),
    ]
    return spark.createDataFrame(rows, schemas.ALERT)


def test_triage_values(alerts):
    assert A.alert_count(alerts, at(10), at(70)).first().value == 4  # both ends belong to the range
    assert A.alert_count(alerts, at(11), at(69)).first().value == 1
    assert float(A.average_risk(alerts).first().value) == 84.75
    assert A.critical_share(alerts).first().value == 0.5


def test_triage_without_alerts(alerts):
    none = alerts.filter("false")
    assert (A.alert_count(none).first().value, float(A.average_risk(none).first().value), A.critical_share(none).first().value) == (0, 0.0, 0.0)


def test_timeline_and_reasons(alerts):
    assert [(r.time.minute, r.alerts) for r in A.alert_timeline(alerts).collect()] == [(0, 2), (1, 2)]
    # an empty reason after the last comma counts here
    assert [tuple(r) for r in A.top_reasons(alerts, k=3).collect()] == [("HIGH_AMOUNT", 3), ("", 1), ("HIGH_RISK_MERCHANT", 1)]


def test_lists(alerts):
    assert [r.id for r in A.list_alerts(alerts).collect()] == ["a3", "a4", "a2", "a1"]
    assert [r.id for r in A.list_alerts_by_user(alerts, "u1").collect()] == ["a2", "a1"]
    assert table(A.alert_for_transaction(alerts, "t3"), "id") == [("a3",)]
    assert [(r.alert_id, r.trace_id) for r in A.latest_alerts(alerts, 3).collect()] == [("a3", ""), ("a4", ""), ("a2", "tr")]


def test_severity_and_summary(alerts):
    assert table(A.alerts_by_severity(alerts)) == [("critical", 3), ("high", 1)]
    assert tuple(A.risk_summary(alerts).first()) == (4, 339, 100, 84.75)


@pytest.mark.parametrize("channels, names", [
    (A.Channels(), ["log"]), (A.Channels(email_enabled=True, email_to=("a@b",)), ["log", "email"]),
    (A.Channels(email_enabled=True), ["log", "log"]), (A.Channels(log_enabled=False), [])])
def test_channels(spark, alerts, channels, names):
    assert channels.names() == names
    fanned = A.fan_out(alerts, channels)
    assert fanned.count() == 4 * len(names)
    assert A.channel_table(spark, channels).count() == len(names)


def test_failing_channel_leaves_the_others_alone(alerts):
    def mail(alert):
        if alert["risk_score"] > 80:
            raise OSError("mailbox full")

    fanned = A.fan_out(alerts, A.Channels(email_enabled=True, email_to=("a@b",)))
    outcomes = A.deliver(fanned, {"log": lambda alert: None, "email": mail})
    assert table(C.outcome_counts(outcomes, "channel", "outcome")) == [("email", "failed", 3), ("email", "success", 1), ("log", "success", 4)]


def test_log_record(alerts):
    import json

    line = json.loads(alerts.filter("id = 'a1'").select(A.log_record(alerts)).first()[0])
    assert (line["event"], line["alertId"], line["risk_score"]) == ("fraud_alert_logged", "a1", 70)


def test_funnel(spark):
    tx = spark.createDataFrame([(f"t{i}",) for i in range(4)], "transaction_id string")
    decided = spark.createDataFrame([("t0", True), ("t1", True), ("t2", False)], "transaction_id string, fraudulent boolean")
    alerted = spark.createDataFrame([("t0",), ("t2",)], "transaction_id string")
    assert tuple(delivery.stage_funnel(tx, decided, alerted).first()) == (4, 3, 2, 1, 0.75, 0.5, 0.25)


def test_redelivery_and_processed(spark):
    df = spark.createDataFrame([("e1", 1), ("e1", 2), ("e2", 3)], "event_id string, seq long")
    done = spark.createDataFrame([("e2",)], "event_id string")
    assert table(delivery.drop_processed(df, done)) == [("e1", 1)]
    assert table(delivery.drop_processed(df)) == [("e1", 1), ("e2", 3)]


def test_dead_letter_keeps_its_record(spark):
    df = spark.createDataFrame([("k", "{}", 3, "e", None)], "key string, value string, partition int, event_id string, transaction_id string")
    ok, dead = delivery.route_dlq(df, F.when(F.col("transaction_id").isNull(), "NULL_TRANSACTION_ID"), "transactions.created")
    assert ok.count() == 0
    assert table(dead) == [("k", "{}", "transactions.created.dlq", 3, None, "NULL_TRANSACTION_ID")]


LOAD = "statusCode int, latencyMs long, fraudulent boolean, userId string"


@pytest.mark.parametrize("limit", [None, 10])
def test_load_report(spark, limit):
    rows = [(201 if i % 40 else 500, (i * 37) % 120 + 1, i < 48, f"u{i}") for i in range(120)]
    df = spark.createDataFrame(rows, LOAD)
    got = C.load_report(df, limit=limit).first()
    want = sorted(r[1] for r in rows)[-(-120 * 95 // 100) - 1]
    assert (got.requests, got.errors, got.error_rate, got.p95) == (120, 3, 3 / 120, want)


def test_load_report_of_one_and_none(spark):
    one = spark.createDataFrame([(201, 7, False, "u")], LOAD)
    assert C.load_report(one).first().p95 == 7
    assert C.load_report(one.filter("false")).first().p95 is None


@pytest.mark.parametrize("limit", [None, 25])
def test_trend_stats(spark, limit):
    import numpy as np

    values = [(i * i) % 997 for i in range(301)]
    df = spark.createDataFrame([(201, v, False, "u") for v in values], LOAD)
    got = C.trend_stats(df, limit).first()
    for name, share in (("med", 50), ("p90", 90), ("p95", 95), ("p99", 99)):
        assert got[name] == pytest.approx(np.percentile(values, share))
    assert (got.min, got.max, got.failed_ok, got.latency_ok) == (min(values), max(values), True, True)


def test_timers_and_dead_letters(spark):
    df = spark.createDataFrame([("a", 10), ("a", 30), ("b", 5)], "op string, ms long")
    assert table(C.timer_summary(df, "ms", "op")) == [("a", 2, 40, 30, 20.0), ("b", 1, 5, 5, 5.0)]
    letters = spark.createDataFrame([("x", "failed"), ("x", "reprocessed"), ("x", "reprocessed")], "topic string, outcome string")
    assert table(C.dlq_counts(letters, "topic")) == [("x", 3, 2, 1)]


def test_top_k_ties_and_partitions(spark):
    df = spark.createDataFrame([("a", "x", 5), ("a", "y", 5), ("a", "z", 9), ("b", "x", 1)], "p string, n string, v int")
    assert [r.n for r in C.top_k(df, "v", 2, tie=["n"]).collect()] == ["z", "x"]
    assert table(C.top_k(df, "v", 2, ["p"], ["n"]), "p", "n") == [("a", "x"), ("a", "z"), ("b", "x")]
