"""Log lines and spans."""

import json
import random
from datetime import timedelta

import pytest

from riskflow import schemas
from riskflow.operators import logs, series, traces

from .conftest import at, table
from .test_streaming import shuffled


@pytest.fixture(scope="module")
def lines(spark):
    def row(service, **fields):
        return (at(0), service, json.dumps(fields))

    return spark.createDataFrame([
        row("fraud-detection-service", event="fraud_decision_made", decision="fraud", risk_score=85, level="WARN", traceId="abc", spanId="s", logger_name="L"),
        row("fraud-detection-service", event="fraud_decision_made", decision="fraud", risk_score=75, outcome="fraud"),
        row("alert-service", event="notification_result", channel="email", outcome="failed"),
        row("alert-service", event="transaction_outbox_publish_failed_late"),
        row("transaction-service", event="transaction_outbox_publish_failed", outcome="failed"),
        (at(0), "gateway", 'plain "traceId" : "xyz" text'),
    ], schemas.LOG_LINE)


def test_filters(lines):
    parsed = logs.parse_logs(lines)
    assert logs.filter_fields(parsed, event="fraud_decision_made", decision="fraud", risk_score__ge=80).count() == 1
    assert logs.filter_fields(parsed, event="notification_result", channel="email", outcome="failed").count() == 1
    assert logs.filter_events(parsed, ".*failed|transaction_event_retry").count() == 1
    assert logs.filter_events(logs.in_services(parsed, "transaction-service|fraud-detection-service"), ".*publish_failed").count() == 1
    assert logs.in_services(lines).count() == 6


def test_labels_and_trace_ids(lines):
    got = logs.labelled(lines).filter("trace_id is not null").first()
    assert (got.level, got.logger, got.trace_id, got.span_id) == ("WARN", "L", "abc", "s")
    assert {r[0] for r in lines.select(logs.extract_trace_id()).collect()} == {"abc", "xyz", None}


def test_outcomes_and_services(lines):
    counts = {(r.service, r.event, r.outcome): r.n for r in logs.event_outcomes(logs.parse_logs(lines)).collect()}
    assert counts[("alert-service", "notification_result", "failed")] == 1 and counts[("gateway", None, None)] == 1
    assert logs.service_names(lines, ".*-service").count() == 3


@pytest.fixture(scope="module")
def spans(spark):
    unset, error = "STATUS_CODE_UNSET", "STATUS_CODE_ERROR"
    return spark.createDataFrame([
        ("t1", "a", None, "tx", "POST /", "SERVER", unset, at(0), 100.0),
        ("t1", "b", "a", "tx", "send", "PRODUCER", unset, at(0), 5.0),
        ("t1", "c", "b", "fraud", "receive", "CONSUMER", error, at(1), 30.0),
        ("t1", "d", "c", "fraud", "inner", "INTERNAL", unset, at(1), 1.0),
        ("t2", "b", None, "tx", "send", "PRODUCER", unset, at(0), 7.0),  # nobody answered
    ], schemas.SPAN)


def test_service_graph(spans):
    assert table(traces.service_graph(spans)) == [("tx", "fraud", 1, 1, 0.005, 0.03)]
    got = traces.service_graph_latency(spans)
    assert series.histogram_quantile(got, 0.5, ["client", "server"]).first().value == pytest.approx(0.024)


def test_span_metrics(spans):
    got = {(r.name, r.le): (r.calls, r.value) for r in traces.span_metrics(spans).filter("service = 'tx'").collect()}
    assert got[("send", "0.004")] == (2, 0.0) and got[("send", "0.008")] == (2, 2.0)
    assert got[("POST /", "0.064")] == (1, 0.0) and got[("POST /", "+Inf")] == (1, 1.0)


@pytest.mark.parametrize("limit", [None, 40])
def test_logs_for_trace_matches_the_plain_join(spark, limit):
    rnd = random.Random(3)
    spans = [(rnd.choice(["t1", "t1", "t2"]), f"s{i}", None, rnd.choice(["x", "y"]), "n", "SERVER", "", at(rnd.randrange(4000)), float(rnd.randrange(90_000)))
             for i in range(60)]
    lines = [(at(rnd.randrange(4000)), rnd.choice(["x", "y"]), rnd.choice(["t1", "t2", None]), i) for i in range(150)]
    got = traces.logs_for_trace(
        spark.createDataFrame(spans, schemas.SPAN),
        spark.createDataFrame(lines, "ts timestamp, service string, trace_id string, line_id long"), timedelta(seconds=50), limit)
    want = {}
    for ts, service, trace, i in lines:
        n = sum(1 for s in spans if (s[0], s[3]) == (trace, service)
                and s[7] - timedelta(seconds=50) <= ts <= s[7] + timedelta(milliseconds=s[8], seconds=50))
        if n:
            want[i] = n
    assert {r.line_id: r.spans for r in got.collect()} == want


def test_ids_of_spans_are_not_sent_to_their_lines(spark):
    """However long they are; only their hashes are."""
    rng = random.Random(5)
    spans = [(f"t{i % 20}", rng.randbytes(2000).hex(), None, "a", "n", "SERVER", "", at(i % 7), 1000.0) for i in range(300)]
    lines = spark.createDataFrame([(at(3), "a", f"t{i}", f"l{i}") for i in range(20)], "ts timestamp, service string, trace_id string, line_id string")
    held = spark.createDataFrame(spans, schemas.SPAN)
    before = shuffled(spark)
    got = table(traces.logs_for_trace(held, lines, timedelta(seconds=0)), "line_id", "spans")
    want = sorted((f"l{i}", n) for i in range(20) if (n := sum(1 for k, s in enumerate(spans) if s[0] == f"t{i}" and k % 7 <= 3 <= k % 7 + 1)))
    assert got == sorted(want, key=repr)
    assert sum(size for name, size in shuffled(spark).items() if name not in before) < 300 * 2000
