"""Time series and service-level rules on hand-computed samples."""

import math
from datetime import timedelta

import pytest
from pyspark.sql import functions as F

from riskflow import schemas
from riskflow.operators import counts as C
from riskflow.operators import series as S
from riskflow.operators import slo

from .conftest import at, table


def samples(spark, *rows):
    return spark.createDataFrame([(at(t), name, labels, float(v)) for t, name, labels, v in rows], schemas.SAMPLE)


def counter(spark, name, values, step=15, start=0, **labels):
    return samples(spark, *((start + i * step, name, labels, v) for i, v in enumerate(values) if v is not None))


def test_increase_with_restart(spark):
    df = counter(spark, "c", [10, 12, 15, 3, 4], i="a").union(counter(spark, "c", [1, 1, 1, 1, 2], i="b"))
    assert table(S.increase(df, [], at(-1), at(60))) == [(2 + 3 + 3 + 1 + 1,)]
    assert table(S.increase(df, ["i"], at(-1), at(60))) == [("a", 9.0), ("b", 1.0)]
    # (t0, t1]: the sample at t0 is outside, so its delta to the next one is too
    assert table(S.increase(df, ["i"], at(0), at(60))) == [("a", 7.0), ("b", 1.0)]


def test_rate_irate_gauge(spark):
    df = counter(spark, "c", [0, 30, 60, 120, 240], i="a")
    assert table(S.rate(df, [], at(60), timedelta(seconds=46))) == [(pytest.approx(210 / 46),)]
    assert table(S.irate(df, [], at(60))) == [(8.0,)]
    assert table(S.gauge(df, "max", ["i"], at(45))) == [("a", 120.0)]
    assert S.gauge(df, "sum", [], at(1000)).count() == 0


def test_extrapolation(spark):
    # samples every 15 s over 45 s of a 60 s window: stretched to both edges, not below zero
    df = counter(spark, "c", [100, 110, 120, 130], start=10, i="a")
    got = S.increase(df, [], at(0), at(60), extrapolate=True).first().value
    assert got == pytest.approx(30 * (45 + 10 + 5) / 45)
    young = counter(spark, "c", [0, 10, 20, 30], start=10, i="a")
    assert S.increase(young, [], at(0), at(60), extrapolate=True).first().value == pytest.approx(30 * 50 / 45)
    short = counter(spark, "c", [100, 110, 120], start=100, i="a")
    got = S.increase(short, [], at(0), at(200), extrapolate=True).first().value
    assert got == pytest.approx(20 * (30 + 7.5 + 7.5) / 30)


def test_single_sample_has_no_growth(spark):
    assert S.increase(counter(spark, "c", [5], i="a"), [], at(-1), at(60)).count() == 0


def test_matchers(spark):
    df = samples(spark, (0, "a", {"x": "1"}, 1), (0, "a", {"x": "12"}, 1), (0, "a", {}, 1), (0, "b", {"x": "1"}, 1))
    assert S.match(df, "a").count() == 3
    assert S.match(df, "a", eq={"x": "1"}).count() == 1
    assert S.match(df, "a", re={"x": "1"}).count() == 1  # the whole value has to match
    assert S.match(df, "a", re={"x": "1.*|"}).count() == 3
    assert S.match(df, "a", ne={"x": ""}).count() == 2
    assert S.match(df, ["a", "b"], nre={"x": "1"}).count() == 2
    assert table(S.label_values(df, "a", "x")) == [("1",), ("12",)]


def one(spark, value, **labels):
    return spark.createDataFrame([(*labels.values(), value)], ", ".join([*(f"{k} string" for k in labels), "value double"]))


@pytest.mark.parametrize("a, b, kw, want", [
    (3.0, 6.0, {}, [0.5]), (3.0, 0.5, {}, [3.0]), (3.0, 0.0, dict(require_positive=True), []), (9.0, 3.0, dict(cap=1), [1.0]),
    (0.0, 0.0, dict(floor=None), [None])])
def test_safe_ratio(spark, a, b, kw, want):
    assert [r.value for r in S.safe_ratio(one(spark, a), one(spark, b), **kw).collect()] == want


def test_fallbacks(spark):
    a, b = one(spark, 1.0, app="x"), one(spark, 2.0, app="x").union(one(spark, 3.0, app="y"))
    assert table(S.vector_or(a, b, ["app"])) == [("x", 1.0), ("y", 3.0)]
    assert table(S.vector_or(one(spark, 1.0).filter("false"), one(spark, 0.0))) == [(0.0,)]
    assert table(S.vector_or(one(spark, 1.0), one(spark, 0.0))) == [(1.0,)]
    assert S.vector_or(one(spark, 1.0).filter("false"), one(spark, 0.0).filter("false")).count() == 0


def test_consumer_lag(spark):
    end = spark.createDataFrame([("t", "0", 10.0), ("t", "1", 5.0)], "topic string, partition string, value double")
    done = spark.createDataFrame([("t", "0", "g", 7.0), ("t", "1", "g", 6.0)], "topic string, partition string, consumergroup string, value double")
    assert table(S.consumer_lag(end, done, ["consumergroup"])) == [("g", 3.0)]


def buckets(spark, *pairs):
    return spark.createDataFrame([(le, float(n)) for le, n in pairs], "le string, value double")


@pytest.mark.parametrize("q, want", [(0.5, 1.5), (0.25, 0.75), (0.99, 2.0), (0.1, 0.3)])
def test_histogram_quantile(spark, q, want):
    df = buckets(spark, ("1", 4), ("2", 8), ("+Inf", 12))
    assert S.histogram_quantile(df, q).first().value == pytest.approx(want)


def test_histogram_quantile_needs_all_buckets(spark):
    for df in (buckets(spark, ("+Inf", 5)), buckets(spark, ("1", 2), ("2", 3)), buckets(spark, ("1", 0), ("+Inf", 0))):
        assert math.isnan(S.histogram_quantile(df, 0.5).first().value)


def test_reducers(spark):
    df = spark.createDataFrame([(at(0), 1.0), (at(1), 5.0), (at(2), None)], "ts timestamp, value double")
    got = {c: S.reduce_series(df, c).first().value for c in ("last", "mean", "max", "min", "sum")}
    assert got == {"last": 5.0, "mean": 3.0, "max": 5.0, "min": 1.0, "sum": 6.0}


def test_metric_delta(spark):
    df = counter(spark, "c", [1, 4], i="a").union(counter(spark, "c", [10, 10], i="b"))
    assert tuple(C.metric_delta(df, "c").first()) == (11.0, 14.0, 3.0)


def test_steps_agree_with_single_windows(spark):
    df = counter(spark, "c", [0, 3, 4, None, 9, 2, 2, 30], step=10, i="a")
    width = timedelta(seconds=30)
    got = {r.k: r.value for r in S.increase_steps(df, [], width).collect()}
    base = int(at(0).timestamp()) // 15
    for k in range(base, base + 10):
        end = at((k - base) * 15)
        alone = [r.value for r in S.increase(df, [], end - width, end).collect()]
        assert [got[k]] == alone if k in got else alone == []


def test_stage_gap(spark):
    a, b = counter(spark, "in", [0, 60, 120], i="a"), counter(spark, "out", [0, 30, 60], i="a")
    got = S.stage_gap(a, b, timedelta(seconds=30)).orderBy("ts").collect()
    assert [r.value for r in got] == [1.0, 1.0]  # (60 - 30) in two samples 30 s apart at most


def test_sliding_windows(spark):
    df = spark.createDataFrame([(at(0),), (at(20),)], "ts timestamp")
    got = S.sliding(df, "ts", "30 seconds", "15 seconds")
    assert table(got.select(F.unix_seconds("start") - int(at(0).timestamp()), "n")) == [(-15, 1), (0, 2), (15, 1)]


def test_persistence(spark):
    # held at steps 1-4, a gap at 5, held again at 6-7, quiet at 8
    df = spark.createDataFrame([(k, k != 8) for k in (1, 2, 3, 4, 6, 7, 8)], "k long, hit boolean")
    got = {r.k: r.state for r in S.persisted(df, "hit", timedelta(seconds=30)).collect()}
    assert got == {1: "pending", 2: "pending", 3: "firing", 4: "firing", 6: "pending", 7: "pending", 8: "inactive"}
    now = {r.k: r.state for r in S.persisted(df, "hit", timedelta(0), limit=3).collect()}
    assert set(now.values()) == {"firing", "inactive"}


def test_rules_fire_after_their_time(spark):
    n = 120
    decided = counter(spark, "fraud_decisions_total", [i * 15 for i in range(n)], application="d", decision="clean")
    sent = counter(spark, "transaction_events_published_total", [i * 30 for i in range(n)], application="t", outcome="success")
    rule = next(r for r in slo.standard_rules() if r.name == "FraudPipelineCoverageSLOViolation")
    got = slo.evaluate_rule(decided.union(sent), rule).orderBy("ts").collect()
    # near the edges the window is not full and the floor of one per second holds the ratio down
    assert max(r.value for r in got) == pytest.approx(0.5)
    states = [r.state for r in got]
    assert states == ["pending"] * 40 + ["firing"] * (len(states) - 40) and got[0].severity == "critical"
    later = slo.evaluate_rule(decided.union(sent), rule, t0=at(900), t1=at(960)).collect()
    assert len(later) == 5


def test_every_rule_can_breach(spark):
    def line(name, slope, **labels):
        return counter(spark, name, [i * slope for i in range(100)], **labels)

    parts = [
        line("fraud_alerts_total", 60, application="a"), line("fraud_decisions_total", 90, application="d", decision="fraud"),
        line("transaction_events_published_total", 900, application="t", outcome="success"),
        line("fraud_alert_notifications_total", 30, application="a", channel="email", outcome="failed"),
        line("fraud_alert_notifications_total", 60, application="a", channel="log", outcome="success"),
        line("kafka_dlq_events_received_total", 1, application="d"), line("kafka_dlq_events_failed_total", 1, application="d"),
    ]
    for name, mean in (("fraud_evaluation_latency_seconds", 0.3), ("fraud_alert_notification_latency_seconds", 1.6)):
        parts += [line(f"{name}_sum", 60 * mean, application="x"), line(f"{name}_count", 60, application="x")]
    df = parts[0]
    for more in parts[1:]:
        df = df.union(more)
    states = slo.evaluate_rules(df)
    names = {r.name for r in slo.standard_rules()}
    assert {r.rule for r in slo.firing(states).select("rule").distinct().collect()} == names
    end = at(99 * 15)
    assert slo.any_firing(states, ["FraudPipelineCoverageSLOViolation"], end).first().value == 1.0
    assert slo.any_firing(states, ["none"], end).first().value == 0.0
    assert table(slo.firing(states, ["KafkaDlqTrafficDetected"], end), "labels") == [("application=d",)]
