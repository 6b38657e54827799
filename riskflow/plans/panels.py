"""The dashboards as DataFrames: every panel is one call on the summary of the metric samples.

`Board` summarises all samples of a range once (one row per series, written to the shared folder). Panels are calls
on the board; `show` makes them twice. The first time, the board notes which totals they ask for and gives
empty ones. Then one aggregation over the summary computes all of them, and the second time they are read from its
result, which has a row per total and label set. A panel gives its label columns and `value`.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators import series as S
from ..operators.counts import top_k
from ..operators.slo import any_firing, firing
from ..session import settled

# Applications, paths and rule names the panels select.
TX, FRAUD, ALERT = "transaction-service", "fraud-detection-service", "alert-service"
PATHS = "/api/v1/transactions|/api/v1/webhooks/transactions"
SPRING = "spring-services"
SLO_RULES = (
    "FraudPipelineCoverageSLOViolation", "FraudToAlertConversionSLOViolation", "NotificationFailureRateHigh",
    "FraudEvaluationLatencyHigh", "AlertNotificationLatencyHigh", "KafkaDlqReprocessFailed",
)
ACTIONABLE_RULES = (*SLO_RULES, "KafkaDlqTrafficDetected")


class Board:
    """The summary a dashboard works on, and the values of its variables (regular expressions)."""

    def __init__(self, samples: DataFrame, t0: datetime, t1: datetime,
                 rate_interval: timedelta = timedelta(minutes=1), states: DataFrame | None = None,
                 application: str = ".*", topic: str = ".*", consumergroup: str = ".*", database: str = ".*",
                 service: str = ".*", extrapolate: bool = False, scrape: timedelta | None = None):
        self.summary = settled(S.summarise(samples, t0, t1, rate_interval, extrapolate, scrape=scrape))
        self.states, self.t1 = states, t1
        #: Totals asked for, by what they are, and the table that holds them once they are computed.
        self.wanted: dict[tuple, tuple] = {}
        self.totals: DataFrame | None = None
        self.app, self.topic, self.group, self.database, self.service = (
            application, topic, consumergroup, database, service,
        )

    @staticmethod
    def _fits(name: str, eq_or_re: dict) -> Column:
        """`label="x"` for equality, `label_re="x"` and `label_not_re="x"` for patterns."""
        eq = {k: v for k, v in eq_or_re.items() if not k.endswith("_re")}
        nre = {k[:-7]: v for k, v in eq_or_re.items() if k.endswith("_not_re")}
        re = {k[:-3]: v for k, v in eq_or_re.items() if k.endswith("_re") and not k.endswith("_not_re")}
        return S.matches(name, eq=eq, re=re, nre=nre)

    def pick(self, name: str, **eq_or_re) -> DataFrame:
        """Series of a metric."""
        return self.summary.filter(self._fits(name, eq_or_re))

    def total(self, name: str, col: str, by: Sequence[str], agg: str, m: dict) -> DataFrame:
        """Like `series.total` over the series of a metric, out of the one table of totals."""
        key = (name, col, tuple(by), agg, tuple(sorted(m.items())))
        number = self.wanted.setdefault(key, (len(self.wanted), name, col, tuple(by), agg, m))[0]
        if self.totals is None:
            return self.summary.sparkSession.createDataFrame([], ", ".join([*(f"`{b}` string" for b in by), "value double"]))
        own = self.totals.filter(F.col("total") == number)
        return own.select(*(F.col("labels")[k].alias(b) for k, b in enumerate(by)), "value")

    def compute(self) -> None:
        """All totals that were asked for, in one aggregation."""
        asked = []
        for number, name, col, by, agg, m in self.wanted.values():
            labels = F.array(*(F.coalesce(F.col("labels")[b], F.lit("")) for b in by)).cast("array<string>")
            row = F.struct(F.lit(number).alias("total"), F.lit(agg).alias("agg"), labels.alias("labels"), F.col(col).cast("double").alias("value"))
            asked.append(F.when(self._fits(name, m) & F.col(col).isNotNull(), row))
        each = self.summary.select(F.explode(F.array_compact(F.array(*asked))).alias("_t")).select("_t.*")
        done = each.groupBy("total", "agg", "labels").agg(*(f("value").alias(n) for n, f in (("sum", F.sum), ("avg", F.avg), ("max", F.max), ("min", F.min))))
        value = F.when(F.col("agg") == "avg", F.col("avg")).when(F.col("agg") == "max", F.col("max")).when(F.col("agg") == "min", F.col("min"))
        self.totals = settled(done.select("total", "labels", value.otherwise(F.col("sum")).alias("value")))

    def inc(self, name: str, by: Sequence[str] = (), **m) -> DataFrame:
        return self.total(name, "increase", by, "sum", m)

    def rate(self, name: str, by: Sequence[str] = (), **m) -> DataFrame:
        return self.total(name, "rate", by, "sum", m)

    def irate(self, name: str, by: Sequence[str] = (), **m) -> DataFrame:
        return self.total(name, "irate", by, "sum", m)

    def now(self, name: str, by: Sequence[str] = (), agg: str = "sum", **m) -> DataFrame:
        return self.total(name, "gauge", by, agg, m)

    def mean(self, name: str, col: str, positive: bool = False, factor: float = 1.0, **m) -> DataFrame:
        parts = [self.total(f"{name}_{p}", col, (), "sum", m) for p in ("sum", "count")]
        return S.scaled(S.safe_ratio(*parts, require_positive=positive), factor)

    def vector(self, name: str, labels: Sequence[str], **m) -> DataFrame:
        return S.latest_vector(self.pick(name, **m), name, labels)

    def quantile(self, name: str, q: float, by: Sequence[str] = (), **m) -> DataFrame:
        buckets = self.total(name, "rate", ["le", *by], "sum", m)
        return S.histogram_quantile(buckets, q, by)

    def lag(self, by: Sequence[str]) -> DataFrame:
        place = ["topic", "partition", "instance", "job"]
        end = self.vector("kafka_topic_partition_current_offset", place, topic_re=self.topic).filter(
            F.col("topic") != "__consumer_offsets"
        )
        done = self.vector("kafka_consumergroup_current_offset", [*place, "consumergroup"],
                           consumergroup_re=self.group, topic_re=self.topic)
        return S.consumer_lag(end, done, by)

    def cpu(self, op: str) -> DataFrame:
        cores = self.vector("system_cpu_count", ["instance", "job", "application"], job=SPRING)
        usage = self.vector("process_cpu_usage", ["instance", "job", "application"], job=SPRING)
        # an instance is one process: match it by application too when several share an instance name
        return S.vector_join(usage, cores, ["instance", "job", "application"], op)


Panel = Callable[[Board], DataFrame]


def _gap(kind: str, a: tuple, b: tuple) -> Panel:
    def panel(p: Board) -> DataFrame:
        read = getattr(p, kind)
        return S.vector_join(read(a[0], **a[1]), read(b[0], **b[1]), [], "-")

    return panel


_published = ("transaction_events_published_total", dict(application=TX, outcome="success"))
_consumed = ("fraud_events_consumed_total", dict(application=FRAUD))
_detected = ("fraud_events_published_total", dict(application=FRAUD, outcome="success"))
_alerted = ("fraud_alerts_total", dict(application=ALERT))
_web = ("http_server_requests_seconds_count", dict(application=TX, uri_re=PATHS))


def _read(kind: str, metric: tuple, **more) -> Panel:
    return lambda p: getattr(p, kind)(metric[0], **{**metric[1], **more})


def _spring(metric: tuple) -> tuple:
    return metric[0], {**metric[1], "job": SPRING}


ALERTING: dict[str, Panel] = {
    "fraud_alerts": _read("inc", _alerted),
    "slo_rules": lambda p: any_firing(p.states, SLO_RULES, p.t1),
    "transactions": lambda p: p.inc("transactions_received_total", application=TX),
    "fraud_ratio": lambda p: S.safe_ratio(
        p.inc("fraud_alerts_total", application=ALERT), p.inc("transactions_received_total", application=TX)
    ),
    "alert_rate_per_minute": lambda p: S.scaled(p.rate("fraud_alerts_total", application=ALERT), 60),
    "average_risk_score": lambda p: p.mean("fraud_alert_risk_score", "rate", positive=True, application=ALERT),
    "decision_coverage": lambda p: S.safe_ratio(
        p.inc("fraud_decisions_total", application=FRAUD), p.inc(_published[0], **_published[1]), require_positive=True
    ),
    "fraud_to_alert_conversion": lambda p: S.safe_ratio(
        p.inc("fraud_alerts_total", application=ALERT),
        p.inc("fraud_decisions_total", application=FRAUD, decision="fraud"), cap=1, require_positive=True,
    ),
    "evaluation_latency": lambda p: p.mean("fraud_evaluation_latency_seconds", "increase", positive=True, application=FRAUD),
    "notification_latency": lambda p: p.mean(
        "fraud_alert_notification_latency_seconds", "increase", positive=True, application=ALERT
    ),
    "notification_outcomes": lambda p: p.rate("fraud_alert_notifications_total", ["channel", "outcome"], application=ALERT),
    "actionable_alerts": lambda p: firing(p.states, ACTIONABLE_RULES, p.t1).select(
        "rule", "severity", "labels", F.lit(1.0).alias("value")
    ),
    "top_rules": lambda p: top_k(p.inc("fraud_rule_hits_total", ["rule"], application=FRAUD), "value", 10),
}

CAPACITY: dict[str, Panel] = {
    "total_consumer_lag": lambda p: p.lag([]),
    "postgres_up": lambda p: p.now("pg_up"),
    "kafka_exporter_up": lambda p: p.now("up", job="kafka-exporter"),
    "instances_up": lambda p: p.now("up", job=SPRING),
    "stage_published": _read("rate", _published),
    "stage_consumed": _read("rate", _consumed),
    "stage_detected": _read("rate", _detected),
    "stage_alerted": _read("rate", _alerted),
    "backlog_before_scoring": _gap("rate", _published, _consumed),
    "backlog_before_alerting": _gap("rate", _detected, _alerted),
    "consumer_lag_by_group": lambda p: p.lag(["consumergroup", "topic"]),
    "busiest_partitions": lambda p: top_k(
        p.rate("kafka_topic_partition_current_offset", ["topic", "partition"], topic_re=p.topic,
               topic_not_re="__consumer_offsets"), "value", 12),
    "pool_active": lambda p: p.now("hikaricp_connections_active", ["application"]),
    "pool_pending": lambda p: p.now("hikaricp_connections_pending", ["application"]),
    "pool_max": lambda p: p.now("hikaricp_connections_max", ["application"]),
    "commits": lambda p: p.rate("pg_stat_database_xact_commit", ["datname"], datname_re=p.database),
    "rollbacks": lambda p: p.rate("pg_stat_database_xact_rollback", ["datname"], datname_re=p.database),
    "deadlocks": lambda p: p.rate("pg_stat_database_deadlocks", ["datname"], datname_re=p.database),
    "cpu_percent": lambda p: S.scaled(
        p.cpu("/").groupBy("application", "instance").agg(F.avg("value").alias("value")), 100),
    "heap": lambda p: p.now("jvm_memory_used_bytes", ["application"], job=SPRING, area="heap"),
    "cpu_cores": lambda p: p.cpu("*").groupBy("application").agg(F.sum("value").alias("value")),
}

_DLQ = ("received", "reprocessed", "failed")
_STAGES = {
    "published": ("transaction_events_published_total", {"outcome": "success"}),
    "consumed": ("fraud_events_consumed_total", {}),
    "detected": ("fraud_events_published_total", {"outcome": "success"}),
    "alerted": ("fraud_alerts_total", {}),
}


def _share(kind: str, num: tuple, den: tuple) -> Panel:
    """Guarded ratio of two metrics of the selected applications."""
    return lambda p: S.safe_ratio(*(getattr(p, kind)(name, application_re=p.app, **m) for name, m in (num, den)))


def _dlq(kind: str, part: str, selected: bool) -> Panel:
    def panel(p: Board) -> DataFrame:
        m = {"application_re": p.app} if selected else {}
        return getattr(p, kind)(f"kafka_dlq_events_{part}_total", ["application"], **m)

    return panel


def _by_app(kind: str, name: str, by: str = "application", **m) -> Panel:
    return lambda p: getattr(p, kind)(name, [by], application_re=p.app, **m)


MESSAGING: dict[str, Panel] = {
    "created_publish_success": _share("rate", _STAGES["published"], ("transaction_events_published_total", {})),
    "detected_publish_success": _share("rate", _STAGES["detected"], ("fraud_events_published_total", {})),
    "dlq_recovery": _share("inc", ("kafka_dlq_events_reprocessed_total", {}), ("kafka_dlq_events_received_total", {})),
    "dlq_failures": lambda p: p.inc("kafka_dlq_events_failed_total", application_re=p.app),
    **{f"{stage}_rate": _by_app("rate", name, **m) for stage, (name, m) in _STAGES.items()},
    "consumed_per_published": _share("rate", _STAGES["consumed"], _STAGES["published"]),
    "alerted_per_detected": _share("rate", _STAGES["alerted"], _STAGES["detected"]),
    "dlq_health": lambda p: _share(
        "rate", ("kafka_dlq_events_failed_total", {}), ("kafka_dlq_events_received_total", {})
    )(p).withColumn("value", 1 - F.col("value")),
    **{f"dlq_{part}_rate": _dlq("rate", part, True) for part in _DLQ},
    "publish_latency_ms": lambda p: p.mean("transaction_event_publish_latency_seconds", "rate", factor=1000, application_re=p.app),
    "evaluation_latency_ms": lambda p: p.mean("fraud_evaluation_latency_seconds", "rate", factor=1000, application_re=p.app),
    "created_outcomes": _by_app("inc", "transaction_events_published_total", "outcome"),
    "detected_outcomes": _by_app("inc", "fraud_events_published_total", "outcome"),
    "producer_records": _by_app("rate", "kafka_producer_record_send_total"),
    "consumer_records": _by_app("rate", "kafka_consumer_records_consumed_total"),
    **{f"dlq_{part}_total": _dlq("inc", part, True) for part in _DLQ},
}

_ERRORS = (_web[0], {**_web[1], "status_re": "4..|5.."})


def _p95_http(p: Board) -> DataFrame:
    m = dict(application_re=p.app, uri_not_re="/actuator.*")
    quantile = p.quantile("http_server_requests_seconds_bucket", 0.95, **m)
    return S.scaled(S.vector_or(quantile, p.mean("http_server_requests_seconds", "increase", **m)), 1000)


OVERVIEW: dict[str, Panel] = {
    "instances_up": lambda p: p.now("up", job=SPRING, application_re=p.app),
    "api_throughput": _read("rate", _web, by=["uri"]),
    "http_p95_ms": _p95_http,
    "heap": lambda p: p.now("jvm_memory_used_bytes", ["application"], area="heap", application_re=p.app),
    "errors_by_status": _read("inc", _ERRORS, by=["status"]),
    "decisions": lambda p: p.rate("fraud_decisions_total", ["decision"]),
    "fraud_share": lambda p: S.safe_ratio(
        p.inc("fraud_decisions_total", decision="fraud"), p.inc("fraud_decisions_total")),
    **{f"dlq_{part}_rate": _dlq("rate", part, False) for part in _DLQ},
    "dlq_failure_ratio": lambda p: S.safe_ratio(
        p.inc("kafka_dlq_events_failed_total"), p.inc("kafka_dlq_events_received_total")),
    "api_error_ratio": lambda p: S.safe_ratio(p.inc(_ERRORS[0], **_ERRORS[1]), p.inc(_web[0], **_web[1])),
}

_LIVE = {"ingest": _web, "published": _published, "consumed": _consumed, "detected": _detected, "alerted": _alerted}

THROUGHPUT: dict[str, Panel] = {
    **{f"{stage}_now": _read("irate", _spring(_LIVE[stage])) for stage in ("ingest", "published", "consumed", "alerted")},
    **{f"{stage}_line": _read("irate", _spring(metric)) for stage, metric in _LIVE.items()},
    "gap_before_scoring": _gap("irate", _spring(_published), _spring(_consumed)),
    "gap_before_alerting": _gap("irate", _spring(_detected), _spring(_alerted)),
}

_FAILED = "STATUS_CODE_ERROR"

TRACING: dict[str, Panel] = {
    "spans": lambda p: p.inc("traces_spanmetrics_calls_total", service_re=p.service),
    "error_spans": lambda p: p.inc("traces_spanmetrics_calls_total", service_re=p.service, status_code=_FAILED),
    # no floor here: nothing over nothing has no value
    "mean_duration": lambda p: S.safe_ratio(
        p.rate("traces_spanmetrics_latency_sum", service_re=p.service),
        p.rate("traces_spanmetrics_latency_count", service_re=p.service), floor=None),
    "span_rate": lambda p: p.rate("traces_spanmetrics_calls_total", ["service"], service_re=p.service),
    "error_rate": lambda p: p.rate("traces_spanmetrics_calls_total", ["service"], service_re=p.service, status_code=_FAILED),
    "p95_duration": lambda p: p.quantile("traces_spanmetrics_latency_bucket", 0.95, ["service"], service_re=p.service),
    "p50_duration": lambda p: p.quantile("traces_spanmetrics_latency_bucket", 0.50, ["service"], service_re=p.service),
    "edge_rate": lambda p: p.rate("traces_service_graph_request_total", ["client", "server"]),
    "edge_p95": lambda p: p.quantile("traces_service_graph_request_server_seconds_bucket", 0.95, ["client", "server"]),
    "top_operations": lambda p: top_k(
        p.rate("traces_spanmetrics_calls_total", ["service", "span_name", "span_kind"], service_re=p.service), "value", 15),
}

BOARDS = {
    "alerting": ALERTING, "capacity": CAPACITY, "messaging": MESSAGING, "overview": OVERVIEW,
    "throughput": THROUGHPUT, "tracing": TRACING,
}


def show(board: Board, panels: dict[str, Panel]) -> DataFrame:
    """All panels of a dashboard in one table: panel, labels as text, value."""
    if board.totals is None:
        for panel in panels.values():
            panel(board)
        board.compute()
    out = None
    for name, panel in panels.items():
        df = panel(board)
        labels = [c for c in df.columns if c != "value"]
        text = F.concat_ws(",", *(F.concat(F.lit(f"{c}="), F.col(c)) for c in labels)) if labels else F.lit("")
        row = df.select(F.lit(name).alias("panel"), text.alias("labels"), F.col("value").cast("double").alias("value"))
        out = row if out is None else out.unionByName(row)
    return out
