"""Metric samples derived from `events`: each event moves the counters its type stands for.

Time is compressed by 60, counters are scraped on a 15 s grid, and one instance restarts once.
"""

from __future__ import annotations

from datetime import datetime, timedelta, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.ordered import Running, prefix
from .tables import BASE_US, read

STEP_US = 15_000_000
SCRAPE = timedelta(microseconds=STEP_US)
SHRINK = 60
NODES = 4
RESTARTED = "node-1"


def _at(hours: int, minutes: int = 0) -> datetime:
    return datetime(2024, 1, 1, hours, minutes, tzinfo=timezone.utc)


RESTART, T0, T1 = _at(6, 5), _at(5, 50), _at(6, 20)

# Services, label names and the metric each event type moves.
TX_APP, FRAUD_APP, ALERT_APP = "transaction-service", "fraud-detection-service", "alert-service"
TYPES = ("purchase", "click", "view", "signup", "error")
BUCKETS = ("5", "10", "25", "50", "100", "+Inf")
LABELS = (
    "application", "job", "uri", "status", "channel", "outcome", "decision", "rule", "le", "area", "topic",
    "consumergroup", "partition", "datname", "service", "span_name", "span_kind", "status_code", "client", "server",
)
URIS = {"purchase": "/api/v1/transactions", "view": "/api/v1/transactions", "error": "/api/v1/transactions",
        "click": "/api/v1/webhooks/transactions", "signup": "/api/v1/webhooks/transactions"}
STATUS = {"purchase": "201", "view": "201", "click": "201", "signup": "400", "error": "500"}
CHANNEL = {"purchase": "api", "view": "api", "error": "api", "click": "webhook", "signup": "webhook"}
RULE_OF = {"purchase": "HIGH_AMOUNT", "click": "HIGH_VELOCITY", "view": "COUNTRY_CHANGE_IN_SHORT_WINDOW",
           "signup": "HIGH_RISK_MERCHANT"}
SERVER_OF = {"purchase": FRAUD_APP, "click": FRAUD_APP, "view": ALERT_APP, "signup": ALERT_APP, "error": FRAUD_APP}


def moves() -> list[dict]:
    """What one event of a type adds: metric name, labels, unit (one, value, ms) and the largest value
    that still counts (for cumulative buckets)."""
    rows: list[dict] = []

    def add(types, name, unit="one", top=None, **labels):
        for event_type in types:
            found = {k: (v[event_type] if isinstance(v, dict) else v) for k, v in labels.items()}
            rows.append({"event_type": event_type, "name": name, "unit": unit, "top": top, "labels": found})

    good = ("purchase", "click", "view", "signup")
    job = dict(job="spring-services")
    web = dict(application=TX_APP, uri=URIS, status=STATUS, **job)
    add(TYPES, "http_server_requests_seconds_count", **web)
    add(TYPES, "http_server_requests_seconds_sum", "ms", **web)
    for le in BUCKETS:
        add(TYPES, "http_server_requests_seconds_bucket", top=None if le == "+Inf" else float(le), le=le, **web)
        spans = dict(service=SERVER_OF, le=le)
        add(TYPES, "traces_spanmetrics_latency_bucket", top=None if le == "+Inf" else float(le), **spans)
        add(TYPES, "traces_service_graph_request_server_seconds_bucket", top=None if le == "+Inf" else float(le),
            client=TX_APP, server=SERVER_OF, le=le)
    add(TYPES, "transactions_received_total", application=TX_APP, channel=CHANNEL, **job)
    add(good, "transaction_events_published_total", application=TX_APP, outcome="success", **job)
    add(("error",), "transaction_events_published_total", application=TX_APP, outcome="failed", **job)
    add(good, "fraud_events_consumed_total", application=FRAUD_APP, **job)
    add(("purchase",), "fraud_decisions_total", application=FRAUD_APP, decision="fraud", **job)
    add(("click", "view"), "fraud_decisions_total", application=FRAUD_APP, decision="clean", **job)
    add(good, "fraud_rule_hits_total", application=FRAUD_APP, rule=RULE_OF, **job)
    add(("purchase",), "fraud_events_published_total", application=FRAUD_APP, outcome="success", **job)
    add(("error",), "fraud_events_published_total", application=FRAUD_APP, outcome="failed", **job)
    add(("purchase",), "fraud_alerts_total", application=ALERT_APP, **job)
    add(("purchase",), "fraud_alert_risk_score_count", application=ALERT_APP, **job)
    add(("purchase",), "fraud_alert_risk_score_sum", "value", application=ALERT_APP, **job)
    add(("purchase",), "fraud_alert_notifications_total", application=ALERT_APP, channel="log", outcome="success", **job)
    add(("signup",), "fraud_alert_notifications_total", application=ALERT_APP, channel="email", outcome="failed", **job)
    add(("view",), "fraud_alert_notifications_total", application=ALERT_APP, channel="email", outcome="success", **job)
    for base, types, app in (
        ("transaction_event_publish_latency_seconds", TYPES, TX_APP),
        ("fraud_evaluation_latency_seconds", ("click", "view", "purchase"), FRAUD_APP),
        ("fraud_alert_notification_latency_seconds", ("purchase", "view"), ALERT_APP),
    ):
        add(types, f"{base}_count", application=app, **job)
        add(types, f"{base}_sum", "ms" if app != ALERT_APP else "value", application=app, **job)
    add(("error",), "kafka_dlq_events_received_total", application=FRAUD_APP, **job)
    add(("signup",), "kafka_dlq_events_received_total", application=ALERT_APP, **job)
    add(("error",), "kafka_dlq_events_reprocessed_total", application=FRAUD_APP, **job)
    add(("signup",), "kafka_dlq_events_failed_total", application=ALERT_APP, **job)
    add(TYPES, "kafka_producer_record_send_total", application=TX_APP, **job)
    add(good, "kafka_consumer_records_consumed_total", application=FRAUD_APP, **job)
    topic = dict(topic="transactions.created", partition="*", job="kafka-exporter")
    add(TYPES, "kafka_topic_partition_current_offset", **topic)
    add(TYPES, "kafka_topic_partitions", **topic)
    add(good, "kafka_consumergroup_current_offset", consumergroup=FRAUD_APP, **topic)
    add(("click",), "up", job="kafka-exporter")
    apps = {"purchase": TX_APP, "click": FRAUD_APP, "view": ALERT_APP}
    three = ("purchase", "click", "view")
    for name, unit in (("up", "one"), ("hikaricp_connections_active", "one"), ("hikaricp_connections_pending", "value"),
                       ("hikaricp_connections_max", "ms"), ("process_cpu_usage", "ms"), ("system_cpu_count", "one")):
        add(three, name, unit, application=apps, **job)
    add(three, "jvm_memory_used_bytes", "value", application=apps, area="heap", **job)
    for name, kind in (("pg_up", "view"), ("pg_stat_database_xact_commit", "purchase"), ("pg_stat_database_xact_rollback", "error"),
                       ("pg_stat_database_deadlocks", "signup"), ("pg_stat_database_numbackends", "click")):
        add((kind,), name, datname="fraud", job="postgres-exporter")
    span = dict(service=SERVER_OF, span_name={t: f"handle {t}" for t in TYPES}, span_kind="SPAN_KIND_SERVER",
                status_code={**{t: "STATUS_CODE_UNSET" for t in good}, "error": "STATUS_CODE_ERROR"})
    add(TYPES, "traces_spanmetrics_calls_total", **span)
    add(TYPES, "traces_spanmetrics_latency_sum", "ms", service=SERVER_OF)
    add(TYPES, "traces_spanmetrics_latency_count", service=SERVER_OF)
    add(TYPES, "traces_service_graph_request_total", client=TX_APP, server=SERVER_OF)
    return rows


def label_text(labels: dict) -> str:
    return ",".join(f"{k}={v}" for k, v in sorted(labels.items()))


def _steps(events: DataFrame) -> int:
    first, last = events.agg(F.min("us"), F.max("us")).first()
    return 1 if first is None else (last - first) // STEP_US + 2


def samples(spark: SparkSession, folder: str, names: list[str] | None = None) -> DataFrame:
    """Samples of the named metrics (all when not given): one per series and step in which it moved."""
    wanted = [m for m in moves() if names is None or m["name"] in names]
    # the table of moves is fixed and small
    table = spark.createDataFrame(
        [(m["event_type"], m["name"], m["unit"], m["top"], label_text(m["labels"])) for m in wanted],
        "event_type string, name string, unit string, top double, labels_text string",
    )
    events = read(spark, folder, "events").select(
        "event_type", "value", (F.col("user_id") % NODES).alias("node"),
        F.expr(f"{BASE_US} + (unix_micros(cast(ts as timestamp)) - {BASE_US}) div {SHRINK}").alias("us"),
    )
    # events shrink to one row per type, node and step before they are multiplied by the metrics they move
    slot = F.ceil(F.col("us") / F.lit(STEP_US)).cast("long")
    tops = sorted({m["top"] for m in wanted if m["top"] is not None})
    counted = events.groupBy("event_type", "node", slot.alias("slot")).agg(
        (F.count(F.lit(1)) * 1000).alias("one"),
        F.sum(F.round(F.col("value") * 1000).cast("long")).alias("value"),
        F.sum(F.round("value").cast("long")).alias("ms"),
        *((F.count(F.when(F.col("value") <= top, 1)) * 1000).alias(f"upto_{i}") for i, top in enumerate(tops)),
    )
    step = F.when(F.col("unit") == "value", F.col("value")).when(F.col("unit") == "ms", F.col("ms"))
    for i, top in enumerate(tops):
        step = step.when(F.col("top") == top, F.nullif(F.col(f"upto_{i}"), F.lit(0)))
    moved = counted.join(F.broadcast(table), "event_type").withColumn(
        "step", step.when(F.col("top").isNull(), F.col("one"))
    )
    node = F.concat(F.lit("node-"), F.col("node").cast("string"))
    text = F.replace(F.col("labels_text"), F.lit("partition=*"), F.concat(F.lit("partition="), F.col("node").cast("string")))
    per_step = moved.filter("step is not null").groupBy("name", text.alias("text"), node.alias("instance"), "slot").agg(
        F.sum("step").alias("step")
    )
    restart = int(RESTART.timestamp()) * 1_000_000 // STEP_US
    lives = per_step.withColumn("life", ((F.col("instance") == RESTARTED) & (F.col("slot") >= restart)).cast("int"))
    running = prefix(
        lives, ["name", "text", "instance", "life"], ["slot"], [Running("total", "sum", F.col("step"), inclusive=True)],
        # a series has one row per step at most, so the time the events span bounds its length
        bound=_steps(events),
    )
    return running.select(
        F.timestamp_micros(F.col("slot") * STEP_US).alias("ts"),
        "name",
        F.map_concat(F.expr("str_to_map(text, ',', '=')"), F.create_map(F.lit("instance"), F.col("instance"))).alias("labels"),
        (F.col("total") / 1000.0).alias("value"),
    )
