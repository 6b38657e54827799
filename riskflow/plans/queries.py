"""One query per operator, over the whole given tables. Column names match the SQL in `oracles.py`."""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime, timedelta, timezone

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schemas
from ..functions import labels, mapping, text, validation
from ..operators import alerts as A
from ..operators import counts as C
from ..operators import delivery, history, logs, ordered, outbox, rules, series, slo, traces
from ..session import settled, shared_folder
from ..sources import files
from ..sources import tables as stored
from ..sources.ids import IdIndex
from ..sources.tables import Batch
from ..streaming import jobs, late, ledger, pairs, watch
from . import panels
from . import samples as M
from . import tables as T

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(fn: Query) -> Query:
    QUERIES[fn.__name__] = fn
    return fn


def _time(*parts: int) -> datetime:
    return datetime(2024, 1, *parts, tzinfo=timezone.utc)


def us(col: Column | str, out: str) -> Column:
    return F.unix_micros(col).alias(out)


def joined(col: Column | str, out: str) -> Column:
    return F.array_join(col, ",").alias(out)


# ------------------------------------------------------------------ scoring


@query
def score_transactions(spark, folder):
    s = T.scored(spark, folder)
    return s.select("event_id", "user_id", "prior_count", "risk_score", "fraudulent", joined("reasons", "reasons"))


@query
def velocity_count(spark, folder):
    counted = history.velocity_count(T.transactions(spark, folder).select("seq", "user_id", "occurred_at"))
    return counted.select("seq", "prior_count")


@query
def trailing_ten_minutes(spark, folder):
    tx = T.transactions(spark, folder).select("seq", "country", "occurred_at")
    return history.trailing_count(tx, "country", "occurred_at", "seq", timedelta(minutes=10), "n").select("seq", "n")


@query
def last_transaction(spark, folder):
    tx = T.transactions(spark, folder).select("seq", "user_id", "occurred_at", "country")
    done = history.last_transaction(tx)
    return done.select("seq", F.coalesce("prev_country", F.lit("")).alias("prev_country"),
                       F.coalesce(F.unix_micros("prev_occurred_at"), F.lit(-1)).alias("prev_us"))


@query
def previous_row(spark, folder):
    tx = T.transactions(spark, folder).select("seq", "user_id", "occurred_at", "transaction_id")
    done = ordered.previous_row(tx, ["user_id"], ["occurred_at", "seq"], ["transaction_id"])
    return done.select("transaction_id", F.coalesce("prev_transaction_id", F.lit("")).alias("prev_transaction_id"))


@query
def latest_arrived(spark, folder):
    """Lines arrive in item order, with ship dates in any order."""
    items = T.read(spark, folder, "lineitem").select(
        "l_suppkey", "l_shipdate", F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").alias("seq"),
        "l_quantity",
    )
    done = ordered.latest_arrived(items, ["l_suppkey"], "l_shipdate", "seq", ["l_quantity"])
    return done.select("seq", F.coalesce("prev_l_quantity", F.lit(-1.0)).alias("prev_quantity"))


@query
def score_against_history(spark, folder):
    """The second part of the day scored against the stored first part."""
    tx = T.transactions(spark, folder)
    cut = F.lit(_time(1, 0, 15))
    done = rules.score_batch(tx.filter(F.col("occurred_at") >= cut), tx.filter(F.col("occurred_at") < cut))
    return done.select("event_id", "prior_count", "risk_score", joined("reasons", "reasons"))


@query
def listed_merchants(spark, folder):
    """Membership in a table of merchants, ignoring case."""
    listed = T.read(spark, folder, "supplier").select(F.concat(F.lit("mrc-"), F.col("s_nationkey") + 100).alias("m"))
    done = rules.flag_listed(T.transactions(spark, folder), "merchant_id", listed, "m")
    return done.select("transaction_id", "listed")


@query
def custom_rules(spark, folder):
    """A user's own rule next to two standard ones."""
    config = rules.RuleConfig(high_risk_merchants=("mrc-110", "MRC-999"))
    own = rules.Rule("CASH_PAYMENT", F.col("payment_method") == "CASH", 50)
    chosen = [rules.high_amount(config), own, rules.high_risk_merchant(config)]
    done = rules.evaluate(T.transactions(spark, folder), chosen, threshold=60)
    return done.select("event_id", "risk_score", "fraudulent", joined("reasons", "reasons"))


@query
def fraud_events(spark, folder):
    found = T.scored(spark, folder).withColumn("trace_id", F.when(F.col("event_type") != "error", T.trace_id()))
    done = mapping.to_fraud_events(found, rules.RULE_VERSION, F.col("occurred_at") + F.expr("interval 1 second"))
    return done.select("eventId", us("occurredAt", "us"), "transactionId", F.coalesce("traceId", F.lit("")).alias("traceId"),
                       "userId", "riskScore", joined("reasons", "reasons"), "ruleVersion")


@query
def decisions_by_label(spark, folder):
    return C.decisions_by_label(T.scored(spark, folder))


@query
def rule_hits(spark, folder):
    return C.rule_hits(T.scored(spark, folder))


# ------------------------------------------------------------------ requests and functions


@query
def validate_requests(spark, folder):
    done = validation.validate_requests(T.requests(spark, folder))
    entries = F.array_sort(F.transform(F.map_entries("errors"), lambda e: F.concat_ws(": ", e["key"], e["value"])))
    return done.select("request_id", F.array_join(entries, "; ").alias("errors"))


@query
def rejected_requests(spark, folder):
    _, bad = validation.split_valid(validation.validate_requests(T.requests(spark, folder)))
    fields = bad.select(F.explode("errors").alias("field", "message"))
    return fields.groupBy("field", "message").agg(F.count(F.lit(1)).alias("n"))


@query
def accepted_transactions(spark, folder):
    ok, _ = validation.split_valid(validation.validate_requests(T.requests(spark, folder)))
    done = mapping.to_transactions(ok)
    return done.select("id", "user_id", (F.col("amount") * 100).cast("long").alias("cents"), "currency", "merchant_id",
                       "country", "payment_method", us("created_at", "us"))


@query
def created_events(spark, folder):
    ok, _ = validation.split_valid(validation.validate_requests(T.requests(spark, folder)))
    done = mapping.to_created_events(ok, trace=F.concat(F.lit("trace-"), "request_id"))
    return done.select("eventId", us("occurredAt", "us"), "transactionId", "traceId", "userId",
                       (F.col("amount") * 100).cast("long").alias("cents"), "currency", "merchantId", "country", "paymentMethod")


@query
def normalized_codes(spark, folder):
    tx = T.transactions(spark, folder)
    dirty = F.concat(F.lit("\t "), F.lower("country"), F.lit(" \n"))
    channel = F.when(F.col("event_type") == "view", "  ").when(F.col("event_type") == "click", "WebHook").when(
        F.col("event_type") != "error", F.col("event_type"))
    return tx.select("event_id", text.normalize_code(dirty).alias("code"), text.normalize_channel(channel).alias("channel"))


@query
def trace_ids(spark, folder):
    tx = T.transactions(spark, folder)
    digest = F.upper(T.trace_id())
    dashed = F.concat_ws("-", F.substring(digest, 1, 8), F.substring(digest, 9, 24))
    kind = F.col("event_type")
    trace = F.when(kind == "error", "  ").when(kind == "view", F.concat(digest, F.lit("0"))).when(
        kind == "click", F.concat(F.lit(" "), dashed, F.lit("\t"))).otherwise(digest)
    span = F.when(kind == "signup", "xyz").otherwise(F.substring(F.sha2("event_id", 256), 1, 16))
    blank = F.lit("")
    return tx.select(
        "event_id",
        F.coalesce(text.normalize_hex(trace, 32), blank).alias("hex"),
        text.resolve_trace_id(trace, F.lit("context")).alias("resolved"),
        text.resolve_trace_id(trace, generate_from="event_id").alias("generated"),
        F.coalesce(text.traceparent(trace, span, F.col("seq") % 2 == 0), blank).alias("traceparent"),
        F.coalesce(text.trim_to_null(trace), F.lit("none")).alias("trimmed"),
        text.trim_to_empty(trace).alias("trimmed_empty"),
    )


@query
def user_hash(spark, folder):
    return T.transactions(spark, folder).select("user_id").distinct().select("user_id", text.user_hash("user_id").alias("user_hash"))


@query
def payload_round_trip(spark, folder):
    """Every event to JSON and back; error events are encoded twice and repaired."""
    events = T.created_events(spark, folder)
    once = mapping.to_payload([f.name for f in schemas.CREATED_EVENT.fields])
    quoted = F.regexp_replace(F.to_json(F.array(once)), r"^\[|\]$", "")
    sent = events.select(F.when(F.col("event_type") == "error", quoted).otherwise(once).alias("payload"))
    back = sent.select(mapping.from_payload(text.unwrap_json("payload"), schemas.CREATED_EVENT).alias("e"))
    return back.select("e.eventId", us("e.occurredAt", "us"), "e.userId", (F.col("e.amount") * 100).cast("long").alias("cents"),
                       F.coalesce("e.traceId", F.lit("")).alias("traceId"))


@query
def error_texts(spark, folder):
    """Messages from the documents, long and short; every seventh is missing or blank."""
    docs = T.read(spark, folder, "documents")
    message = F.when(F.col("doc_id") % 14 == 0, "  ").when(F.col("doc_id") % 7 != 0, F.col("text"))
    return docs.select("doc_id", text.error_text(message, F.col("source")).alias("error"))


@query
def ingest_lag(spark, folder):
    tx = T.transactions(spark, folder)
    at = F.when(F.col("event_type") != "error", F.col("occurred_at"))
    now = F.lit(_time(1, 0, 20))
    return tx.select("event_id", text.lag_ms(at, now).alias("lag_ms"), us(text.event_time(at, now), "us"))


def _flawed(spark, folder) -> DataFrame:
    """Deliveries some of which can never be stored."""
    tx = T.deliveries(spark, folder)
    kind = F.col("event_type")
    cents = (F.col("amount") * 100).cast("long")
    return tx.withColumns(
        {
            "event_id": F.when((kind == "error") & (cents % 3 == 0), F.lit(None)).otherwise(F.col("event_id")),
            "currency": F.when((kind == "view") & (cents % 3 == 1), "EURO").otherwise(F.col("currency")),
            "country": F.when((kind == "click") & (cents % 3 == 1), F.lit(None)).otherwise(F.col("country")),
            "amount": F.when((kind == "signup") & (cents % 3 == 2), F.lit("1e17").cast("decimal(28,9)")).otherwise(
                F.col("amount").cast("decimal(28,9)")),
        }
    )


@query
def poison_reasons(spark, folder):
    rows = _flawed(spark, folder)
    reason = validation.poison_reason(rows, validation.TRANSACTION_REQUIRED)
    return rows.select("transaction_id", "seq", F.coalesce(reason, F.lit("")).alias("error_code"))


@query
def dead_letters(spark, folder):
    rows = _flawed(spark, folder)
    _, dead = delivery.route_dlq(rows, validation.poison_reason(rows, validation.TRANSACTION_REQUIRED), files.TRANSACTIONS_TOPIC)
    return dead.select("topic", "key", F.get_json_object("value", "$.userId").alias("user_id"), "error_code")


@query
def tombstones(spark, folder):
    """Records with and without a payload."""
    tx = T.transactions(spark, folder)
    records = tx.select("event_type", F.when(F.col("event_type") != "error", F.to_json(F.struct("event_id"))).alias("value"))
    full, empty = validation.drop_tombstones(records)
    counted = full.select(F.lit("processed").alias("outcome")).unionAll(empty.select(F.lit("EMPTY_EVENT_PAYLOAD")))
    return C.outcome_counts(counted)


@query
def severity_labels(spark, folder):
    s = T.scored(spark, folder)
    return s.select("event_id", labels.severity("risk_score").alias("severity"), labels.severity_color("risk_score").alias("color"))


@query
def reason_text(spark, folder):
    """Lists of reasons, some empty or with gaps, to text and back."""
    s = T.scored(spark, folder)
    listed = F.when(F.col("event_type") == "view", F.concat("reasons", F.array(F.lit("A"), F.lit(""), F.lit("")))).when(
        F.col("event_type") == "click", F.concat("reasons", F.array(F.lit(None).cast("string")))).otherwise(F.col("reasons"))
    kept = s.select("event_id", text.join_reasons(listed).alias("reasons"))
    parts = text.split_reasons("reasons")
    return kept.select("event_id", "reasons", F.size(parts).alias("n"), F.array_join(parts, "|").alias("parts"))


@query
def status_classes(spark, folder):
    return C.status_classes(T.load_results(spark, folder))


# ------------------------------------------------------------------ delivery


@query
def first_arrivals(spark, folder):
    return ordered.first_arrival(T.deliveries(spark, folder), ["event_id"], "seq").select("event_id", "seq", "user_id")


@query
def not_yet_processed(spark, folder):
    done = T.transactions(spark, folder).filter(F.col("event_type") == "signup").select("event_id")
    return delivery.drop_processed(T.deliveries(spark, folder), done).select("event_id", "seq")


@query
def processed_markers(spark, folder):
    """Markers of processed events, those older than the cutoff removed."""
    markers = delivery.processed_markers(T.transactions(spark, folder))
    kept = history.expire(markers, "processed_at", _time(1, 6))
    return kept.select("event_id", us("processed_at", "us"))


@query
def latest_per_user(spark, folder):
    tx = T.transactions(spark, folder).select("user_id", "occurred_at", "seq", "country", "merchant_id")
    return ordered.latest_per_key(tx, ["user_id"], "occurred_at", "seq").select("user_id", "seq", "country", "merchant_id")


@query
def late_rows(spark, folder):
    """Lines arriving in item order; a line is late when a line shipped a year later came before it."""
    items = T.read(spark, folder, "lineitem").select(
        F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").alias("seq"), "l_shipdate")
    return jobs.mark_late(items, "l_shipdate", "seq", timedelta(days=365)).select("seq", "late")


@query
def stage_funnel(spark, folder):
    """Decisions are missing for errors, and alerts for views; all of it from one scored table."""
    scored = settled(T.scored(spark, folder))
    decided = scored.filter(F.col("event_type") != "error")
    alerts = scored.filter(F.col("fraudulent") & (F.col("event_type") != "view"))
    return delivery.stage_funnel(scored, decided, alerts)


@query
def attempt_numbers(spark, folder):
    """Line items of an order as its delivery attempts."""
    items = T.read(spark, folder, "lineitem").select(
        "l_orderkey", F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").alias("item"))
    return C.attempt_number(items, "l_orderkey", "item")


# ------------------------------------------------------------------ alerts


def _flat(alerts: DataFrame) -> DataFrame:
    return alerts.select("id", "transaction_id", "user_id", "risk_score", "reasons", us("created_at", "created_us"),
                         "source_event_id", F.coalesce("trace_id", F.lit("")).alias("trace_id"))


@query
def list_alerts(spark, folder):
    return _flat(A.list_alerts(T.alerts(spark, folder)))


@query
def alert_view(spark, folder):
    viewed = mapping.alert_view(T.alerts(spark, folder))
    return viewed.select("id", F.size("reasons").alias("n"), F.array_join("reasons", "|").alias("parts"))


@query
def alerts_for_users(spark, folder):
    users = T.read(spark, folder, "customer").filter("c_mktsegment = 'BUILDING'").select(
        F.concat(F.lit("user-"), "c_custkey").alias("user_id"))
    return A.alerts_for_users(T.alerts(spark, folder), users).select("id", "user_id", "risk_score")


@query
def fan_out(spark, folder):
    channels = A.Channels(email_enabled=True, email_to=("risk@example.org",))
    return A.fan_out(T.alerts(spark, folder), channels).select("id", "position", "channel")


@query
def notification_content(spark, folder):
    marked = T.alerts(spark, folder).withColumns(
        {"user_id": F.concat(F.lit("<"), "user_id", F.lit("> & co")), "reasons": F.replace("reasons", F.lit(","), F.lit(" , "))})
    done = mapping.notification_content(marked)
    return done.select("alert_id", "subject", "severity", "color", "user_html", "score_text", "detected_at",
                       F.array_join("reasons_html", "|").alias("reasons_html"))


@query
def alerts_of_one_user(spark, folder):
    """Newest first, of the user with most alerts; equal counts go to the lesser name."""
    raised = T.alerts(spark, folder)
    user = raised.groupBy("user_id").count().orderBy(F.desc("count"), "user_id").first()
    return A.list_alerts_by_user(raised, user.user_id if user else "").select("id", "user_id", "risk_score", us("created_at", "created_us"))


def _log(row: dict) -> None:
    return None


def _mail(row: dict) -> None:
    """A mail server that takes high scores at the second attempt only, and the highest never."""
    if row["risk_score"] >= 90 or (row["risk_score"] >= 70 and row["attempt"] < 2):
        raise TimeoutError("mail server is busy")


@query
def alerts_delivered(spark, folder):
    """Own senders per channel, over a ledger: passes a second apart until nothing is left to try, and one batch twice."""
    out = _fresh_folder(spark)
    raised = settled(T.alerts(spark, folder))
    book = ledger.Ledger(spark, f"{out}/ledger", ledger.Policy(attempts=3, delay=timedelta(seconds=1), growth=2.0))
    channels = A.Channels(email_enabled=True, email_to=("risk@example.org",))
    for number, seconds in ((0, 0), (1, 1), (1, 30), (2, 2), (3, 3), (4, 60)):
        ledger.notify(raised, channels, {"log": _log, "email": _mail}, book, Batch("alerts", number), _NOW + timedelta(seconds=seconds))
    return ledger.notifications(book).select("alert_id", "channel", "outcome", "attempt")


@query
def triage_count(spark, folder):
    return A.alert_count(T.alerts(spark, folder), _time(1, 0, 5), _time(1, 6))


@query
def triage_average(spark, folder):
    return A.average_risk(T.alerts(spark, folder), _time(1, 0, 5), _time(1, 6)).select(F.col("value").cast("double").alias("value"))


@query
def triage_critical_share(spark, folder):
    return A.critical_share(T.alerts(spark, folder), _time(1, 0, 5), _time(1, 6)).select(F.round("value", 9).alias("value"))


@query
def triage_timeline(spark, folder):
    return A.alert_timeline(T.alerts(spark, folder), _time(1, 0, 5), _time(1, 6)).select(us("time", "us"), "alerts")


@query
def triage_top_reasons(spark, folder):
    return A.top_reasons(T.alerts(spark, folder), _time(1, 0, 5), _time(1, 6))


@query
def triage_latest(spark, folder):
    return A.latest_alerts(T.alerts(spark, folder)).select(
        us("created_at", "us"), "alert_id", "transaction_id", "user_id", "risk_score", "reasons", "trace_id")


@query
def alerts_by_severity(spark, folder):
    return A.alerts_by_severity(T.alerts(spark, folder))


@query
def risk_summary(spark, folder):
    return A.risk_summary(T.alerts(spark, folder)).select("count", "sum", "max", F.round("mean", 6).alias("mean"))


@query
def tumbling_alerts(spark, folder):
    return series.tumbling_count(T.alerts(spark, folder), "created_at", "1 minute").select(us("start", "us"), "n")


@query
def sliding_alerts(spark, folder):
    done = series.sliding(T.alerts(spark, folder), "created_at", "10 minutes", "15 seconds")
    return done.select(us("start", "us"), "n")


# ------------------------------------------------------------------ counters and load reports


@query
def received_by_channel(spark, folder):
    named = T.requests(spark, folder).withColumn("channel", text.normalize_channel("channel"))
    return C.received_by_channel(named)


@query
def notification_outcomes(spark, folder):
    fanned = A.fan_out(T.alerts(spark, folder), A.Channels(email_enabled=True, email_to=("risk@example.org",)))
    failed = (F.col("channel") == "email") & (F.col("risk_score") >= 90)
    return C.outcome_counts(fanned.withColumn("outcome", F.when(failed, "failed").otherwise("success")), "channel", "outcome")


@query
def timer_summary(spark, folder):
    done = C.timer_summary(T.load_results(spark, folder), "latencyMs", "statusCode")
    return done.select("statusCode", "count", "total", "max", F.round("mean", 6).alias("mean"))


@query
def dead_letter_counts(spark, folder):
    rows = _flawed(spark, folder)
    bad = validation.poison_reason(rows, validation.TRANSACTION_REQUIRED).isNotNull()
    return C.dlq_counts(rows.withColumn("outcome", F.when(bad, "failed").otherwise("reprocessed")), "event_type")


@query
def load_report(spark, folder):
    done = C.load_report(T.load_results(spark, folder))
    return done.select("requests", "errors", F.round("error_rate", 9).alias("error_rate"), "p95")


@query
def trend_stats(spark, folder):
    done = C.trend_stats(T.load_results(spark, folder))
    rounded = [F.round(c, 6).alias(c) for c in ("avg", "med", "p90", "p95", "p99", "failed_share")]
    return done.select("min", "max", *rounded, "failed_ok", "latency_ok")


@query
def top_merchants_by_country(spark, folder):
    counted = T.transactions(spark, folder).groupBy("country", F.upper("merchant_id").alias("merchant")).agg(
        F.count(F.lit(1)).alias("n"))
    return C.top_k(counted, "n", 3, ["country"], ["merchant"])


# ------------------------------------------------------------------ outbox

_NOW = _time(1, 5)


def _outbox_flat(df: DataFrame) -> DataFrame:
    none = F.lit(-1).cast("long")
    return df.select("id", "event_id", "status", "attempts", us("next_attempt_at", "next_us"), us("created_at", "created_us"),
                     F.coalesce(F.unix_micros("published_at"), none).alias("published_us"),
                     F.coalesce("last_error", F.lit("")).alias("last_error"))


@query
def outbox_enqueue(spark, folder):
    rows = outbox.enqueue(T.created_events(spark, folder), files.TRANSACTIONS_TOPIC, baggage=F.concat(F.lit(" "), "userId"))
    return rows.select("id", "event_id", "topic", "event_key", F.get_json_object("payload", "$.userId").alias("user_id"),
                       F.coalesce("trace_parent", F.lit("")).alias("trace_parent"), "baggage", "status", "attempts",
                       us("next_attempt_at", "next_us"))


@query
def outbox_due(spark, folder):
    return _outbox_flat(outbox.due_batch(T.outbox_table(spark, folder), _NOW))


@query
def outbox_headers(spark, folder):
    plain = T.outbox_table(spark, folder).withColumn(
        "trace_parent", F.when(F.col("status") == "PUBLISHED", F.col("trace_parent")))
    done = outbox.publish_headers(plain)
    return done.select("id", F.coalesce("traceparent", F.lit("")).alias("traceparent"), "baggage_header")


@query
def outbox_outcomes(spark, folder):
    table = T.outbox_table(spark, folder)
    cents = T.created_events(spark, folder).select(
        F.col("eventId").alias("event_id"), (F.col("amount") * 100).cast("long").alias("cents"))
    told = table.filter("status = 'PENDING'").join(cents, "event_id").filter("cents % 3 <> 2").select(
        "id", (F.col("cents") % 3 == 0).alias("ok"),
        F.when(F.col("cents") % 2 == 0, " ").otherwise("broker down").alias("error"), F.lit("IOException").alias("error_class"))
    return _outbox_flat(outbox.apply_outcomes(table, told, _NOW))


@query
def outbox_purge(spark, folder):
    return _outbox_flat(outbox.purge_published(T.outbox_table(spark, folder), _NOW, timedelta(hours=2)))


@query
def outbox_backlog(spark, folder):
    done = outbox.outbox_backlog(T.outbox_table(spark, folder), _NOW)
    return done.select("status", "n", "attempts", us("oldest", "oldest_us"), F.round("oldest_age_seconds", 6).alias("age"))


def _refusing(row: dict) -> None:
    """A broker that refuses every third event twice."""
    import json

    cents = round(json.loads(row["payload"])["amount"] * 100)
    if cents % 3 == 0 and row["attempt"] <= 2:
        raise OSError(" " if cents % 2 == 0 else "broker down")


@query
def outbox_relayed(spark, folder):
    """The outbox after five passes of two relays, one of them repeated."""
    out = _fresh_folder(spark)
    table = T.outbox_table(spark, folder)
    stored.put_batch(table, f"{out}/outbox", Batch("app", 0), F.col("created_at"))
    book = ledger.Ledger(spark, f"{out}/ledger")
    for number, seconds in enumerate((0, 1, 2, 2, 4, 6)):
        for k in range(2):
            again = number - 1 if number == 3 else number
            ledger.relay(spark, f"{out}/outbox", book, Batch(f"relay{k}", again), _NOW + timedelta(seconds=seconds), _refusing, None, (k, 2))
    return _outbox_flat(ledger.relayed(table, book))


# ------------------------------------------------------------------ time series


@query
def metric_samples(spark, folder):
    return M.samples(spark, folder).select(series.series_key().alias("series"), us("ts", "us"), F.round("value", 6).alias("value"))


@query
def counter_deltas(spark, folder):
    done = series.counter_delta(M.samples(spark, folder, ["fraud_decisions_total"]))
    return done.select("series", us("ts", "us"), F.round(F.coalesce("delta", F.lit(-1.0)), 6).alias("delta"))


@query
def last_two_samples(spark, folder):
    kept = M.samples(spark, folder, ["transactions_received_total"]).withColumn("series", series.series_key())
    return ordered.last_samples(kept, ["series"], "ts", 2).select("series", us("ts", "us"), F.round("value", 6).alias("value"))


_RATE = timedelta(minutes=5)


def _value(df: DataFrame) -> DataFrame:
    return df.withColumn("value", F.round("value", 6))


@query
def metric_increase(spark, folder):
    kept = M.samples(spark, folder, ["transaction_events_published_total"])
    return _value(series.increase(kept, ["outcome"], M.T0, M.T1, scrape=M.SCRAPE))


@query
def metric_increase_extrapolated(spark, folder):
    kept = M.samples(spark, folder, ["transaction_events_published_total"])
    return _value(series.increase(kept, ["outcome"], M.T0, M.T1, extrapolate=True, scrape=M.SCRAPE))


@query
def metric_rate(spark, folder):
    return _value(series.rate(M.samples(spark, folder, ["http_server_requests_seconds_count"]), ["uri", "status"], M.T1, _RATE))


@query
def metric_irate(spark, folder):
    return _value(series.irate(M.samples(spark, folder, ["http_server_requests_seconds_count"]), ["application"], M.T1))


@query
def metric_gauge(spark, folder):
    return _value(series.gauge(M.samples(spark, folder, ["jvm_memory_used_bytes"]), "avg", ["application"], M.T1, timedelta(minutes=30)))


@query
def metric_mean_latency(spark, folder):
    base = "fraud_evaluation_latency_seconds"
    summary = series.summarise(M.samples(spark, folder, [f"{base}_sum", f"{base}_count"]), M.T0, M.T1, scrape=M.SCRAPE)
    return _value(series.mean_latency(summary, base, ["application"], factor=1000))


@query
def metric_fraud_ratio(spark, folder):
    summary = series.summarise(M.samples(spark, folder, ["fraud_decisions_total", "fraud_alerts_total"]), M.T0, M.T1, scrape=M.SCRAPE)
    return _value(series.safe_ratio(
        series.total(series.match(summary, "fraud_alerts_total"), "increase"),
        series.total(series.match(summary, "fraud_decisions_total", eq={"decision": "fraud"}), "increase"),
        cap=1, require_positive=True))


@query
def metric_p95(spark, folder):
    summary = series.summarise(M.samples(spark, folder, ["http_server_requests_seconds_bucket"]), M.T0, M.T1, scrape=M.SCRAPE)
    return _value(series.histogram_quantile(series.total(summary, "increase", ["le", "uri"]), 0.95, ["uri"]))


@query
def metric_consumer_lag(spark, folder):
    names = ["kafka_topic_partition_current_offset", "kafka_consumergroup_current_offset"]
    summary = series.summarise(M.samples(spark, folder, names), M.T0, M.T1, scrape=M.SCRAPE)
    place = ["topic", "partition", "instance", "job"]
    end = series.latest_vector(summary, names[0], place)
    done = series.latest_vector(summary, names[1], [*place, "consumergroup"])
    return _value(series.consumer_lag(end, done, ["consumergroup", "topic"]))


@query
def metric_label_values(spark, folder):
    return series.label_values(M.samples(spark, folder, ["http_server_requests_seconds_count"]), "http_server_requests_seconds_count", "status")


@query
def metric_match(spark, folder):
    kept = series.match(M.samples(spark, folder), ["fraud_alert_notifications_total", "http_server_requests_seconds_count"],
                        re={"outcome": "success|fail.*|"}, nre={"status": "4..|5.."}, ne={"channel": "log"})
    return kept.groupBy(series.series_key().alias("series")).agg(F.count(F.lit(1)).alias("n"))


@query
def metric_or(spark, folder):
    """Failed publications per application, or the received dead letters where there are none."""
    names = ["transaction_events_published_total", "kafka_dlq_events_received_total"]
    summary = series.summarise(M.samples(spark, folder, names), M.T0, M.T1, scrape=M.SCRAPE)
    a = series.total(series.match(summary, names[0], eq={"outcome": "failed"}), "increase", ["application"])
    b = series.total(series.match(summary, names[1]), "increase", ["application"])
    return _value(series.vector_or(a, b, ["application"]))


@query
def metric_delta(spark, folder):
    done = C.metric_delta(M.samples(spark, folder, ["fraud_alerts_total"]), "fraud_alerts_total")
    return done.select(*(F.round(c, 6).alias(c) for c in ("before", "after", "delta")))


@query
def metric_reduced(spark, folder):
    kept = M.samples(spark, folder, ["process_cpu_usage"]).withColumn("application", F.col("labels.application"))
    parts = [series.reduce_series(kept, calc, ["application"]).withColumnRenamed("value", calc) for calc in ("mean", "max", "min")]
    both = parts[0].join(parts[1], "application").join(parts[2], "application")
    return both.select("application", *(F.round(c, 6).alias(c) for c in ("mean", "max", "min")))


@query
def rate_by_step(spark, folder):
    kept = M.samples(spark, folder, ["fraud_decisions_total"])
    return _value(series.rate_steps(kept, ["decision"], _RATE)).select("k", "decision", "value")


@query
def reduced_by_step(spark, folder):
    """All reducers of a panel over a series of steps."""
    kept = M.samples(spark, folder, ["fraud_decisions_total"])
    rates = settled(series.rate_steps(kept, ["decision"], _RATE))
    out = None
    for calc in ("last", "mean", "max", "min", "sum"):
        part = series.reduce_series(rates, calc, ["decision"], ts="k").select("decision", F.lit(calc).alias("calc"), F.round("value", 6).alias("value"))
        out = part if out is None else out.unionByName(part)
    return out


@query
def irate_by_step(spark, folder):
    kept = M.samples(spark, folder, ["http_server_requests_seconds_count"])
    return _value(series.irate_steps(kept, ["application"])).select("k", "application", "value")


@query
def gauge_by_step(spark, folder):
    kept = M.samples(spark, folder, ["jvm_memory_used_bytes"])
    return _value(series.gauge_steps(kept, "avg", ["application"])).select("k", "application", "value")


@query
def mean_latency_by_step(spark, folder):
    base = "fraud_evaluation_latency_seconds"
    kept = M.samples(spark, folder, [f"{base}_sum", f"{base}_count"])
    return _value(series.mean_latency_steps(kept, base, ["application"], _RATE, 1000)).select("k", "application", "value")


@query
def quantile_by_step(spark, folder):
    kept = M.samples(spark, folder, ["http_server_requests_seconds_bucket"])
    done = _value(series.quantile_steps(kept, 0.95, ["uri"], _RATE)).select("k", "uri", "value")
    return done.filter(~F.isnan("value"))  # steps in whose range nothing was requested


@query
def top_series_by_step(spark, folder):
    """The two URIs with most requests at every step."""
    kept = M.samples(spark, folder, ["http_server_requests_seconds_count"])
    rates = _value(series.rate_steps(kept, ["uri"], _RATE))
    return C.top_k(rates, "value", 2, ["k"], ["uri"]).select("k", "uri", "value")


@query
def stage_gap_by_step(spark, folder):
    kept = M.samples(spark, folder, ["transaction_events_published_total", "fraud_events_consumed_total"])
    a = series.match(kept, "transaction_events_published_total", eq={"outcome": "success"})
    b = series.match(kept, "fraud_events_consumed_total")
    return _value(series.stage_gap(a, b, _RATE)).select(us("ts", "us"), "value")


@query
def stream_funnel(spark, folder):
    """The stages of every transaction as streams, answers of every second one before it: decisions are missing for errors, alerts for views."""
    out, scored = _fresh_folder(spark), settled(T.scored(spark, folder).select("transaction_id", "occurred_at", "event_type", "fraudulent", "seq"))
    closing = spark.createDataFrame([("closing", _time(30) + timedelta(days=1000), False)], "transaction_id string, at timestamp, fraudulent boolean")
    after = lambda rows, seconds: rows.select("transaction_id", (F.col("occurred_at") + F.expr(f"interval {seconds} seconds")).alias("at"), "fraudulent", "seq")
    decided = scored.filter("event_type <> 'error'")
    rows = {"asked": after(scored, 0), "decided": after(decided, 1), "fraud": after(decided.filter("fraudulent"), 1),
            "alerts": after(decided.filter("fraudulent and event_type <> 'view'"), 2)}
    odd = F.col("seq") % 2 == 1
    for n in range(3):
        for name, part in rows.items():
            early = name in ("decided", "alerts")
            mine = closing if n == 2 else part.filter(odd if (n == 0) == early else ~odd).drop("seq")
            mine.write.mode("append").parquet(f"{out}/{name}")
        read = {name: spark.readStream.schema(closing.schema).parquet(f"{out}/{name}") for name in rows}
        for stage, asked, answered in ((pairs.DECISION, "asked", "decided"), (pairs.ALERT, "fraud", "alerts")):
            pairs.stage_stream(read[asked], read[answered], f"{out}/steps", f"{out}/c-{stage}", stage, delay=timedelta(days=400)).awaitTermination()
    waiting = pairs.stuck(spark, f"{out}/steps").select("stage", "transaction_id", F.lit(False).alias("answered"))
    steps = stored.read_table(spark, f"{out}/steps", pairs.STEPS).filter("answered_at is not null").select("stage", "transaction_id", F.lit(True).alias("answered"))
    return steps.unionByName(waiting).filter("transaction_id <> 'closing'")


@query
def stream_service_graph(spark, folder):
    """Spans as a stream, half of the answers before their calls; answers of seventh lines never come. Calls without one are named with an empty server."""
    out = _fresh_folder(spark)
    # seven years of ship dates within some days
    near = F.timestamp_micros(F.lit(int(_time(1).timestamp()) * 10**6) + F.floor(F.unix_micros("start") / 1440).cast("long"))
    spans = T.spans(spark, folder).filter("not (kind = 'CONSUMER' and name = 'line 7')").withColumn("start", near)
    closing = spark.createDataFrame([(t, t, p, "closing", "", k, "", _time(30) + timedelta(days=40_000), 1.0) for t, p, k in (("x", None, "CLIENT"), ("y", "x", "SERVER"))], schemas.SPAN)
    first = (F.pmod(F.xxhash64("trace_id"), F.lit(2)) == 1) == (F.col("kind") == "CONSUMER")
    names = [f.name for f in schemas.SPAN.fields]
    for part in (spans.filter(first), spans.filter(~first), closing):
        part.select(names).write.mode("append").option("compression", "zstd").parquet(f"{out}/spans")
        pairs.graph_stream(files.stream_spans(spark, f"{out}/spans"), f"{out}/pairs", f"{out}/c", delay=timedelta(days=20_000)).awaitTermination()
    seconds = [F.round(c, 4).alias(c) for c in ("client_seconds", "server_seconds")]
    graph = pairs.graph(spark, f"{out}/pairs").select("client", "server", "requests", "failed", *seconds)
    zero = [F.lit(0.0).alias(c) for c in ("client_seconds", "server_seconds")]
    alone = pairs.expired(spark, f"{out}/pairs").filter("side = 'client'").select(
        F.col("service").alias("client"), F.lit("").alias("server"), F.col("expired").alias("requests"), F.lit(0).cast("long").alias("failed"), *zero)
    return graph.unionByName(alone).filter("client <> 'closing'")


def _in_two_parts(spark: SparkSession, folder: str, out: str) -> list[DataFrame]:
    """The transactions but every third, then every third with the error events of the others once more."""
    rows = settled(T.transactions(spark, folder).select("event_id", "occurred_at", "seq", "event_type"))
    third = F.col("seq") % 3 == 0
    return [rows.filter(~third).drop("event_type"), rows.filter(third | (F.col("event_type") == "error")).drop("event_type")]


@query
def stream_late_kept(spark, folder):
    """First arrivals of a stream whose second part is late in places, and the late rows."""
    out = _fresh_folder(spark)
    for part in _in_two_parts(spark, folder, out):
        part.write.mode("append").parquet(f"{out}/in")
        late.dedup_stream(spark.readStream.schema(part.schema).parquet(f"{out}/in"), f"{out}/first", f"{out}/late", f"{out}/c").awaitTermination()
    found = [stored.read_table(spark, f"{out}/{name}", part.schema).select("event_id", F.lit(name).alias("outcome")) for name in ("first", "late")]
    return found[0].unionByName(found[1])


@query
def stream_windows_corrected(spark, folder):
    """Counts per minute of the same stream: all rows, those that came after their minute was closed, and what was said when it closed."""
    out = _fresh_folder(spark)
    for part in _in_two_parts(spark, folder, out):
        part.write.mode("append").parquet(f"{out}/in")
        late.window_stream(spark.readStream.schema(part.schema).parquet(f"{out}/in"), f"{out}/counts", f"{out}/c", ts="occurred_at").awaitTermination()
    said = late.closed(spark, f"{out}/counts").select("time", F.col("alerts").alias("closed"))
    done = late.windows(spark, f"{out}/counts").join(said, "time", "left")
    return done.select(us("time", "us"), "alerts", "late", F.coalesce("closed", F.lit(0)).alias("closed"))


_RULE_METRICS = [
    "fraud_alerts_total", "fraud_decisions_total", "transaction_events_published_total", "fraud_alert_notifications_total",
    "fraud_evaluation_latency_seconds_sum", "fraud_evaluation_latency_seconds_count",
    "fraud_alert_notification_latency_seconds_sum", "fraud_alert_notification_latency_seconds_count",
    "kafka_dlq_events_received_total", "kafka_dlq_events_failed_total",
]


@query
def rule_states(spark, folder):
    """All service-level rules over all hours, with a small denominator floor so that slow stages count."""
    kept = settled(M.samples(spark, folder, _RULE_METRICS))
    states = slo.evaluate_rules(kept, slo.standard_rules(floor=0.0001), t0=_time(1, 0), t1=_time(1, 12), scrape=M.SCRAPE)
    return states.select(us("ts", "us"), "rule", "severity", "labels", F.round("value", 9).alias("value"), "state")


@query
def stream_rule_states(spark, folder):
    """The rules as samples arrive, in four uneven parts; the last part comes with the last one of a closed time, which is late."""
    out, kept = _fresh_folder(spark), settled(M.samples(spark, folder, _RULE_METRICS).select(*(f.name for f in schemas.SAMPLE.fields)))
    cuts = [_time(1, 0), _time(1, 5, 50), _time(1, 6, 7), _time(1, 6, 8), _time(1, 12)]
    for low, high in zip(cuts, cuts[1:]):
        series.in_window(kept, low, high).write.mode("append").parquet(f"{out}/samples")
        if high == cuts[-1]:
            series.in_window(kept, _time(1, 6, 6), cuts[-3]).write.mode("append").parquet(f"{out}/samples")
        watch.watch_rules(files.stream_samples(spark, f"{out}/samples"), f"{out}/states", f"{out}/c", slo.standard_rules(floor=0.0001),
                          late_path=f"{out}/late").awaitTermination()
    states = stored.read_table(spark, f"{out}/states", watch.STATES)
    late = stored.read_table(spark, f"{out}/late", schemas.SAMPLE).agg(F.count(F.lit(1)).alias("late"))
    done = states.select(us("ts", "us"), "rule", "severity", "labels", F.round("value", 9).alias("value"), "state")
    return done.crossJoin(F.broadcast(late))  # one row


def _board(name: str) -> Query:
    def run(spark: SparkSession, folder: str) -> DataFrame:
        kept, states = M.samples(spark, folder), None
        if name == "alerting":
            kept = settled(kept)  # for the rules and the summary
            states = settled(slo.evaluate_rules(kept, slo.standard_rules(floor=0.0001), t0=M.T0, t1=M.T1, scrape=M.SCRAPE))
        board = panels.Board(kept, M.T0, M.T1, _RATE, states, scrape=M.SCRAPE)
        return _value(panels.show(board, panels.BOARDS[name]))

    return run


for _name in panels.BOARDS:
    QUERIES[f"board_{_name}"] = _board(_name)


# ------------------------------------------------------------------ logs and traces


def _blank(df: DataFrame, *cols: str) -> list[Column]:
    return [F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in cols]


@query
def parsed_logs(spark, folder):
    done = logs.parse_logs(T.log_lines(spark, folder).drop("line_id"))
    return done.select(us("ts", "us"), "service", *_blank(done, "level", "traceId", "event", "outcome", "risk_score"))


@query
def labelled_logs(spark, folder):
    done = logs.labelled(T.log_lines(spark, folder))
    return done.select(us("ts", "us"), "service", *_blank(done, "level", "logger", "trace_id", "span_id"))


@query
def failed_events(spark, folder):
    done = logs.filter_events(logs.parse_logs(T.log_lines(spark, folder)), ".*failed|transaction_event_retry")
    return done.select(us("ts", "us"), "service", "event")


@query
def alert_logs(spark, folder):
    kept = logs.in_services(T.log_lines(spark, folder), "alert-service")
    return logs.filter_events(logs.parse_logs(kept), "fraud_alert_logged|notification_result").select(us("ts", "us"), "event", "outcome")


@query
def high_fraud_logs(spark, folder):
    kept = logs.in_services(T.log_lines(spark, folder), "fraud-detection-service")
    done = logs.filter_fields(logs.parse_logs(kept), event="fraud_decision_made", decision="fraud", risk_score__ge=80)
    return done.select(us("ts", "us"), "transactionId", "risk_score")


@query
def failed_mail_logs(spark, folder):
    done = logs.filter_fields(logs.parse_logs(T.log_lines(spark, folder)), event="notification_result", channel="email", outcome="failed")
    return done.select(us("ts", "us"), "transactionId")


@query
def log_trace_ids(spark, folder):
    return T.log_lines(spark, folder).select("line_id", F.coalesce(logs.extract_trace_id(), F.lit("")).alias("trace_id"))


@query
def event_outcomes(spark, folder):
    done = logs.event_outcomes(logs.parse_logs(T.log_lines(spark, folder)))
    return done.select("service", *_blank(done, "event", "outcome"), "n")


@query
def log_services(spark, folder):
    return logs.service_names(T.log_lines(spark, folder), "(transaction-service|fraud-detection-service|alert-service)")


@query
def span_metrics(spark, folder):
    done = traces.span_metrics(T.spans(spark, folder))
    return done.select("service", "name", "kind", "status", "calls", F.round("latency_sum", 4).alias("latency_sum"), "le", "value")


@query
def span_p95(spark, folder):
    done = traces.span_metrics(T.spans(spark, folder), by=("service",))
    return _value(series.histogram_quantile(done, 0.95, ["service"]))


@query
def service_graph(spark, folder):
    done = traces.service_graph(T.spans(spark, folder))
    return done.select("client", "server", "requests", "failed", F.round("client_seconds", 4).alias("client_seconds"),
                       F.round("server_seconds", 4).alias("server_seconds"))


@query
def service_graph_p95(spark, folder):
    done = traces.service_graph_latency(T.spans(spark, folder))
    return _value(series.histogram_quantile(done, 0.95, ["client", "server"]))


@query
def logs_for_traces(spark, folder):
    """Order lines as log lines of the order's trace, kept when they lie near a span of their service."""
    items = T.read(spark, folder, "lineitem").select(
        F.expr("cast(l_shipdate as timestamp)").alias("ts"),
        F.when(F.col("l_returnflag") == "N", "transaction-service").otherwise("fraud-detection-service").alias("service"),
        F.concat(F.lit("t"), "l_orderkey").alias("trace_id"),
        F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").alias("line_id"))
    found = traces.logs_for_trace(T.spans(spark, folder), items, timedelta(days=20))
    return found.select("line_id", "service", "spans")


# ------------------------------------------------------------------ streams


def _fresh_folder(spark: SparkSession) -> str:
    import uuid

    return f"{shared_folder(spark)}/streams/{uuid.uuid4()}"


def _stream(spark: SparkSession, folder: str) -> DataFrame:
    """The transactions as a stream over the events file."""
    return T.transactions(spark, folder, streaming=True)


@query
def stream_ingested(spark, folder):
    """Requests as a stream into the transactions table, and their events as records."""
    out = _fresh_folder(spark)
    jobs.ingest_stream(T.requests(spark, folder, streaming=True), f"{out}/transactions", f"{out}/checkpoint",
                       lambda events, n: files.write_records(files.as_records(events), path=f"{out}/events"),
                       f"{out}/rejected").awaitTermination()
    sent = spark.read.schema("key string, value string").json(f"{out}/events")
    rows = stored.read_table(spark, f"{out}/transactions", schemas.TRANSACTION).join(sent, F.col("id") == F.col("key"))
    return rows.select("id", "user_id", (F.col("amount") * 100).cast("long").alias("cents"), "currency", "country",
                       F.get_json_object("value", "$.merchantId").alias("merchant_id"), us("created_at", "us"))


@query
def stream_scored(spark, folder):
    out = _fresh_folder(spark)
    run = jobs.score_stream(_stream(spark, folder), f"{out}/history", f"{out}/decisions", f"{out}/checkpoint",
                            dlq_path=f"{out}/dlq")
    run.awaitTermination()
    return spark.read.parquet(f"{out}/decisions").select(
        "event_id", "user_id", "prior_count", "risk_score", "fraudulent", joined("reasons", "reasons"))


def _events(spark: SparkSession, folder: str) -> DataFrame:
    """The transactions as records of a stream: key, value, topic, partition, offset, and what kind of event each is."""
    return T.created_events(spark, folder).select(
        F.col("transactionId").alias("key"), mapping.to_payload([f.name for f in schemas.CREATED_EVENT.fields]).alias("value"),
        F.lit(files.TRANSACTIONS_TOPIC).alias("topic"), F.lit(0).alias("partition"), F.col("seq").alias("offset"), "event_type")


def _decisions(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path).select("event_id", "user_id", "prior_count", "risk_score", "fraudulent", joined("reasons", "reasons"))


@query
def stream_two_channels(spark, folder):
    """Requests split by channel into two streams that write one table, and one of them started anew."""
    out = _fresh_folder(spark)
    requests = T.requests(spark, folder, streaming=True)
    hook = F.coalesce(F.col("channel") == "webhook", F.lit(False))
    for name, mine in (("api", ~hook), ("hook", hook), ("none", F.lit(False))):
        jobs.ingest_stream(requests.filter(mine), f"{out}/transactions", f"{out}/{name}", lambda events, n: None, f"{out}/rejected").awaitTermination()
    rows = stored.read_table(spark, f"{out}/transactions", schemas.TRANSACTION)
    return rows.select("id", "user_id", (F.col("amount") * 100).cast("long").alias("cents"), "currency", "country", "merchant_id", us("created_at", "us"))


@query
def stream_redelivered(spark, folder):
    """Every event, then every error event once more in a second file: scored and published once."""
    out = _fresh_folder(spark)
    records = _events(spark, folder)
    again = records.filter("event_type = 'error'").withColumn("offset", F.col("offset") + 10**9)
    # without its time, an event is known by its id alone
    again = again.withColumn("value", F.regexp_replace("value", '"occurredAt":"[^"]*",', ""))
    for part in (records, again):
        files.write_records(part.drop("event_type"), path=f"{out}/in")
        jobs.score_stream(files.read_events(spark, path=f"{out}/in"), f"{out}/history", f"{out}/decisions", f"{out}/checkpoint", dlq_path=f"{out}/dlq",
                          publish=lambda events, n: files.write_records(files.as_records(events), path=f"{out}/fraud")).awaitTermination()
    sent = spark.read.schema("key string").json(f"{out}/fraud").groupBy("key").agg(F.count(F.lit(1)).alias("sent"))
    done = spark.read.parquet(f"{out}/decisions").join(sent, F.col("transaction_id") == F.col("key"), "left")
    return done.select("event_id", "risk_score", F.coalesce("sent", F.lit(0)).alias("sent"))


@query
def stream_same_transaction(spark, folder):
    """Second events of the transactions of error events go to the dead letters undecided."""
    out = _fresh_folder(spark)
    records = _events(spark, folder)
    again = records.filter("event_type = 'error'").withColumn("offset", F.col("offset") + 10**9)
    again = again.withColumn("value", F.regexp_replace("value", '"eventId":"', '"eventId":"again-'))
    for part in (records, again):
        files.write_records(part.drop("event_type"), path=f"{out}/in")
        jobs.score_stream(files.read_events(spark, path=f"{out}/in"), f"{out}/history", f"{out}/decisions", f"{out}/checkpoint", dlq_path=f"{out}/dlq").awaitTermination()
    done = spark.read.parquet(f"{out}/decisions").select("transaction_id", F.lit("decided").alias("outcome"))
    letters = spark.read.schema("key string, error_code string").json(f"{out}/dlq").select(F.col("key").alias("transaction_id"), F.col("error_code").alias("outcome"))
    return done.unionByName(letters).groupBy("transaction_id").agg(F.array_join(F.array_sort(F.collect_list("outcome")), ",").alias("outcomes"))


@query
def stream_deduplicated(spark, folder):
    """First arrivals of a stream in which every error event comes twice."""
    out = _fresh_folder(spark)
    records = settled(_events(spark, folder))
    twice = records.unionByName(records.filter("event_type = 'error'"))
    files.write_records(twice.drop("event_type"), path=f"{out}/in")
    first = jobs.dedup_stream(files.read_events(spark, path=f"{out}/in")).select("event_id", "user_id")
    run = first.writeStream.format("parquet").option("path", f"{out}/first").option("checkpointLocation", f"{out}/checkpoint")
    run.trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema("event_id string, user_id string").parquet(f"{out}/first")


@query
def stream_poison(spark, folder):
    """Events without an id, and what the stream makes of the others, letters included."""
    out = _fresh_folder(spark)
    records = _events(spark, folder)
    spoiled = records.withColumn("value", F.when(F.col("event_type") == "error", F.regexp_replace("value", '"eventId":"[^"]*",', "")).otherwise(F.col("value")))
    files.write_records(spoiled.drop("event_type"), path=f"{out}/in")
    jobs.score_stream(files.read_events(spark, path=f"{out}/in"), f"{out}/history", f"{out}/decisions", f"{out}/checkpoint", dlq_path=f"{out}/dlq").awaitTermination()
    letters = files.read_dlq(spark, path=f"{out}/dlq", streaming=False)
    done = spark.read.parquet(f"{out}/decisions").select("transaction_id", F.lit("").alias("topic"))
    return done.unionByName(letters.select(F.col("key").alias("transaction_id"), "topic"))


@query
def read_back_records(spark, folder):
    """Created events written as records and read back through the event source."""
    out = _fresh_folder(spark)
    files.write_records(_events(spark, folder).drop("event_type"), path=f"{out}/in")
    back = files.read_events(spark, path=f"{out}/in", streaming=False)
    return back.select("event_id", "user_id", us("occurred_at", "us"), (F.col("amount") * 100).cast("long").alias("cents"), "merchant_id")


@query
def read_back_requests(spark, folder):
    """Requests written as JSON and read back through the request source."""
    out = _fresh_folder(spark)
    T.requests(spark, folder).select(*(f.name for f in schemas.REQUEST.fields)).write.json(f"{out}/in")
    checked = validation.validate_requests(files.read_requests(spark, f"{out}/in", "api"))
    return checked.groupBy("channel", (F.size("errors") == 0).alias("accepted")).agg(F.count(F.lit(1)).alias("n"))


@query
def read_back_samples(spark, folder):
    """Metric samples written in the layout of their source and read back."""
    out = _fresh_folder(spark)
    M.samples(spark, folder, ["fraud_alerts_total"]).select(*(f.name for f in schemas.SAMPLE.fields)).write.parquet(f"{out}/samples")
    back = files.read_samples(spark, f"{out}/samples")
    return back.select(us("ts", "us"), "name", F.col("labels")["instance"].alias("instance"), F.round("value", 6).alias("value"))


@query
def stream_alerts(spark, folder):
    """Two streams in a row: scoring publishes fraud events, which become alerts and notifications."""
    out = _fresh_folder(spark)
    jobs.score_stream(
        _stream(spark, folder), f"{out}/history", f"{out}/decisions", f"{out}/c1", dlq_path=f"{out}/dlq1",
        publish=lambda events, n: files.write_records(files.as_records(events), path=f"{out}/fraud"),
        detected_at=F.col("occurred_at") + F.expr("interval 1 second"),
    ).awaitTermination()
    jobs.alert_stream(files.read_fraud_events(spark, path=f"{out}/fraud"), f"{out}/alerts", f"{out}/c2",
                      notifications_path=f"{out}/sent", dlq_path=f"{out}/dlq2", created_at=F.col("occurredAt")).awaitTermination()
    alerts = stored.read_alerts(spark, f"{out}/alerts")
    sent = spark.read.parquet(f"{out}/sent").groupBy("id").agg(F.count(F.lit(1)).alias("sent"))
    return alerts.join(sent, "id").select("id", "transaction_id", "user_id", "risk_score", "reasons", us("created_at", "created_us"), "sent")


@query
def stream_dead_letters(spark, folder):
    """Dead letters reprocessed by the scorer: what fails again ends in the failed folder."""
    out = _fresh_folder(spark)
    records = _events(spark, folder)
    value = F.when(F.col("event_type") == "error", F.regexp_replace("value", '"eventId":"[^"]*",', "")).when(F.col("event_type") != "signup", F.col("value"))
    letters = records.withColumns({"value": value, "topic": F.concat("topic", F.lit(".dlq"))})
    files.write_records(letters.drop("event_type"), path=f"{out}/letters")
    work = jobs.scoring(f"{out}/history", f"{out}/decisions", "replay", dlq_path=f"{out}/dlq")
    jobs.reprocess_dlq(files.read_dlq(spark, path=f"{out}/letters"), work, f"{out}/failed", f"{out}/checkpoint").awaitTermination()
    done = spark.read.parquet(f"{out}/decisions").select(F.lit("reprocessed").alias("outcome"))
    failed = spark.read.parquet(f"{out}/failed").select(F.col("error_code").alias("outcome"))
    return C.outcome_counts(done.unionByName(failed))


@query
def stream_replayed(spark, folder):
    """All events as dead letters, scored by the replay: the decisions of the scorer."""
    out = _fresh_folder(spark)
    files.write_records(_events(spark, folder).drop("event_type").withColumn("topic", F.concat("topic", F.lit(".dlq"))), path=f"{out}/letters")
    work = jobs.scoring(f"{out}/history", f"{out}/decisions", "replay", dlq_path=f"{out}/dlq")
    jobs.reprocess_dlq(files.read_dlq(spark, path=f"{out}/letters"), work, f"{out}/failed", f"{out}/checkpoint").awaitTermination()
    return _decisions(spark, f"{out}/decisions")


@query
def stream_replayed_twice(spark, folder):
    """Dead letters in two folders, each replayed by a job of its own: together the decisions of the scorer, if the first half is the older."""
    out = _fresh_folder(spark)
    records = _events(spark, folder).withColumn("topic", F.concat("topic", F.lit(".dlq")))
    # by user, so that each history is whole in one of the two
    odd = F.pmod(F.xxhash64(F.get_json_object("value", "$.userId")), F.lit(2)) == 1
    for name, mine in (("odd", odd), ("even", ~odd)):
        files.write_records(records.filter(mine).drop("event_type"), path=f"{out}/{name}")
        work = jobs.scoring(f"{out}/history", f"{out}/decisions", "replay", dlq_path=f"{out}/dlq")
        jobs.reprocess_dlq(files.read_dlq(spark, path=f"{out}/{name}"), work, f"{out}/failed", f"{out}/c-{name}").awaitTermination()
    return _decisions(spark, f"{out}/decisions")


@query
def stream_repeated_after_compaction(spark, folder):
    """The scorer goes on with a compacted copy of its history, and the batch before comes once more: nothing changes."""
    out = _fresh_folder(spark)
    files.write_records(_events(spark, folder).drop("event_type"), path=f"{out}/in")

    def run(history: str) -> None:
        jobs.score_stream(files.read_events(spark, path=f"{out}/in"), history, f"{out}/decisions", f"{out}/checkpoint", dlq_path=f"{out}/dlq",
                          markers_path=f"{out}/markers").awaitTermination()

    run(f"{out}/history")
    stored.compact_table(spark, f"{out}/history", schemas.HISTORY, _time(30).date(), f"{out}/compacted")
    fs, commits = stored._hadoop(spark, f"{out}/checkpoint/commits")
    fs.delete(commits, True)
    run(f"{out}/compacted")
    kept = stored.read_table(spark, f"{out}/compacted", schemas.HISTORY).groupBy("event_id").agg(F.count(F.lit(1)).alias("stored"))
    letters = spark.read.schema("key string").json(f"{out}/dlq").count()
    return _decisions(spark, f"{out}/decisions").join(kept, "event_id", "left").withColumn("letters", F.lit(letters)).drop("reasons")


@query
def stored_ids(spark, folder):
    """Which ids of all transactions the index holds after every purchase has been stored, in batches, and compacted in between."""
    out = _fresh_folder(spark)
    index, rows = IdIndex(spark, f"{out}/ids"), settled(T.transactions(spark, folder).select(F.col("transaction_id").alias("id"), "event_type", "seq"))
    bought = rows.filter("event_type = 'purchase'")
    for n in range(3):
        index.put(bought.filter(F.col("seq") % 3 == n), Batch("w", n))
        if n == 1:
            index.compact()
    return index.stored(rows).select("id")


@query
def read_back_logs(spark, folder):
    """Log lines written as JSON and read back through the log source."""
    out = _fresh_folder(spark)
    T.log_lines(spark, folder).select("ts", "service", "line").write.json(f"{out}/logs", timestampFormat=schemas.JSON_OPTIONS["timestampFormat"])
    done = logs.parse_logs(files.read_logs(spark, f"{out}/logs"))
    return done.select(us("ts", "us"), "service", *_blank(done, "level", "traceId", "event", "outcome", "risk_score"))


@query
def read_back_spans(spark, folder):
    """Spans written in the layout of their source and read back."""
    out = _fresh_folder(spark)
    T.spans(spark, folder).select(*(f.name for f in schemas.SPAN.fields)).write.parquet(f"{out}/spans")
    back = files.read_spans(spark, f"{out}/spans")
    return back.select("trace_id", "span_id", F.coalesce("parent_span_id", F.lit("")).alias("parent"), "service", "name", "kind", "status", us("start", "us"), F.round("duration_ms", 6).alias("ms"))
