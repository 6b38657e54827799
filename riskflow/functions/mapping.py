"""From request to transaction to event to alert: one `select` each, ids derived instead of random."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import schemas
from .text import (
    escape_html, generated_hex, is_blank, join_reasons, normalize_code, resolve_trace_id, split_reasons,
)
from .labels import severity, severity_color


def derived_id(prefix: str, source: Column | str) -> Column:
    """A stable id: the same source row always maps to the same id, so a rerun changes nothing."""
    c = F.col(source) if isinstance(source, str) else source
    return F.sha2(F.concat(F.lit(prefix + ":"), c.cast("string")), 256)


def to_transactions(requests: DataFrame, request_id: str = "request_id", created_at: str = "created_at") -> DataFrame:
    """Accepted requests as rows of the transactions table."""
    return requests.select(
        derived_id("transaction", request_id).alias("id"),
        F.col("userId").alias("user_id"),
        F.col("amount").cast(schemas.MONEY).alias("amount"),
        normalize_code("currency").alias("currency"),
        F.col("merchantId").alias("merchant_id"),
        normalize_code("country").alias("country"),
        F.col("paymentMethod").alias("payment_method"),
        F.col(created_at).alias("created_at"),
    )


def to_created_events(
    requests: DataFrame, request_id: str = "request_id", created_at: str = "created_at",
    trace: Column | str | None = None,
) -> DataFrame:
    """The event for each accepted request; it shares time and id with the row and keeps the amount as sent."""
    known = [trace] if trace is not None else []
    return requests.select(
        derived_id("event", request_id).alias("eventId"),
        F.col(created_at).alias("occurredAt"),
        derived_id("transaction", request_id).alias("transactionId"),
        resolve_trace_id(*known, generate_from=request_id).alias("traceId"),
        "userId",
        F.col("amount").cast(schemas.EVENT_MONEY).alias("amount"),
        normalize_code("currency").alias("currency"),
        "merchantId",
        normalize_code("country").alias("country"),
        "paymentMethod",
    )


def to_columns(events: DataFrame) -> DataFrame:
    """Event field names to column names; other columns (seq, source position) are kept."""
    return events.select(*(F.col(c).alias(schemas.EVENT_COLUMNS.get(c, c)) for c in events.columns))


def to_payload(fields: list[str] | None = None, df: DataFrame | None = None) -> Column:
    """The named fields as JSON text."""
    names = fields or [f.name for f in df.schema.fields]
    return F.to_json(F.struct(*names), schemas.JSON_OPTIONS)


def from_payload(value: Column | str, schema) -> Column:
    return F.from_json(value, schema)


def to_history(scored: DataFrame) -> DataFrame:
    names = [f.name for f in schemas.HISTORY.fields]
    return scored.withColumn("amount", F.col("amount").cast(schemas.MONEY)).select(*names)


def to_fraud_events(scored: DataFrame, rule_version: str, detected_at: Column | None = None) -> DataFrame:
    """One event per fraudulent decision."""
    trace = F.col("trace_id") if "trace_id" in scored.columns else F.lit(None).cast("string")
    return scored.filter("fraudulent").select(
        derived_id("fraud", "event_id").alias("eventId"),
        (F.current_timestamp() if detected_at is None else detected_at).alias("occurredAt"),
        F.col("transaction_id").alias("transactionId"),
        resolve_trace_id(trace).alias("traceId"),
        F.col("user_id").alias("userId"),
        F.col("risk_score").alias("riskScore"),
        "reasons",
        F.lit(rule_version).alias("ruleVersion"),
    )


def to_alerts(fraud: DataFrame, created_at: Column | None = None) -> DataFrame:
    """Alert rows from fraud events (event field names). Events of older producers carry no id."""
    return fraud.select(
        derived_id("alert", F.coalesce("eventId", "transactionId")).alias("id"),
        F.col("transactionId").alias("transaction_id"),
        F.col("userId").alias("user_id"),
        F.col("riskScore").cast("int").alias("risk_score"),
        join_reasons("reasons").alias("reasons"),
        (F.current_timestamp() if created_at is None else created_at).alias("created_at"),
        F.coalesce("eventId", F.lit("unknown")).alias("source_event_id"),
        resolve_trace_id("traceId").alias("trace_id"),
    )


def alert_view(alerts: DataFrame) -> DataFrame:
    """Alerts as clients see them: reasons as a list."""
    return alerts.withColumn("reasons", split_reasons("reasons"))


def notification_content(alerts: DataFrame) -> DataFrame:
    """The parts of a notification mail, ready to fill any template."""
    parts = F.when(is_blank("reasons"), F.array(F.lit("UNSPECIFIED"))).otherwise(
        F.transform(F.split("reasons", ","), lambda r: F.trim(r))
    )
    return alerts.select(
        F.col("id").alias("alert_id"),
        F.format_string(
            "[FRAUD ALERT] Risk score %d - User %s - Transaction %s", "risk_score", "user_id", "transaction_id"
        ).alias("subject"),
        F.upper(severity("risk_score")).alias("severity"),
        severity_color("risk_score").alias("color"),
        escape_html("transaction_id").alias("transaction_html"),
        escape_html("user_id").alias("user_html"),
        escape_html("id").alias("alert_html"),
        F.concat(F.col("risk_score").cast("string"), F.lit(" / 100")).alias("score_text"),
        F.date_format(F.convert_timezone(None, F.lit("UTC"), F.col("created_at").cast("timestamp_ntz")), "yyyy-MM-dd HH:mm:ss 'UTC'").alias("detected_at"),
        F.transform(parts, escape_html).alias("reasons_html"),
    )
