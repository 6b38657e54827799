"""The outbox table for users who own one: enqueue, pick what is due, apply outcomes, purge."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import schemas
from ..functions.mapping import derived_id, to_payload
from ..functions.text import error_text, event_time, generated_hex, normalize_hex, traceparent, trim_to_null

PENDING, PUBLISHED = "PENDING", "PUBLISHED"
BATCH_SIZE = 200
RETRY_DELAY = timedelta(seconds=2)
RETENTION = timedelta(hours=24)


def enqueue(
    events: DataFrame, topic: str, now: Column | None = None, context_trace: Column | None = None,
    context_span: Column | None = None, baggage: Column | None = None, sampled: Column | None = None,
    extra: Sequence[str] = (),
) -> DataFrame:
    """New outbox rows for created events (event field names), due at once.

    The trace header takes the context's ids first, then the event's trace id. A missing span id is
    derived from the event id. Columns in `extra` are carried along.
    """
    none = F.lit(None).cast("string")
    trace = F.coalesce(normalize_hex(none if context_trace is None else context_trace, 32), normalize_hex("traceId", 32))
    span = F.coalesce(normalize_hex(none if context_span is None else context_span, 16), generated_hex("eventId", 16))
    created = event_time("occurredAt", now)
    names = [f.name for f in schemas.CREATED_EVENT.fields]
    return events.select(
        derived_id("outbox", "eventId").alias("id"),
        F.col("eventId").alias("event_id"),
        F.lit(topic).alias("topic"),
        F.col("transactionId").alias("event_key"),
        to_payload(names).alias("payload"),
        traceparent(trace, span, sampled).alias("trace_parent"),
        trim_to_null(none if baggage is None else baggage).alias("baggage"),
        F.lit(PENDING).alias("status"),
        F.lit(0).alias("attempts"),
        created.alias("next_attempt_at"),
        created.alias("created_at"),
        F.lit(None).cast("timestamp").alias("published_at"),
        none.alias("last_error"),
        *extra,
    )


def due_batch(outbox: DataFrame, now, n: int = BATCH_SIZE) -> DataFrame:
    """The oldest `n` pending rows whose next attempt is due."""
    due = (F.col("status") == PENDING) & (F.col("next_attempt_at") <= F.lit(now))
    return outbox.filter(due).orderBy("created_at", "id").limit(n)


def publish_headers(outbox: DataFrame) -> DataFrame:
    """Add the headers sent with each row: the stored trace header, else one from the payload's trace id."""
    from ..functions.text import is_blank, trim_to_empty

    trace = F.get_json_object("payload", "$.traceId")
    built = traceparent(trace, generated_hex("event_id", 16))
    return outbox.withColumns(
        {
            "traceparent": F.when(is_blank("trace_parent"), built).otherwise(F.col("trace_parent")),
            "baggage_header": trim_to_empty("baggage"),
        }
    )


def apply_outcomes(outbox: DataFrame, outcomes: DataFrame, now, delay: timedelta = RETRY_DELAY) -> DataFrame:
    """The next snapshot of the table after publishing.

    `outcomes` has `id`, `ok`, `error`, `error_class`, at most one row per id. Success marks the row
    published and clears the error; failure counts an attempt and delays the next one.
    """
    told = outcomes.select("id", "ok", error_text("error", "error_class").alias("_error"))
    joined = outbox.join(told, "id", "left")
    done, failed = F.col("ok") == F.lit(True), F.col("ok") == F.lit(False)
    at = F.lit(now)
    return joined.withColumns(
        {
            "status": F.when(done, PUBLISHED).when(failed, PENDING).otherwise(F.col("status")),
            "attempts": F.when(failed, F.col("attempts") + 1).otherwise(F.col("attempts")),
            "next_attempt_at": F.when(failed, at + F.lit(delay)).otherwise(F.col("next_attempt_at")),
            "published_at": F.when(done, at).otherwise(F.col("published_at")),
            "last_error": F.when(failed, F.col("_error")).when(~done | done.isNull(), F.col("last_error")),
        }
    ).select(*outbox.columns)


def purge_published(outbox: DataFrame, now, ttl: timedelta = RETENTION) -> DataFrame:
    """Drop rows published longer ago than `ttl`."""
    old = (F.col("status") == PUBLISHED) & (F.col("published_at") < F.lit(now) - F.lit(ttl))
    return outbox.filter(~F.coalesce(old, F.lit(False)))


def outbox_backlog(outbox: DataFrame, now) -> DataFrame:
    """Rows, attempts, oldest row and its age per status."""
    return outbox.groupBy("status").agg(
        F.count(F.lit(1)).alias("n"),
        F.sum("attempts").alias("attempts"),
        F.min("created_at").alias("oldest"),
        F.max((F.unix_micros(F.lit(now)) - F.unix_micros("created_at")) / 1e6).alias("oldest_age_seconds"),
    )
