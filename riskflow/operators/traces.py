"""Spans: per-operation metrics, the graph of services, and the log lines that belong to a trace."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import timedelta

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .history import micros
from .ordered import Running, prefix

# Latency bounds in seconds, and which span kinds call and which answer.
LATENCY_BOUNDS = (0.002, 0.004, 0.008, 0.016, 0.032, 0.064, 0.128, 0.256, 0.512, 1.02, 2.05, 4.1)
CALLING, ANSWERING = ("CLIENT", "PRODUCER"), ("SERVER", "CONSUMER")


def _histogram(df: DataFrame, by: Sequence[str], seconds, bounds: Sequence[float]) -> DataFrame:
    """Calls, latency sum and cumulative bucket counts in one aggregation; one row per bound."""
    counts = [F.count(F.when(seconds <= b, 1)).alias(f"_b{i}") for i, b in enumerate(bounds)]
    grouped = df.groupBy(*by).agg(F.count(F.lit(1)).alias("calls"), F.sum(seconds).alias("latency_sum"), *counts)
    buckets = [F.struct(F.lit(f"{b:g}").alias("le"), F.col(f"_b{i}").alias("n")) for i, b in enumerate(bounds)]
    buckets.append(F.struct(F.lit("+Inf").alias("le"), F.col("calls").alias("n")))
    return grouped.select(*by, "calls", "latency_sum", F.explode(F.array(*buckets)).alias("_b")).select(
        *by, "calls", "latency_sum", F.col("_b.le").alias("le"), F.col("_b.n").cast("double").alias("value")
    )


def span_metrics(spans: DataFrame, bounds: Sequence[float] = LATENCY_BOUNDS,
                 by: Sequence[str] = ("service", "name", "kind", "status")) -> DataFrame:
    """Per operation and latency bound: calls, latency sum in seconds and the cumulative count (`value`)."""
    return _histogram(spans, list(by), F.col("duration_ms") / 1000, bounds)


def callers(spans: DataFrame, *more: str) -> DataFrame:
    """Calling spans, by the parent that their answers name."""
    return spans.filter(F.col("kind").isin(*CALLING)).select(
        "trace_id", F.col("span_id").alias("parent_span_id"), F.col("service").alias("client"),
        (F.col("duration_ms") / 1000).alias("client_seconds"), F.col("status").alias("client_status"), *more,
    )


def answers(spans: DataFrame, *more: str) -> DataFrame:
    return spans.filter(F.col("kind").isin(*ANSWERING) & F.col("parent_span_id").isNotNull()).select(
        "trace_id", "parent_span_id", F.col("service").alias("server"),
        (F.col("duration_ms") / 1000).alias("server_seconds"), F.col("status").alias("server_status"), *more,
    )


def edges(spans: DataFrame) -> DataFrame:
    """Calling span joined with the span that answered it. A calling span matches by its own id, which is
    unique, so a large trace spreads over many keys."""
    return callers(spans).join(answers(spans), ["trace_id", "parent_span_id"])


def graph_of(pairs: DataFrame) -> DataFrame:
    """Requests, failures and latency between services, of calls with their answers."""
    bad = (F.col("server_status") == "STATUS_CODE_ERROR") | (F.col("client_status") == "STATUS_CODE_ERROR")
    return pairs.groupBy("client", "server").agg(
        F.count(F.lit(1)).alias("requests"),
        F.count(F.when(bad, 1)).alias("failed"),
        F.sum("client_seconds").alias("client_seconds"),
        F.sum("server_seconds").alias("server_seconds"),
    )


def service_graph(spans: DataFrame) -> DataFrame:
    """Requests, failures and latency between services."""
    return graph_of(edges(spans))


def service_graph_latency(spans: DataFrame, bounds: Sequence[float] = LATENCY_BOUNDS) -> DataFrame:
    return _histogram(edges(spans), ["client", "server"], F.col("server_seconds"), bounds)


def logs_for_trace(spans: DataFrame, logs: DataFrame, shift: timedelta = timedelta(minutes=5),
                   limit: int | None = None) -> DataFrame:
    """Log lines of a span's service and trace, from `shift` before its start to `shift` after its end.

    `logs` needs ts, service, trace_id and a unique `line_id`; each line is returned once, with the number
    of spans it belongs to (`spans`). A sweep over span starts, lines and span ends replaces the join of
    every line with every span of its trace. Rows of one instant and kind change nothing for each other, so hashes of their ids, which
    only let a crowded instant be cut, are enough to order them.
    """
    pad = micros(shift)
    start = F.unix_micros("start")
    end = start + F.round(F.col("duration_ms") * 1000).cast("long")
    opened = F.struct((start - pad).alias("at"), F.lit(0).alias("order"), F.lit(1).alias("step"))
    closed = F.struct((end + pad).alias("at"), F.lit(2).alias("order"), F.lit(-1).alias("step"))
    bounds = (
        spans.filter(F.col("trace_id").isNotNull())
        .select("service", "trace_id", F.xxhash64("span_id").alias("_id"), F.explode(F.array(opened, closed)).alias("_e"))
        .select("service", "trace_id", "_id", "_e.at", "_e.order", F.col("_e.step").cast("long").alias("step"))
    )
    rest = [c for c in logs.columns if c not in ("service", "trace_id")]
    lines = logs.filter(F.col("trace_id").isNotNull()).select(
        "service", "trace_id", F.xxhash64("line_id").alias("_id"),
        F.unix_micros("ts").alias("at"), F.lit(1).alias("order"), F.lit(0).cast("long").alias("step"),
        F.struct(*rest).alias("_line"),
    )
    swept = prefix(
        bounds.unionByName(lines, allowMissingColumns=True), ["service", "trace_id"], ["at", "order", "_id"],
        [Running("spans", "sum", F.col("step"))], limit=limit,
    )
    found = swept.filter((F.col("order") == 1) & (F.col("spans") > 0))
    return found.select(*(F.col("_line")[c].alias(c) if c in rest else F.col(c) for c in logs.columns), "spans")
