"""Structured log lines: parse, filter, count."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import schemas

TRACE_ID_PATTERN = r'"traceId"\s*:\s*"(\w+)"'


def in_services(logs: DataFrame, pattern: str = ".*") -> DataFrame:
    return logs.filter(F.col("service").rlike(f"^(?:{pattern})$"))


def parse_logs(logs: DataFrame) -> DataFrame:
    """Fields of the JSON line as columns; lines that are not JSON keep null fields."""
    parsed = logs.withColumn("_f", F.from_json("line", schemas.LOG_FIELDS))
    taken = [f.name for f in schemas.LOG_FIELDS.fields]
    return parsed.select("ts", "service", "line", *(F.col("_f")[name].alias(name) for name in taken))


def labelled(logs: DataFrame, services: str = "transaction-service|fraud-detection-service|alert-service") -> DataFrame:
    """Level, logger, trace and span of the services' lines, with the level as a label next to `service`."""
    taken = F.col("service").rlike(f"^(?:{services})$")
    parsed = F.from_json("line", "level string, logger_name string, traceId string, spanId string")
    return logs.withColumn("_f", F.when(taken, parsed)).select(
        "ts", "service", F.col("_f.level").alias("level"), F.col("_f.logger_name").alias("logger"),
        F.col("_f.traceId").alias("trace_id"), F.col("_f.spanId").alias("span_id"), "line",
    )


def filter_events(parsed: DataFrame, pattern: str) -> DataFrame:
    """Lines whose event matches the whole pattern."""
    return parsed.filter(F.col("event").rlike(f"^(?:{pattern})$"))


def filter_fields(parsed: DataFrame, **conds) -> DataFrame:
    """`field=value` for equality, `field__ge=`, `__gt=`, `__le=`, `__lt=`, `__ne=` for comparisons."""
    ops = {
        "ge": lambda c, v: c >= v, "gt": lambda c, v: c > v, "le": lambda c, v: c <= v,
        "lt": lambda c, v: c < v, "ne": lambda c, v: c != v, "eq": lambda c, v: c == v,
    }
    for name, value in conds.items():
        field, _, op = name.partition("__")
        parsed = parsed.filter(ops[op or "eq"](F.col(field), F.lit(value)))
    return parsed


def extract_trace_id(line: Column | str = "line") -> Column:
    found = F.regexp_extract(line, TRACE_ID_PATTERN, 1)
    return F.nullif(found, F.lit(""))


def event_outcomes(parsed: DataFrame) -> DataFrame:
    return parsed.groupBy("service", "event", "outcome").agg(F.count(F.lit(1)).alias("n"))


def service_names(logs: DataFrame, pattern: str = ".*") -> DataFrame:
    return in_services(logs, pattern).select("service").distinct()
