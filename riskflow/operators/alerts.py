"""Alert tables: lookups, triage queries, notification fan-out."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schemas
from ..functions.labels import TRIAGE_CRITICAL_SCORE, severity

# ------------------------------------------------------------------ lookups and lists


def alerts_for_user(alerts: DataFrame, user_id: str) -> DataFrame:
    return alerts.filter(F.col("user_id") == user_id)


def alert_for_transaction(alerts: DataFrame, transaction_id: str) -> DataFrame:
    return alerts.filter(F.col("transaction_id") == transaction_id)


def alerts_for_users(alerts: DataFrame, users: DataFrame) -> DataFrame:
    """Alerts of any user named in a table."""
    return alerts.join(users.select("user_id"), "user_id", "left_semi")


def list_alerts(alerts: DataFrame) -> DataFrame:
    """Newest first. A range-partitioned sort; equal times are ordered by id."""
    return alerts.orderBy(F.col("created_at").desc(), "id")


def list_alerts_by_user(alerts: DataFrame, user_id: str) -> DataFrame:
    return list_alerts(alerts_for_user(alerts, user_id))


# ------------------------------------------------------------------ triage


def in_range(df: DataFrame, col: str, t0=None, t1=None) -> DataFrame:
    """Both ends included; a missing end is open."""
    if t0 is not None:
        df = df.filter(F.col(col) >= F.lit(t0))
    if t1 is not None:
        df = df.filter(F.col(col) <= F.lit(t1))
    return df


def alert_count(alerts: DataFrame, t0=None, t1=None) -> DataFrame:
    return in_range(alerts, "created_at", t0, t1).agg(F.count(F.lit(1)).alias("value"))


def average_risk(alerts: DataFrame, t0=None, t1=None) -> DataFrame:
    """Mean score to 2 decimals, 0 when there is no alert."""
    mean = F.round(F.avg(F.col("risk_score").cast("decimal(10,0)")), 2)
    return in_range(alerts, "created_at", t0, t1).agg(F.coalesce(mean, F.lit(0)).alias("value"))


def critical_share(alerts: DataFrame, t0=None, t1=None, threshold: int = TRIAGE_CRITICAL_SCORE) -> DataFrame:
    share = F.sum(F.when(F.col("risk_score") >= threshold, 1).otherwise(0)) / F.nullif(F.count(F.lit(1)), F.lit(0))
    return in_range(alerts, "created_at", t0, t1).agg(F.coalesce(share, F.lit(0.0)).alias("value"))


def alert_timeline(alerts: DataFrame, t0=None, t1=None, bucket: str = "1 minute") -> DataFrame:
    """Alerts per time bucket, oldest first; buckets without alerts are absent."""
    kept = in_range(alerts, "created_at", t0, t1)
    counted = kept.groupBy(F.window("created_at", bucket).alias("_w")).agg(F.count(F.lit(1)).alias("alerts"))
    return counted.select(F.col("_w.start").alias("time"), "alerts").orderBy("time")


def top_reasons(alerts: DataFrame, t0=None, t1=None, k: int = 8) -> DataFrame:
    """The `k` most frequent reasons; ties by name."""
    kept = in_range(alerts, "created_at", t0, t1)
    reasons = kept.select(F.explode(F.split("reasons", ",", -1)).alias("reason"))
    counted = reasons.groupBy("reason").agg(F.count(F.lit(1)).alias("value"))
    return counted.orderBy(F.col("value").desc(), "reason").limit(k)


def latest_alerts(alerts: DataFrame, n: int = 200) -> DataFrame:
    return (
        alerts.select(
            "created_at", F.col("id").alias("alert_id"), "transaction_id", "user_id", "risk_score", "reasons",
            F.coalesce("trace_id", F.lit("")).alias("trace_id"),
        )
        .orderBy(F.col("created_at").desc(), "alert_id")
        .limit(n)
    )


def alerts_by_severity(alerts: DataFrame) -> DataFrame:
    return alerts.groupBy(severity("risk_score").alias("severity")).agg(F.count(F.lit(1)).alias("alerts"))


def risk_summary(alerts: DataFrame) -> DataFrame:
    score = F.col("risk_score")
    return alerts.agg(
        F.count(score).alias("count"), F.sum(score).alias("sum"), F.max(score).alias("max"), F.avg(score).alias("mean")
    )


# ------------------------------------------------------------------ notification


@dataclass(frozen=True)
class Channels:
    """Which channels are on. Mail without recipients falls back to a second `log` delivery."""

    log_enabled: bool = True
    email_enabled: bool = False
    email_to: Sequence[str] = ()

    def names(self) -> list[str]:
        active = ["log"] if self.log_enabled else []
        if self.email_enabled:
            active.append("email" if self.email_to else "log")
        return active


def channel_table(spark: SparkSession, channels: Channels) -> DataFrame:
    rows = list(enumerate(channels.names()))
    return spark.createDataFrame(rows, "position int, channel string")


def fan_out(alerts: DataFrame, channels: Channels) -> DataFrame:
    """One row per alert and enabled channel, in configured order."""
    names = channels.names()
    if not names:
        return alerts.limit(0).withColumns({"position": F.lit(0), "channel": F.lit("")})
    return alerts.select("*", F.posexplode(F.array(*map(F.lit, names))).alias("position", "channel"))


def deliver(fanned: DataFrame, senders: dict[str, Callable[[dict], None]]) -> DataFrame:
    """Call the sender of each row's channel and report the outcome.

    A sender that raises makes its own row `failed` and touches no other row. Rows are processed batch by
    batch where they lie. A lost task is repeated, so senders should be idempotent per alert id.
    """
    from time import perf_counter

    def attempt(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            outcomes = []
            for row in batch.to_dict("records"):
                started = perf_counter()
                try:
                    senders[row["channel"]](row)
                    outcome = "success"
                except Exception:  # any failure of user code is an outcome, not a job failure
                    outcome = "failed"
                outcomes.append((row["id"], row["channel"], outcome, int((perf_counter() - started) * 1000)))
            yield pd.DataFrame(outcomes, columns=["alert_id", "channel", "outcome", "duration_ms"])

    return fanned.mapInPandas(attempt, schemas.NOTIFICATION)


def log_record(alerts: DataFrame) -> Column:
    """The structured line the `log` channel writes for an alert."""
    from ..functions.text import user_hash

    return F.to_json(
        F.struct(
            F.lit("fraud_alert_logged").alias("event"), F.lit("success").alias("outcome"), F.lit("log").alias("channel"),
            F.col("id").alias("alertId"), F.col("transaction_id").alias("transactionId"),
            user_hash("user_id").alias("user_hash"), "risk_score", "reasons", F.col("created_at").alias("createdAt"),
        )
    )
