"""Exactly one effect per event: first arrivals, processed ids, dead letters, stage coverage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import schemas
from .ordered import first_arrival


def drop_processed(df: DataFrame, processed: DataFrame | None = None, id_col: str = "event_id", seq: str = "seq") -> DataFrame:
    """The first row per id, unless the id was processed before. Rows without an id can't be told apart and all stay."""
    named, unnamed = df.filter(F.col(id_col).isNotNull()), df.filter(F.col(id_col).isNull())
    first = first_arrival(named, [id_col], seq)
    if processed is not None:
        first = first.join(processed.select(id_col), id_col, "left_anti").select(*first.columns)
    return first.unionByName(unnamed)


def processed_markers(df: DataFrame, at: Column | str = "occurred_at", id_col: str = "event_id") -> DataFrame:
    return df.select(id_col, (F.col(at) if isinstance(at, str) else at).alias("processed_at"))


def letters(rows: DataFrame, topic: str) -> DataFrame:
    """Rows with `error_code` as records of a dead-letter stream: key, value, topic, partition, offset, error_code.

    A record that came from a stream keeps its own key, payload, partition and offset. A row that never was a record gets the
    payload that its event would have had.
    """
    back = {v: k for k, v in schemas.EVENT_COLUMNS.items()}
    known = {f.name for f in (*schemas.CREATED_EVENT.fields, *schemas.FRAUD_EVENT.fields)}
    events = F.struct(*(F.col(c).alias(back.get(c, c)) for c in rows.columns if back.get(c, c) in known))
    have = lambda name, kind: F.col(name).cast(kind) if name in rows.columns else F.lit(None).cast(kind)
    return rows.select(
        (F.col("key") if "key" in rows.columns else F.col("transaction_id")).cast("string").alias("key"),
        (F.col("value").cast("string") if "value" in rows.columns else F.to_json(events, schemas.JSON_OPTIONS)).alias("value"),
        F.lit(f"{topic}.dlq").alias("topic"), have("partition", "int").alias("partition"), have("offset", "long").alias("offset"),
        F.col("error_code"),
    )


def route_dlq(df: DataFrame, reason: Column, topic: str) -> tuple[DataFrame, DataFrame]:
    """(rows to process, dead letters)."""
    marked = df.withColumn("error_code", reason)
    dead = letters(marked.filter(F.col("error_code").isNotNull()), topic)
    return marked.filter(F.col("error_code").isNull()).drop("error_code"), dead


def stage_funnel(transactions: DataFrame, decisions: DataFrame, alerts: DataFrame) -> DataFrame:
    """How many transactions reached a decision, a fraud decision and an alert, and the ratios."""
    decided = decisions.groupBy("transaction_id").agg(F.max(F.col("fraudulent").cast("int")).alias("_fraud"))
    alerted = alerts.groupBy("transaction_id").agg(F.lit(1).alias("_alerted"))
    chained = transactions.select("transaction_id").join(decided, "transaction_id", "left").join(
        alerted, "transaction_id", "left"
    )
    counted = chained.agg(
        F.count(F.lit(1)).alias("transactions"),
        F.count("_fraud").alias("decided"),
        F.count(F.when(F.col("_fraud") == 1, 1)).alias("fraud"),
        F.count(F.when((F.col("_fraud") == 1) & F.col("_alerted").isNotNull(), 1)).alias("alerted"),
    )
    return counted.withColumns(
        {
            "coverage": F.col("decided") / F.greatest("transactions", F.lit(1)),
            "conversion": F.col("alerted") / F.greatest("fraud", F.lit(1)),
            "fraud_ratio": F.col("alerted") / F.greatest("transactions", F.lit(1)),
        }
    )
