"""Streams that keep the rows their watermark has passed, and correct what they have said.

The watermark is Spark's own: the one it records for a batch before the batch begins, so a batch that is repeated goes by the same.
Rows behind it aren't dropped by a stateful operator; they go to a side table, and what they change is written beside
what was already closed. On time and late together are all rows that came.
"""

from __future__ import annotations

import json
from datetime import datetime, timedelta, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from ..operators.delivery import drop_processed
from ..operators.history import micros
from ..sources import tables
from ..sources.tables import Batch
from .jobs import TTL, _held, _start

#: Rows of one batch in a time bucket. `late` ones came after the bucket was closed.
SUMS = T.StructType([T.StructField("time", T.TimestampType()), T.StructField("late", T.BooleanType()), T.StructField("alerts", T.LongType())])
CLOSED = T.StructType([T.StructField("time", T.TimestampType()), T.StructField("alerts", T.LongType())])
COUNTS = T.StructType([T.StructField(c, T.LongType()) for c in ("received", "first", "late")])


def watermark_at(spark: SparkSession, checkpoint: str, number: int) -> datetime | None:
    """The watermark of a batch, from the query's own record of it in its checkpoint; none as long as no row has set one."""
    if number < 0:
        return None
    record = [r.value for r in spark.read.text(f"{checkpoint}/offsets/{number}").collect()]  # a line or two
    millis = next(json.loads(line)["batchWatermarkMs"] for line in record if "batchWatermarkMs" in line)
    return datetime.fromtimestamp(0, timezone.utc) + timedelta(milliseconds=millis) if millis else None


def dedup_stream(
    events: DataFrame, path: str, late_path: str, checkpoint: str, *, id_col: str = "event_id", ts: str = "occurred_at", seq: str = "seq",
    delay: timedelta = TTL, trigger: dict | None = None,
) -> StreamingQuery:
    """
    First arrivals per id go to `path`, rows behind the watermark to `late_path`, and how many rows a batch had to `<path>-counts`.

    An id is known again until the watermark has passed the time of its first arrival by `delay`, and only the days of that
    time are read. Rows without a time are never late, and their ids are known for good; rows without an id all count as first.
    """
    spark, schema = events.sparkSession, events.schema
    writer = tables.writer_of(spark, checkpoint)

    def each(batch: DataFrame, batch_id: int) -> None:
        mine, edge = Batch(writer, batch_id), watermark_at(spark, checkpoint, batch_id)
        behind = F.lit(False) if edge is None else F.coalesce(F.col(ts) < F.lit(edge), F.lit(False))
        _held(batch.withColumn("_late", behind), lambda rows: work(rows, mine, edge))

    def work(rows: DataFrame, mine: Batch, edge: datetime | None) -> None:
        late, in_time = rows.filter("_late").drop("_late"), rows.filter("not _late").drop("_late")
        tables.put_batch(late, late_path, mine, F.col(ts))
        stored = tables.read_table(spark, path, schema, before=mine, first=None if edge is None else (edge - delay).date())
        if edge is not None:
            stored = stored.filter(F.coalesce(F.col(ts) >= F.lit(edge - delay), F.lit(True)))
        _held(drop_processed(in_time, tables.stored_ids(in_time, stored, id_col), id_col, seq).select(*schema.names), lambda first: store(first, rows, mine))

    def store(first: DataFrame, rows: DataFrame, mine: Batch) -> None:
        tables.put_batch(first, path, mine, F.col(ts))
        one = F.lit(1).cast("long")
        counted = rows.select(one.alias("received"), F.lit(0).cast("long").alias("first"), F.col("_late").cast("long").alias("late"))
        counted = counted.unionByName(first.select(F.lit(0).cast("long").alias("received"), one.alias("first"), F.lit(0).cast("long").alias("late")))
        tables.put_batch(counted.agg(*(F.coalesce(F.sum(c), F.lit(0).cast("long")).alias(c) for c in COUNTS.names)), f"{path}-counts", mine, None)

    return _start(events.withWatermark(ts, f"{int(delay.total_seconds())} seconds"), each, checkpoint, trigger)


def window_stream(
    alerts: DataFrame, path: str, checkpoint: str, *, ts: str = "created_at", width: timedelta = timedelta(minutes=1), delay: timedelta = TTL,
    trigger: dict | None = None,
) -> StreamingQuery:
    """
    Counts per time bucket: `closed` has each bucket once, when the watermark has passed its end; `corrections` what came for it later.

    A batch adds one row per bucket to `<path>/sums`, and reads only the days of the buckets that it closes. Rows without a time are
    counted in a bucket without one, which stays open.
    """
    spark = alerts.sparkSession
    writer = tables.writer_of(spark, checkpoint)
    start = F.timestamp_micros(F.floor(F.unix_micros(ts) / F.lit(micros(width))).cast("long") * micros(width))

    def each(batch: DataFrame, batch_id: int) -> None:
        mine, edge, before = Batch(writer, batch_id), watermark_at(spark, checkpoint, batch_id), watermark_at(spark, checkpoint, batch_id - 1)
        passed = F.lit(False) if edge is None else F.coalesce(F.unix_micros("time") + micros(width) <= F.unix_micros(F.lit(edge)), F.lit(False))
        counted = batch.select(start.alias("time")).groupBy("time").agg(F.count(F.lit(1)).alias("alerts"))
        tables.put_batch(counted.withColumn("late", passed).select(*SUMS.names), f"{path}/sums", mine, F.col("time"))
        first = None if before is None else (before - width).date()
        sums = tables.read_table(spark, f"{path}/sums", SUMS, before=mine, first=first).filter(passed & ~F.col("late"))
        if before is not None:
            sums = sums.filter(F.unix_micros("time") + micros(width) > F.unix_micros(F.lit(before)))
        tables.put_batch(sums.groupBy("time").agg(F.sum("alerts").alias("alerts")), f"{path}/closed", mine, F.col("time"))

    return _start(alerts.withWatermark(ts, f"{int(delay.total_seconds())} seconds"), each, checkpoint, trigger)


def closed(spark: SparkSession, path: str) -> DataFrame:
    return tables.read_table(spark, f"{path}/closed", CLOSED).select("time", "alerts")


def corrections(spark: SparkSession, path: str) -> DataFrame:
    """How many rows came for a bucket after it was closed."""
    late = tables.read_table(spark, f"{path}/sums", SUMS).filter("late")
    return late.groupBy("time").agg(F.sum("alerts").alias("alerts"))


def windows(spark: SparkSession, path: str) -> DataFrame:
    """All buckets as they are now, open ones and corrections included: time, alerts, late."""
    sums = tables.read_table(spark, f"{path}/sums", SUMS)
    return sums.groupBy("time").agg(F.sum("alerts").alias("alerts"), F.sum(F.when(F.col("late"), F.col("alerts")).otherwise(0)).alias("late"))
