"""Readers and writers over files and Kafka. Layouts are declared, never inferred."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import schemas
from ..functions.mapping import to_columns, to_payload
from .tables import Batch

CHANNELS = ("api", "webhook")
MAX_PARTITIONS = 65_536
TRANSACTIONS_TOPIC, FRAUD_TOPIC = "transactions.created", "fraud.detected"


def _reader(spark: SparkSession, streaming: bool):
    return spark.readStream if streaming else spark.read


def read_requests(spark: SparkSession, path: str, channel: str, streaming: bool = False, **options) -> DataFrame:
    """JSON requests of one channel; a line that is not JSON keeps its text in `_corrupt_record`."""
    layout = T.StructType([*schemas.REQUEST.fields, T.StructField("_corrupt_record", T.StringType())])
    return _reader(spark, streaming).options(**options).schema(layout).json(path).withColumn("channel", F.lit(channel))


# The record of a message stream, whatever carries it.
RECORD = T.StructType(
    [
        T.StructField("key", T.StringType()),
        T.StructField("value", T.StringType()),
        T.StructField("topic", T.StringType()),
        T.StructField("partition", T.IntegerType()),
        T.StructField("offset", T.LongType()),
        T.StructField("timestamp", T.TimestampType()),
    ]
)


def read_records(spark: SparkSession, *, topic: str | None = None, servers: str | None = None, path: str | None = None,
                 streaming: bool = True, **options) -> DataFrame:
    """Raw records from a Kafka topic (from the earliest offset) or from a folder of JSON records."""
    if path is not None:
        return _reader(spark, streaming).options(**options).schema(RECORD).json(path)
    source = _reader(spark, streaming).format("kafka").option("kafka.bootstrap.servers", servers)
    loaded = source.option("subscribe", topic).option("startingOffsets", "earliest").options(**options).load()
    return loaded.select(
        F.col("key").cast("string"), F.col("value").cast("string"), "topic", "partition", "offset", "timestamp"
    )


def decode(records: DataFrame, schema: T.StructType) -> DataFrame:
    """Event columns next to the record's own; unknown fields are ignored and bad JSON gives null fields."""
    event = records.withColumn("_e", F.from_json("value", schema))
    fields = event.select("*", *(F.col("_e")[f.name].alias(f.name) for f in schema.fields)).drop("_e")
    # unique over all partitions of a topic, and in the order of arrival within each
    place = F.col("offset") * MAX_PARTITIONS + F.coalesce("partition", F.lit(0))
    return to_columns(fields.withColumn("seq", place))


def read_events(spark: SparkSession, schema: T.StructType = schemas.CREATED_EVENT, **source) -> DataFrame:
    return decode(read_records(spark, **source), schema)


def read_fraud_events(spark: SparkSession, **source) -> DataFrame:
    return read_events(spark, schemas.FRAUD_EVENT, **source)


def read_dlq(spark: SparkSession, topic: str = TRANSACTIONS_TOPIC, **source) -> DataFrame:
    """Dead letters of a topic, still raw; a folder may hold those of many batches."""
    if "path" in source:
        return read_records(spark, recursiveFileLookup="true", **source)
    return read_records(spark, topic=f"{topic}.dlq", **source)


def as_records(df: DataFrame, key: Column | str = "transactionId") -> DataFrame:
    """Key and JSON value of each event, ready for a sink; the value carries no type information."""
    return df.select(
        (F.col(key) if isinstance(key, str) else key).cast("string").alias("key"),
        to_payload(df=df).alias("value"),
    )


def write_records(records: DataFrame, *, topic: str | None = None, servers: str | None = None,
                  path: str | None = None, mode: str = "append") -> None:
    """Batch write of records, also for use inside `foreachBatch`."""
    if path is not None:
        records.write.mode(mode).json(path)
    else:
        records.write.format("kafka").option("kafka.bootstrap.servers", servers).option("topic", topic).save()


def put_letters(letters: DataFrame, path: str, batch: Batch) -> None:
    """Dead letters of one batch as JSON records, in the layout that `read_dlq` reads; a repeated batch replaces them."""
    letters.write.mode("overwrite").json(f"{path}/writer={batch.writer}/batch_id={batch.number}")


def write_events(df: DataFrame, checkpoint: str, *, key: str = "transactionId", topic: str | None = None,
                 servers: str | None = None, path: str | None = None, trigger: dict | None = None):
    """Start a streaming write of events as keyed records."""
    records = as_records(df, key)
    writer = records.writeStream.option("checkpointLocation", checkpoint).outputMode("append")
    writer = writer.trigger(**(trigger or {"availableNow": True}))
    if path is not None:
        return writer.format("json").option("path", path).start()
    return writer.format("kafka").option("kafka.bootstrap.servers", servers).option("topic", topic).start()


def read_samples(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    return spark.read.schema(schemas.SAMPLE).format(fmt).load(path)


def stream_samples(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    """Samples as their files arrive."""
    return spark.readStream.schema(schemas.SAMPLE).format(fmt).load(path)


def read_logs(spark: SparkSession, path: str, fmt: str = "json") -> DataFrame:
    """Log lines with their service; the level stays in the line until it is parsed."""
    return spark.read.schema(schemas.LOG_LINE).format(fmt).load(path)


def read_spans(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    return spark.read.schema(schemas.SPAN).format(fmt).load(path)


def stream_spans(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    """Spans as their files arrive."""
    return spark.readStream.schema(schemas.SPAN).format(fmt).load(path)
