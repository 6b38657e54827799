"""Business tables derived from the general `events`, `orders` and `lineitem` tables.

Real transactions are sparse in these tables, so time is compressed: users with an even number by
1440 (several transactions a minute) and the others by 60 (gaps around half an hour).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.mapping import to_alerts, to_fraud_events
from ..operators.outbox import enqueue
from ..operators.rules import RULE_VERSION, score

BASE_US = 1_704_067_200_000_000


def read(spark: SparkSession, folder: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{table}.parquet")


def _events(spark: SparkSession, folder: str, streaming: bool) -> DataFrame:
    events = read(spark, folder, "events")
    if not streaming:
        return events
    # a bounded number of files per micro-batch
    return spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 256).parquet(f"{folder}/events.parquet*")


def transactions(spark: SparkSession, folder: str, streaming: bool = False) -> DataFrame:
    events = _events(spark, folder, streaming)
    k = F.get_json_object("props", "$.k").cast("int")
    user = F.col("user_id")
    shrink = F.when(user % 2 == 0, 1440).otherwise(60)
    us = F.expr("unix_micros(cast(ts as timestamp))")
    cents = F.round(F.col("value") * 100).cast("long") * 60
    moved = F.when(F.col("event_id") % 7 == 0, 1).otherwise(0)
    return (
        events.withColumns({"_us": us, "_shrink": shrink, "_k": k})
        .select(
            F.col("event_id").alias("seq"),
            F.concat(F.lit("evt-"), "event_id").alias("event_id"),
            F.concat(F.lit("tx-"), "event_id").alias("transaction_id"),
            F.concat(F.lit("user-"), "user_id").alias("user_id"),
            F.timestamp_micros(F.expr(f"{BASE_US} + (_us - {BASE_US}) div _shrink")).alias("occurred_at"),
            (cents.cast("decimal(18,0)") * F.lit("0.01").cast("decimal(3,2)")).cast("decimal(19,2)").alias("amount"),
            F.lit("USD").alias("currency"),
            F.when(F.col("_k") % 10 == 0, "MRC-999")
            .when(F.col("_k") % 10 == 1, "mrc-666")
            .otherwise(F.concat(F.lit("MRC-"), 100 + F.col("_k")))
            .alias("merchant_id"),
            F.element_at(
                F.array(*map(F.lit, ["US", "BR", "MX", "AR", "CL", "PE"])), ((user + moved) % 6 + 1).cast("int")
            ).alias("country"),
            F.element_at(
                F.array(*map(F.lit, ["CARD", "TRANSFER", "WALLET", "CASH"])), (F.col("event_id") % 4 + 1).cast("int")
            ).alias("payment_method"),
            "event_type",
        )
    )


def trace_id(event_id: str = "event_id"):
    return F.substring(F.sha2(F.concat(F.lit("trace:"), F.col(event_id)), 256), 1, 32)


def scored(spark: SparkSession, folder: str) -> DataFrame:
    return score(transactions(spark, folder))


def alerts(spark: SparkSession, folder: str) -> DataFrame:
    """Alerts for the fraudulent transactions, raised one second after each."""
    found = scored(spark, folder).withColumn("trace_id", F.when(F.col("event_type") != "error", trace_id()))
    fraud = to_fraud_events(found, RULE_VERSION, F.col("occurred_at") + F.expr("interval 1 second"))
    return to_alerts(fraud, F.col("occurredAt"))


def requests(spark: SparkSession, folder: str, streaming: bool = False) -> DataFrame:
    """Requests, a good part of which break one rule or another."""
    events = _events(spark, folder, streaming)
    kind = F.col("event_type")
    k = F.col("_k")
    moved = F.when(F.col("event_id") % 7 == 0, 1).otherwise(0)
    country = F.element_at(
        F.array(*map(F.lit, ["US", "BR", "MX", "AR", "CL", "PE"])), ((F.col("user_id") + moved) % 6 + 1).cast("int")
    )
    cents = F.round(F.col("value") * 100).cast("long") - 500
    return events.withColumn("_k", F.get_json_object("props", "$.k").cast("int") % 10).select(
        F.col("event_id").alias("request_id"),
        F.when((kind == "signup") & (k == 2), "  ").otherwise(F.concat(F.lit("user-"), "user_id")).alias("userId"),
        F.when((kind == "view") & (k == 3), F.lit(None))
        .otherwise(cents.cast("decimal(18,0)") * F.lit("0.01").cast("decimal(3,2)"))
        .cast("decimal(28,9)").alias("amount"),
        F.when(kind == "error", "usd").when(k == 3, "").otherwise("USD").alias("currency"),
        F.when(k == 4, F.lit(None)).otherwise(F.concat(F.lit("MRC-"), k)).alias("merchantId"),
        F.when(k == 5, "USA").otherwise(country).alias("country"),
        F.when(k == 6, "CHEQUE").when(k == 7, F.lit(None)).otherwise("CARD").alias("paymentMethod"),
        F.when(kind == "click", "WebHook").when(kind == "view", " ").otherwise("api").alias("channel"),
        F.expr("cast(ts as timestamp)").alias("created_at"),
    )


def deliveries(spark: SparkSession, folder: str) -> DataFrame:
    """Created events with every `error` row delivered a second time, later."""
    tx = transactions(spark, folder)
    again = tx.filter(F.col("event_type") == "error").withColumn("seq", F.col("seq") + 1_000_000_000_000)
    return tx.unionByName(again)


def created_events(spark: SparkSession, folder: str) -> DataFrame:
    """The transactions under event field names."""
    return transactions(spark, folder).select(
        F.col("event_id").alias("eventId"), F.col("occurred_at").alias("occurredAt"),
        F.col("transaction_id").alias("transactionId"), F.when(F.col("event_type") != "error", trace_id()).alias("traceId"),
        F.col("user_id").alias("userId"), F.col("amount").cast("decimal(28,9)").alias("amount"), "currency",
        F.col("merchant_id").alias("merchantId"), "country", F.col("payment_method").alias("paymentMethod"),
        "event_type", "seq",
    )


def outbox_table(spark: SparkSession, folder: str) -> DataFrame:
    """The outbox in mid-flight: purchases are published, errors failed once, the rest wait."""
    events = created_events(spark, folder).withColumnRenamed("event_type", "_kind")
    rows = enqueue(events, "transactions.created", extra=["_kind"])
    second = F.expr("interval 1 second")
    return rows.withColumns(
        {
            "status": F.when(F.col("_kind") == "purchase", "PUBLISHED").otherwise(F.col("status")),
            "published_at": F.when(F.col("_kind") == "purchase", F.col("created_at") + second),
            "attempts": F.when(F.col("_kind") == "error", 1).otherwise(F.col("attempts")),
            "next_attempt_at": F.when(F.col("_kind") == "error", F.col("created_at") + second * 2).otherwise(
                F.col("next_attempt_at")
            ),
            "last_error": F.when(F.col("_kind") == "error", "timeout"),
        }
    ).drop("_kind")


def log_lines(spark: SparkSession, folder: str) -> DataFrame:
    """One structured line per event; `error` events of odd users write text that is not JSON."""
    tx = transactions(spark, folder)
    kind = F.col("event_type")
    service = (
        F.when(kind.isin("purchase", "click"), "fraud-detection-service").when(kind.isin("view", "signup"), "alert-service")
        .otherwise("transaction-service")
    )
    cents = (F.col("amount") * 100).cast("long")
    fields = F.struct(
        F.when(kind == "error", "ERROR").otherwise("INFO").alias("level"),
        F.lit("app.Logger").alias("logger_name"),
        trace_id().alias("traceId"),
        F.substring(F.sha2("event_id", 256), 1, 16).alias("spanId"),
        F.when(kind == "purchase", "fraud_decision_made").when(kind == "click", "fraud_event_published")
        .when(kind == "view", "notification_result").when(kind == "signup", "fraud_alert_logged")
        .otherwise("transaction_outbox_publish_failed").alias("event"),
        F.when(kind == "purchase", "fraud").when(kind == "view", F.when(cents % 2 == 0, "failed").otherwise("success"))
        .when(kind == "error", "failed").otherwise("success").alias("outcome"),
        F.when(kind == "purchase", "fraud").alias("decision"),
        F.when(kind == "view", "email").when(kind == "signup", "log").alias("channel"),
        (cents % 101).cast("int").alias("risk_score"),
        F.col("transaction_id").alias("transactionId"),
    )
    plain = (kind == "error") & (F.substring("user_id", -1, 1).cast("int") % 2 == 1)
    return tx.select(
        F.col("occurred_at").alias("ts"), service.alias("service"),
        F.when(plain, F.concat(F.lit("java.net.ConnectException: refused "), "event_id")).otherwise(F.to_json(fields)).alias("line"),
        F.col("seq").alias("line_id"),
    )


def spans(spark: SparkSession, folder: str) -> DataFrame:
    """A trace per order: a root span, and per line item a calling span with its answering span."""
    orders = read(spark, folder, "orders")
    lines = read(spark, folder, "lineitem")
    root = orders.select(
        F.concat(F.lit("t"), "o_orderkey").alias("trace_id"), F.concat(F.lit("o"), "o_orderkey").alias("span_id"),
        F.lit(None).cast("string").alias("parent_span_id"), F.lit("transaction-service").alias("service"),
        F.concat(F.lit("POST "), "o_orderpriority").alias("name"), F.lit("SERVER").alias("kind"),
        F.when(F.col("o_orderstatus") == "F", "STATUS_CODE_ERROR").otherwise("STATUS_CODE_UNSET").alias("status"),
        F.expr("cast(o_orderdate as timestamp)").alias("start"), (F.round("o_totalprice") / 100).alias("duration_ms"),
    )
    item = F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
    caller = F.when(F.col("l_linestatus") == "F", "transaction-service").otherwise("fraud-detection-service")
    server = F.when(F.col("l_linestatus") == "F", "fraud-detection-service").otherwise("alert-service")
    bad = F.when(F.col("l_returnflag") == "R", "STATUS_CODE_ERROR").otherwise("STATUS_CODE_UNSET")
    side = F.explode(
        F.array(
            F.struct(F.lit("c").alias("tag"), caller.alias("service"), F.lit("PRODUCER").alias("kind"), F.lit(1).alias("extra")),
            F.struct(F.lit("s").alias("tag"), server.alias("service"), F.lit("CONSUMER").alias("kind"), F.lit(0).alias("extra")),
        )
    )
    calls = lines.select(
        F.concat(F.lit("t"), "l_orderkey").alias("trace_id"), item.alias("_item"), "l_orderkey", "l_linenumber", bad.alias("status"),
        F.expr("cast(l_shipdate as timestamp)").alias("start"), "l_quantity", side.alias("_s"),
    ).select(
        "trace_id", F.concat("_s.tag", "_item").alias("span_id"),
        F.when(F.col("_s.tag") == "c", F.concat(F.lit("o"), "l_orderkey")).otherwise(F.concat(F.lit("c"), "_item")).alias("parent_span_id"),
        "_s.service", F.concat(F.lit("line "), "l_linenumber").alias("name"), "_s.kind", "status", "start",
        (F.col("l_quantity") + F.col("_s.extra")).alias("duration_ms"),
    )
    return root.unionByName(calls)


def load_results(spark: SparkSession, folder: str) -> DataFrame:
    """Order lines as the results of a load run: quantity and price give latency, the flag the status."""
    return read(spark, folder, "lineitem").select(
        F.when(F.col("l_returnflag") == "R", 500).when(F.col("l_returnflag") == "A", 400).otherwise(201).alias("statusCode"),
        F.round(F.col("l_extendedprice") / 10).cast("long").alias("latencyMs"),
        (F.col("l_linestatus") == "F").alias("fraudulent"),
        F.concat(F.lit("user-"), "l_suppkey").alias("userId"),
    )
