"""Two streams matched as their rows arrive: a funnel that notices what got stuck, and calls with their answers.

A row waits for its other half, whichever comes first, until the watermark has passed the time in which the half may bear; then it is
written without one. What waits is bounded by that time, not by the stream. A row without a time counts as of its batch; `delay` says how
long rows are waited for. Results are stored per writer and batch, so a repeated batch replaces its own.

The funnel's stages are Spark's stream-stream outer joins with a time range: a row behind the watermark is dropped by the join, which counts it
in the query's progress (`numRowsDroppedByWatermark`). The graph keeps its halves in files and joins them batch by batch.
"""

from __future__ import annotations

from contextlib import nullcontext
from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from ..functions.text import event_time
from ..operators import traces
from ..operators.delivery import stage_funnel
from ..operators.history import micros
from ..session import shuffles_dropped
from ..sources import tables
from ..sources.tables import Batch
from .jobs import TTL, _start

DECISION, ALERT = "decision", "alert"
#: How much earlier than its question an answer may say it is, since clocks differ.
SKEW = timedelta(minutes=1)
#: Halves that are sent to be matched at once; more are matched share after share.
SHARE = 1 << 25
#: Of halves and pairs, which are little but keys: a third less room than by the default.
CODEC = "zstd"
STEPS = T.StructType([
    T.StructField("stage", T.StringType()), T.StructField("transaction_id", T.StringType()), T.StructField("asked_at", T.TimestampType()),
    T.StructField("answered_at", T.TimestampType()), T.StructField("fraudulent", T.BooleanType()),
])
PAIRS = T.StructType([
    *(T.StructField(c, T.StringType()) for c in ("trace_id", "parent_span_id", "client", "client_status", "server", "server_status")),
    *(T.StructField(c, T.DoubleType()) for c in ("client_seconds", "server_seconds")), T.StructField("at", T.TimestampType()),
])
#: Half of a pair: a call (`called`) or an answer.
HALF = T.StructType([
    T.StructField("called", T.BooleanType()), *(T.StructField(c, T.StringType()) for c in ("trace_id", "parent_span_id", "service", "status")),
    T.StructField("seconds", T.DoubleType()), T.StructField("at", T.TimestampType()),
])


def _seconds(span: timedelta) -> Column:
    return F.expr(f"interval {micros(span)} microseconds")


def _marked(df: DataFrame, at: str, delay: timedelta) -> DataFrame:
    timed = df.withColumn(at, event_time(at, F.current_timestamp()))
    return timed.withWatermark(at, f"{int(delay.total_seconds())} seconds")


def stage_stream(
    asked: DataFrame, answered: DataFrame, path: str, checkpoint: str, stage: str, *, within: timedelta = timedelta(minutes=10),
    skew: timedelta = SKEW, delay: timedelta = TTL, trigger: dict | None = None,
) -> StreamingQuery:
    """
    One stage of the funnel: what was `asked` (transaction_id, at) and what was `answered` (transaction_id, at; `fraudulent` if it says so).

    A row of `STEPS` per question and answer goes to `path`, which the stages share. A question without an answer between `skew` before it
    and `within` after it has a row without `answered_at`, once the watermark has passed that time; it is stuck. One without
    an id can't be answered and gets stuck, too.
    """
    said = F.col("fraudulent") if "fraudulent" in answered.columns else F.lit(None).cast("boolean")
    left = _marked(asked.select("transaction_id", F.col("at").alias("asked_at")), "asked_at", delay)
    right = _marked(answered.select(F.col("transaction_id").alias("_id"), F.col("at").alias("answered_at"), said.alias("fraudulent")), "answered_at", delay)
    in_time = (F.col("answered_at") >= F.col("asked_at") - _seconds(skew)) & (F.col("answered_at") <= F.col("asked_at") + _seconds(within))
    steps = left.join(right, (F.col("transaction_id") == F.col("_id")) & in_time, "left").withColumn("stage", F.lit(stage))
    writer = tables.writer_of(asked.sparkSession, checkpoint)

    def each(batch: DataFrame, batch_id: int) -> None:
        tables.put_batch(batch.select(*(f.name for f in STEPS.fields)), path, Batch(writer, batch_id), F.col("asked_at"))

    return _start(steps, each, checkpoint, trigger)


def funnel(spark: SparkSession, path: str) -> DataFrame:
    """`delivery.stage_funnel` of what is settled so far. Transactions asked or answered twice count once."""
    steps = tables.read_table(spark, path, STEPS)
    decisions = steps.filter(F.col("stage") == DECISION)
    done = F.col("answered_at").isNotNull()
    return stage_funnel(decisions.select("transaction_id").distinct(), decisions.filter(done), steps.filter((F.col("stage") == ALERT) & done))


def stuck(spark: SparkSession, path: str) -> DataFrame:
    """What no answer came for in time: stage, transaction_id and when it was asked first."""
    by = tables.read_table(spark, path, STEPS).groupBy("stage", "transaction_id")
    return by.agg(F.min("asked_at").alias("asked_at"), F.max("answered_at").alias("_last")).filter("_last is null").drop("_last")


def _halves(spans: DataFrame, now: datetime) -> DataFrame:
    """Calls and answers as rows of one table; a span without a time counts as of `now`."""
    half = lambda rows, side: rows.select(
        F.lit(side == "client").alias("called"), "trace_id", "parent_span_id", F.col(side).alias("service"), F.col(f"{side}_status").alias("status"),
        F.col(f"{side}_seconds").alias("seconds"), event_time("start", F.lit(now)).alias("at"))
    return half(traces.callers(spans, "start"), "client").unionByName(half(traces.answers(spans, "start"), "server"))


def _newest(spark: SparkSession, checkpoint: str, number: int) -> tuple[int | None, int | None]:
    """The newest call and answer (microseconds) of the batches up to one, as recorded in the checkpoint."""
    fs, place = tables._hadoop(spark, f"{checkpoint}/newest/{number}")
    if not fs.exists(place):
        return None, None
    call, answer = (None if x == "none" else int(x) for x in fs.listStatus(place)[0].getPath().getName().split("_"))
    return call, answer


def _record_newest(spark: SparkSession, checkpoint: str, number: int, newest: tuple[int | None, int | None]) -> None:
    fs, place = tables._hadoop(spark, f"{checkpoint}/newest/{number}")
    fs.delete(place, True)
    fs.mkdirs(place.suffix("/" + "_".join("none" if x is None else str(x) for x in newest)))
    # a stream never goes back by more than a few batches
    fs.delete(tables._hadoop(spark, f"{checkpoint}/newest/{number - 100}")[1], True)


def _watermark(newest: tuple[int | None, int | None], delay: timedelta) -> int | None:
    """What calls and answers have both passed, in microseconds (whole milliseconds, as Spark's); none until there are both."""
    return None if None in newest else min(newest) // 1000 * 1000 - micros(delay)


def graph_stream(
    spans: DataFrame, path: str, checkpoint: str, *, wait: timedelta = timedelta(seconds=10), delay: timedelta = TTL, trigger: dict | None = None,
) -> StreamingQuery:
    """
    Calls and answers of a stream of spans: a row of `PAIRS` for each pair, and for each half whose other half didn't start within `wait`
    of it, before or after. A call that several spans answer has a row for each.

    Halves are kept as files beside the checkpoint until the watermark has passed them, and each batch joins its own with those in reach, so
    what waits takes disk and no executor's memory. They are joined in shares of some `SHARE` halves by a hash of their key, and what a share has
    sent goes before the next, so that what lies on the executors' disks meanwhile doesn't grow with the batch. Halves behind the watermark go to `<path>-late` (rows of `HALF`).
    """
    spark = spans.sparkSession
    writer, place = tables.writer_of(spark, checkpoint), f"{checkpoint}/halves"
    at, reach = F.unix_micros("at"), micros(wait)

    def each(batch: DataFrame, batch_id: int) -> None:
        with shuffles_dropped(spark):
            work(batch, batch_id)

    def work(batch: DataFrame, batch_id: int) -> None:
        mine, before = Batch(writer, batch_id), _newest(spark, checkpoint, batch_id - 1)
        passed = _watermark(before, delay)
        halves = _halves(batch, tables.batch_time(spark, checkpoint, batch_id))
        if passed is not None:
            tables.put_batch(halves.filter(at <= passed), f"{path}-late", mine, F.col("at"))
            halves = halves.filter(at > passed)
        tables.put_batch(halves, place, mine, F.col("at"), CODEC)
        # a half in reach may have been matched by one that is `wait` older; days of any time zone
        first = None if passed is None else (datetime(1970, 1, 1) + timedelta(microseconds=passed - 2 * reach) - timedelta(days=1)).date()
        own = (F.col("writer") == writer) & (F.col("batch_id") == batch_id)
        kept = tables.read_table(spark, place, HALF, first=first).withColumn("_new", own).drop(*tables.PLACE)
        *top, count = kept.agg(*(F.max(F.when(F.col("_new") & (F.col("called") == c), at)) for c in (True, False)), F.count(F.lit(1))).first()
        newest = tuple(max((x for x in pair if x is not None), default=None) for pair in zip(before, top, strict=True))
        _record_newest(spark, checkpoint, batch_id, newest)
        near = kept if passed is None else kept.filter(at >= passed - 2 * reach)
        matched = [_matched(share, reach, passed, _watermark(newest, delay)) for share in _shares(near, -(-count // SHARE))]
        # other streams may write the same table meanwhile, and a reader finds all of a batch or nothing
        with tables.staged(*matched) if len(matched) > 1 else nullcontext(matched[0]) as whole:
            tables.put_batch(whole, path, mine, F.col("at"), CODEC)
        if first is not None:
            for folder in tables._days(spark, place, None, first - timedelta(days=1)):
                fs, old = tables._hadoop(spark, folder)
                fs.delete(old, True)

    return _start(spans, each, checkpoint, trigger)


def _shares(halves: DataFrame, n: int) -> list[DataFrame]:
    """The halves in `n` shares, those of one key in the same; at least one share."""
    share = F.pmod(F.xxhash64("trace_id", "parent_span_id"), F.lit(n))
    return [halves.filter(share == k) for k in range(n)] if n > 1 else [halves]


def _matched(halves: DataFrame, reach: int, passed: int | None, edge: int | None) -> DataFrame:
    """Pairs that a new half (`_new`) completes, and the halves alone whose time is up since the watermark went from `passed` to `edge`."""
    key = ["trace_id", "parent_span_id"]
    side = lambda called, name, at: halves.filter(F.col("called") == called).select(
        *(F.col(c).alias(c if called else f"_{c}") for c in key), F.col("service").alias(name), F.col("status").alias(f"{name}_status"),
        F.col("seconds").alias(f"{name}_seconds"), F.col("at").alias(at), F.col("_new").alias(f"_new{at}"))
    near = F.abs(F.unix_micros("_answered") - F.unix_micros("_called")) <= reach
    same = [F.col(c) == F.col(f"_{c}") for c in key]
    joined = side(True, "client", "_called").join(side(False, "server", "_answered"), same[0] & same[1] & near, "full_outer")
    until = F.unix_micros(F.coalesce("_called", "_answered")) + reach
    over = F.lit(False) if edge is None else (until < edge) & (F.lit(True) if passed is None else until >= passed)
    both = F.col("_called").isNotNull() & F.col("_answered").isNotNull()
    told = joined.filter(F.when(both, F.col("_new_called") | F.col("_new_answered")).otherwise(over))
    whole = {**{c: F.coalesce(c, f"_{c}") for c in key}, "at": F.coalesce("_called", "_answered")}
    return told.withColumns(whole).select(*PAIRS.names)


def graph(spark: SparkSession, path: str) -> DataFrame:
    """`traces.service_graph` of the pairs that are complete."""
    return traces.graph_of(tables.read_table(spark, path, PAIRS).filter("client is not null and server is not null"))


def expired(spark: SparkSession, path: str) -> DataFrame:
    """How many calls (`side` client) and answers (`side` server) of a service waited in vain."""
    halves = tables.read_table(spark, path, PAIRS).filter("client is null or server is null")
    side = F.when(F.col("server").isNull(), "client").otherwise("server").alias("side")
    return halves.groupBy(side, F.coalesce("client", "server").alias("service")).agg(F.count(F.lit(1)).alias("expired"))
