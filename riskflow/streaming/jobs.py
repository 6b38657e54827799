"""Streaming jobs: score, raise alerts, route and reprocess dead letters.

Each micro-batch is scored by the same windows as a whole table, against the stored history of earlier batches and of other
writers, so a user who sends most of a batch is split over tasks like in batch work. Every output is a folder per writer and batch
that a repeated batch replaces; a checkpointed query that restarts changes nothing, and several queries may share a table.

An event has one effect. Its marker is stored under its id alone, so it is known again whatever time it bears, for as long as
markers are kept. A second event with a stored transaction id goes to the dead letters before anything is decided on it.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import ExitStack, contextmanager
from dataclasses import dataclass
from datetime import datetime, timedelta, timezone

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from .. import schemas
from ..functions.mapping import to_alerts, to_created_events, to_fraud_events, to_history, to_transactions
from ..functions.text import event_time
from ..functions.validation import (
    FRAUD_REQUIRED, TRANSACTION_REQUIRED, drop_tombstones, poison_reason, split_valid, validate_requests,
)
from ..operators.alerts import Channels, deliver, fan_out
from ..operators.delivery import drop_processed, letters, route_dlq
from ..operators.ordered import numbered as numbered_rows
from ..operators.rules import RULE_VERSION, RuleConfig, score_batch
from ..sources import tables
from ..sources.files import FRAUD_TOPIC, TRANSACTIONS_TOPIC, put_letters
from ..sources.tables import Batch

ONCE = {"availableNow": True}
TTL = timedelta(hours=1)
#: How long the marker of a processed event is kept.
REMEMBER = timedelta(days=7)
DUPLICATE_TRANSACTION = "DUPLICATE_TRANSACTION"
#: The place of a row in its staged batch, why it can't be stored, and whether it has a payload: asked once, so that the payload is opened no more.
ROW, WHY, PAYLOAD = "_row", "_why", "_payload"


def _start(stream: DataFrame, each: Callable[[DataFrame, int], None], checkpoint: str, trigger: dict | None) -> StreamingQuery:
    writer = stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint)
    return writer.trigger(**(trigger or ONCE)).start()


def _held(df: DataFrame, each: Callable[[DataFrame], None]) -> None:
    """Keep a batch in memory and on disk while several outputs read it; lost blocks are recomputed."""
    held = df.persist()
    try:
        each(held)
    finally:
        held.unpersist()


def _with_payload(batch: DataFrame, counts_path: str, mine: Batch, value: str = "value") -> DataFrame:
    """Records with a payload. Those without are passed over on a main stream, and counted."""
    if value not in batch.columns:
        return batch
    kept, empty = drop_tombstones(batch, value)
    tables.put_batch(empty.agg(F.count(F.lit(1)).alias("tombstones")), counts_path, mine, None)
    return kept


def _record_time(batch: DataFrame, now: datetime) -> Column:
    """When a record arrived, from the record where it says so, and the time of its batch elsewhere."""
    return F.coalesce("timestamp", F.lit(now)) if "timestamp" in batch.columns else F.lit(now)


def dedup_stream(df: DataFrame, id_col: str = "event_id", ts: str = "occurred_at", ttl: str = "1 hour") -> DataFrame:
    """First arrival per id; an id is remembered until the watermark has passed it by `ttl`."""
    return df.withWatermark(ts, ttl).dropDuplicatesWithinWatermark([id_col])


def ingest_stream(
    requests: DataFrame, transactions_path: str, checkpoint: str, publish: Callable[[DataFrame, int], None],
    rejected_path: str, trigger: dict | None = None,
) -> StreamingQuery:
    """Requests to rows of the transactions table and to created events, from one validated batch.

    A request without `request_id` is named by its stream, batch and place among equal requests of the batch, which a repeated
    batch gives again however its files are split; one without `created_at` gets the time of its batch. The row and the event of a
    request share both. `publish` gets the events of each batch, and gets them again when the batch is repeated.
    """
    writer = tables.writer_of(requests.sparkSession, checkpoint)

    def each(batch: DataFrame, batch_id: int) -> None:
        mine = Batch(writer, batch_id)
        if "request_id" not in batch.columns:
            content = F.sha2(F.to_json(F.struct(*batch.columns)), 256)
            # equal requests of a batch can't be told apart, so any order among them gives the same names
            numbered = batch.withColumn("_content", content).withColumn("_seq", F.monotonically_increasing_id())
            numbered = numbered_rows(numbered, ["_content"], ["_seq"], "_copy")
            batch = numbered.withColumn("request_id", F.concat_ws("-", F.lit(writer), F.lit(batch_id), "_content", "_copy")).drop("_content", "_seq", "_copy")
        if "created_at" not in batch.columns:
            batch = batch.withColumn("created_at", _record_time(batch, tables.batch_time(batch.sparkSession, checkpoint, batch_id)))

        def work(held: DataFrame) -> None:
            ok, bad = split_valid(held)
            tables.put_batch(bad.withColumn("errors", F.to_json("errors")), rejected_path, mine, F.col("created_at"))
            tables.append_transactions(to_transactions(ok), transactions_path, mine)
            publish(to_created_events(ok), batch_id)

        _held(validate_requests(batch), work)

    return _start(requests, each, checkpoint, trigger)


@contextmanager
def refused(ids: DataFrame, markers: DataFrame, stored: Callable[[DataFrame], DataFrame]) -> Iterator[DataFrame]:
    """
    Of (_row, event_id, transaction_id, seq) the rows that are not scored, with `again`: of each event id the first arrival counts, unless
    a marker has it, and the others are passed over; of each transaction id the first of these counts, unless the history has it, which
    `stored` says of a table of ids. The others of a transaction are dead letters (`again`).

    Only ids are sorted and sent here; the rows themselves stay where they are.
    """
    named = ids.filter("event_id is not null").groupBy("event_id").agg(F.min(F.struct("seq", ROW, "transaction_id")).alias("_first"))
    named = named.join(markers.select("event_id"), "event_id", "left_anti").select("event_id", "_first.*")
    with ExitStack() as kept:
        with tables.staged(named.unionByName(ids.filter("event_id is null"))) as fresh:
            taken = stored(fresh.select(F.col("transaction_id").alias("id"))).withColumnRenamed("id", "transaction_id")
            first = fresh.groupBy("transaction_id").agg(F.min(F.struct("seq", ROW, "event_id")).alias("_first"))
            first = first.join(taken, "transaction_id", "left_anti").filter("_first.event_id is not null").select(f"_first.{ROW}")
            reached = [rows.select(ROW, F.lit(n).alias("_n")) for n, rows in enumerate((ids, fresh, first))]
            far = reached[0].unionByName(reached[1]).unionByName(reached[2]).groupBy(ROW).agg(F.max("_n").alias("_n"))
            out = kept.enter_context(tables.staged(far.filter("_n < 2").select(ROW, (F.col("_n") == 1).alias("again"))))
        yield out


def score_stream(
    events: DataFrame, history_path: str, decisions_path: str, checkpoint: str, config: RuleConfig = RuleConfig(), *,
    dlq_path: str, markers_path: str | None = None, topic: str = TRANSACTIONS_TOPIC, trigger: dict | None = None,
    keep: tuple[str, ...] = (), publish: Callable[[DataFrame, int], None] | None = None,
    detected_at: Column | None = None, remember: timedelta = REMEMBER,
) -> StreamingQuery:
    """Score a stream of created events (columns as from `decode`, with `seq`).

    Writes decisions, history and markers per batch. Events that can never be stored, and second events of a transaction, go to
    `dlq_path` as the records they were. `publish` gets the fraud events of each batch, and gets them again when the batch is
    repeated: their ids stay the same, so receivers can drop what they have seen. Empty payloads are counted under
    `<dlq_path>-tombstones`; markers lie under `<history_path>-markers` unless another place is given.
    """
    spark = events.sparkSession
    each = scoring(history_path, decisions_path, tables.writer_of(spark, checkpoint), config, dlq_path=dlq_path, markers_path=markers_path,
                   topic=topic, keep=keep, publish=publish, detected_at=detected_at, remember=remember,
                   clock=lambda n: tables.batch_time(spark, checkpoint, n))
    return _start(events, each, checkpoint, trigger)


@dataclass(frozen=True)
class Scoring:
    """The scorer's work on a batch, and the name and clock it goes by."""

    work: Callable[[DataFrame, Batch, datetime], None]
    writer: str
    clock: Callable[[int], datetime]

    def __call__(self, batch: DataFrame, batch_id: int) -> None:
        self.work(batch, Batch(self.writer, batch_id), self.clock(batch_id))

    def under(self, checkpoint_writer: str, clock: Callable[[int], datetime]) -> Scoring:
        """The same work for the stream of a checkpoint."""
        return Scoring(self.work, f"{self.writer}-{checkpoint_writer}", clock)


def scoring(
    history_path: str, decisions_path: str, writer: str, config: RuleConfig = RuleConfig(), *, dlq_path: str,
    markers_path: str | None = None, topic: str = TRANSACTIONS_TOPIC, keep: tuple[str, ...] = (),
    publish: Callable[[DataFrame, int], None] | None = None, detected_at: Column | None = None, remember: timedelta = REMEMBER,
    clock: Callable[[int], datetime] = lambda n: datetime.now(timezone.utc),
) -> Scoring:
    """
    What `score_stream` does with each batch; also the work of `reprocess_dlq` on dead letters.

    Batches are stored under `writer` and their numbers. `reprocess_dlq` adds the name of its own checkpoint to it, so two replays never
    share a place; whoever calls this work alone has to name a writer that no other checkpoint has.
    """
    markers_path = markers_path or f"{history_path}-markers"
    columns = ["event_id", "transaction_id", "user_id", "occurred_at", "seq", "prior_count", "risk_score", "fraudulent", "reasons"]
    # a payload is carried along where `detected_at` may look at it only
    wanted = None if detected_at is not None else {*columns, *(f.name for f in schemas.HISTORY.fields), "trace_id", *keep}

    def each(batch: DataFrame, mine: Batch, now: datetime) -> None:
        spark = batch.sparkSession

        timed = batch.withColumn("occurred_at", event_time("occurred_at", _record_time(batch, now)))
        asked = {ROW: F.monotonically_increasing_id(), WHY: poison_reason(timed, TRANSACTION_REQUIRED)}
        if "value" in batch.columns:
            asked[PAYLOAD] = F.when(F.col("value").isNotNull(), True)
        # a whole batch is never held in memory
        with tables.staged(timed.withColumns(asked)) as held:
            held = _with_payload(held, f"{dlq_path}-tombstones", mine, PAYLOAD)
            ok, dead = route_dlq(held, F.col(WHY), topic)
            # only the users and times that a batch can reach are kept of the history; see against_stored
            history = tables.read_table(spark, history_path, schemas.HISTORY, before=mine)
            markers = tables.read_table(spark, markers_path, schemas.PROCESSED, before=mine, first=(now - remember).date())
            index = tables.history_ids(spark, history_path)
            with refused(ok.select(ROW, "event_id", "transaction_id", "seq"), markers, lambda ids: index.stored(ids, mine)) as out:
                if not out.filter("again").isEmpty():
                    again = ok.join(out.filter("again"), ROW, "left_semi").withColumn("error_code", F.lit(DUPLICATE_TRANSACTION))
                    dead = dead.unionByName(letters(again, topic))
                put_letters(dead, dlq_path, mine)
                fresh = ok.join(out, ROW, "left_anti").select(*(c for c in ok.columns if c not in asked and (wanted is None or c in wanted)))
                with tables.staged(score_batch(fresh, history, config)) as scored:
                    store(scored, mine, now)

    def store(scored: DataFrame, mine: Batch, now: datetime) -> None:
        extra = [c for c in (*keep, "trace_id") if c in scored.columns]
        tables.put_batch(scored.select(*columns, *extra), decisions_path, mine, F.col("occurred_at"))
        if publish:
            publish(to_fraud_events(scored, RULE_VERSION, detected_at), mine.number)
        tables.append_markers(scored, markers_path, mine, F.lit(now))
        tables.put_new_history(to_history(scored), history_path, mine)

    return Scoring(each, writer, clock)


def with_dlq(batch: DataFrame, mine: Batch, reason: Column, topic: str, ok_sink: Callable[[DataFrame], None], dlq_path: str) -> None:
    """Inside `foreachBatch`: good rows to `ok_sink`, the others to the dead-letter folder."""
    def work(held: DataFrame) -> None:
        ok, dead = route_dlq(held, reason, topic)
        put_letters(dead, dlq_path, mine)
        ok_sink(ok)

    _held(batch, work)


def alert_stream(
    fraud: DataFrame, alerts_path: str, checkpoint: str, channels: Channels = Channels(),
    notifications_path: str | None = None, *, dlq_path: str, created_at: Column | None = None,
    remember: timedelta = REMEMBER, trigger: dict | None = None, senders: dict[str, Callable[[dict], None]] | None = None,
) -> StreamingQuery:
    """Alerts from fraud events, one per source event, and one notification row per alert and channel.

    With `senders` (one callable per channel) the notifications are delivered and their outcomes written.
    """
    spark = fraud.sparkSession
    writer, markers_path = tables.writer_of(spark, checkpoint), f"{alerts_path}-markers"
    back = {v: k for k, v in schemas.EVENT_COLUMNS.items()}

    def each(batch: DataFrame, batch_id: int) -> None:
        mine, now = Batch(writer, batch_id), tables.batch_time(spark, checkpoint, batch_id)

        def work(held: DataFrame) -> None:
            ok, dead = route_dlq(held, poison_reason(held, FRAUD_REQUIRED, None), FRAUD_TOPIC)
            put_letters(dead, dlq_path, mine)
            markers = tables.read_table(spark, markers_path, schemas.PROCESSED, before=mine, first=(now - remember).date())
            fresh = drop_processed(ok, tables.stored_ids(ok, markers, "event_id"))
            named = fresh.select(*(F.col(c).alias(back.get(c, c)) for c in fresh.columns))
            _held(to_alerts(named, created_at), lambda alerts: store(alerts, mine, now))

        _held(_with_payload(batch, f"{dlq_path}-tombstones", mine), work)

    def store(alerts: DataFrame, mine: Batch, now: datetime) -> None:
        tables.append_alerts(alerts, alerts_path, mine)
        tables.append_markers(alerts.select(F.col("source_event_id").alias("event_id")), markers_path, mine, F.lit(now))
        fanned = fan_out(alerts, channels)
        if notifications_path and senders:
            tables.put_batch(deliver(fanned, senders), notifications_path, mine, None)
        elif notifications_path:
            tables.put_batch(fanned.select("id", "channel", "position", "created_at"), notifications_path, mine, F.col("created_at"))

    return _start(fraud, each, checkpoint, trigger)


def reprocess_dlq(
    letters_: DataFrame, transform: Callable[[DataFrame, int], None], failed_path: str, checkpoint: str,
    reason: Callable[[DataFrame], Column] = lambda df: poison_reason(df, TRANSACTION_REQUIRED),
    counts_path: str | None = None, trigger: dict | None = None, schema=schemas.CREATED_EVENT,
) -> StreamingQuery:
    """Run dead letters through `transform(rows, batch_id)` again, which may be the scorer's own work (`scoring`).

    What fails again is terminal: it is written to `failed_path` and never queued a second time. An empty payload counts as
    failed, and so does every letter of a batch whose work raises an exception of its own; the stream goes on. Where Spark fails (a lost
    executor, a full disk), the batch fails and is repeated, since the letters are not to blame.
    """
    from py4j.protocol import Py4JError
    from pyspark.errors import PySparkException

    from ..sources.files import decode

    spark = letters_.sparkSession
    writer = tables.writer_of(spark, checkpoint)
    if isinstance(transform, Scoring):
        transform = transform.under(writer, lambda n: tables.batch_time(spark, checkpoint, n))

    def each(batch: DataFrame, batch_id: int) -> None:
        mine = Batch(writer, batch_id)

        def work(held: DataFrame) -> None:
            why = F.when(F.col("value").isNull(), "EMPTY_EVENT_PAYLOAD").otherwise(reason(held))
            marked = held.withColumn("error_code", why)
            try:
                transform(marked.filter(F.col("error_code").isNull()).drop("error_code"), batch_id)
            except (Py4JError, PySparkException):
                raise
            except Exception as error:  # what the work can't do is the letters' failure, not the stream's
                marked = marked.withColumn("error_code", F.coalesce("error_code", F.lit(type(error).__name__)))
            bad = marked.filter(F.col("error_code").isNotNull())
            tables.put_batch(bad.select("topic", "partition", "key", "value", "error_code"), failed_path, mine, None)
            if counts_path:
                counts = marked.agg(
                    F.count(F.lit(1)).alias("received"),
                    F.count(F.when(F.col("error_code").isNull(), 1)).alias("reprocessed"),
                    F.count("error_code").alias("failed"),
                )
                tables.put_batch(counts, counts_path, mine, None)

        # the scorer holds the batch itself; a second copy would take the memory its sorts need
        rows = decode(batch, schema)
        if isinstance(transform, Scoring):
            work(rows)
        else:
            _held(rows, work)

    return _start(letters_, each, checkpoint, trigger)


def split_late(df: DataFrame, ts: str, cutoff) -> tuple[DataFrame, DataFrame]:
    """(rows in time, late rows). Late rows are kept apart, not lost."""
    late = F.col(ts) < F.lit(cutoff)
    return df.filter(~F.coalesce(late, F.lit(False))), df.filter(late)


def mark_late(df: DataFrame, ts: str, seq: str, delay: timedelta = TTL, limit: int | None = None) -> DataFrame:
    """For a stored table: add `late`, true where a row is more than `delay` older than the newest row
    that arrived before it."""
    from ..operators.ordered import Running, prefix

    done = prefix(df, [], [seq], [Running("_newest", "max", F.col(ts))], limit=limit)
    late = F.col(ts) < F.col("_newest") - F.lit(delay)
    return done.withColumn("late", F.coalesce(late, F.lit(False))).drop("_newest")


def alert_windows(alerts: DataFrame, width: str = "1 minute", delay: str = "1 hour") -> DataFrame:
    """Streaming counts per time bucket, emitted once the watermark has passed the bucket."""
    counted = alerts.withWatermark("created_at", delay).groupBy(F.window("created_at", width).alias("_w")).count()
    return counted.select(F.col("_w.start").alias("time"), F.col("count").alias("alerts"))
