"""Sending things to the outside world: a ledger of what is to be sent and what came of it, the outbox relay and alert delivery on it.

A ledger is two append-only tables. `intents` says which keys a batch sends and at which attempt, and is written before anything is sent;
`outcomes` says how each attempt ended, and is written once all are made. Nothing is updated in place: the latest outcome of a key is its
state. A batch that is repeated takes its own intents again, whatever has become due since, and sends nothing if its outcomes stand. So
an attempt is made once, unless a batch is lost between sending and its outcomes; then it is made again under the same key and
attempt, by which a receiver can tell. Several senders may share a ledger if each takes its own share of the keys.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from datetime import date, datetime, timedelta

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from .. import schemas
from ..functions.text import error_text
from ..operators.alerts import Channels, fan_out
from ..operators.outbox import BATCH_SIZE, PENDING, PUBLISHED, RETRY_DELAY, publish_headers
from ..sources import tables
from ..sources.tables import Batch

_KEY = [T.StructField("key", T.StringType()), T.StructField("attempt", T.IntegerType())]
INTENT = T.StructType([*_KEY, T.StructField("at", T.TimestampType())])
OUTCOME = T.StructType([
    *_KEY, T.StructField("ok", T.BooleanType()), T.StructField("error", T.StringType()), T.StructField("error_class", T.StringType()),
    T.StructField("duration_ms", T.LongType()), T.StructField("at", T.TimestampType()), T.StructField("next_at", T.TimestampType()),
])
#: Sends one thing, given as a dict of its columns with `attempt`; raises where it fails.
Send = Callable[[dict], None]


@dataclass(frozen=True)
class Policy:
    """How often a key is tried (None: until it succeeds), and how long a failed one waits: `delay`, then `growth` times that, and so on."""

    attempts: int | None = None
    delay: timedelta = RETRY_DELAY
    growth: float = 1.0

    def next_at(self, attempt: Column, at: Column) -> Column:
        """When the attempt after a failed one is due; null when there is none."""
        waited = F.round(F.lit(self.delay.total_seconds() * 1e6) * F.pow(F.lit(self.growth), attempt - 1)).cast("long")
        due = F.timestamp_micros(F.unix_micros(at) + waited)
        return due if self.attempts is None else F.when(attempt < self.attempts, due)


@dataclass(frozen=True)
class Ledger:
    spark: SparkSession
    path: str
    policy: Policy = Policy()

    def _written(self, kind: str, mine: Batch) -> bool:
        fs, pattern = tables._hadoop(self.spark, f"{self.path}/{kind}/day=*/writer={mine.writer}/batch_id={mine.number}")
        return bool(fs.globStatus(pattern))

    def outcomes(self, before: Batch | None = None, first: date | None = None) -> DataFrame:
        return tables.read_table(self.spark, f"{self.path}/outcomes", OUTCOME, before=before, first=first).drop(*tables.PLACE)

    def last(self, before: Batch | None = None, first: date | None = None) -> DataFrame:
        """(key, attempt, ok, error, error_class, duration_ms, at, next_at, retry_at): the latest outcome of each key, and when its latest retry was due."""
        fields = [f.name for f in OUTCOME.fields if f.name != "key"]
        latest = self.outcomes(before, first).groupBy("key").agg(F.max_by(F.struct(*fields), "attempt").alias("_last"), F.max("next_at").alias("retry_at"))
        return latest.select("key", *(F.col(f"_last.{f}").alias(f) for f in fields), "retry_at")

    def send(
        self, items: DataFrame, mine: Batch, now: datetime, send: Send, order: tuple[str, ...] = ("key",), n: int | None = None, first: date | None = None,
        own: Column | None = None,
    ) -> None:
        """
        One pass over `items` (key, due_at, tried and what `send` wants): what is due gets one attempt.

        `tried` counts attempts made elsewhere before. At most `n` items are taken, in `order`. `first` is the first day that outcomes of
        open items can have. `own` says of a key whether it can be among the items at all, where senders share the keys.

        Items go through a shuffle only where they may be claimed; to find what is due, keys and times do.
        """
        if self._written("outcomes", mine):
            return
        place = f"{self.path}/intents"
        if not self._written("intents", mine):
            seen = self.outcomes(mine, first)
            last = (seen if own is None else seen.filter(own)).groupBy("key").agg(
                F.max_by("ok", "attempt").alias("ok"), F.max_by("next_at", "attempt").alias("next_at"), F.max("attempt").alias("_attempt"))
            sorted_by = () if n is None else order
            state = items.select("key", "due_at", "tried", *(c for c in sorted_by if c not in ("key", "due_at", "tried"))).join(last, "key", "left")
            due = F.when(F.col("ok").isNull(), F.col("due_at")).when(~F.col("ok"), F.col("next_at"))
            wanted = state.filter(due <= F.lit(now)).select("key", (F.coalesce("_attempt", "tried") + 1).cast("int").alias("attempt"), F.lit(now).alias("at"), *(c for c in sorted_by if c != "key"))
            if n is not None:
                wanted = wanted.orderBy(*order).limit(n)
            tables.put_batch(wanted.select("key", "attempt", "at"), place, mine, F.lit(now))
        claims = tables.read_table(self.spark, place, INTENT, first=first).filter((F.col("writer") == mine.writer) & (F.col("batch_id") == mine.number))
        claims = claims.select("key", "attempt", F.col("at").alias("_at"))
        claimed = _sieved(items, claims, claims.count()).join(claims, "key")
        made = _attempted(claimed, send)
        next_at = F.when(~F.col("ok"), self.policy.next_at(F.col("attempt"), F.col("at")))
        tables.put_batch(made.withColumn("next_at", next_at), f"{self.path}/outcomes", mine, F.lit(now))


#: Claims of which a bitmap is broadcast, at most, and the bits for each.
SIEVED, BITS = 1 << 23, 16


def _sieved(items: DataFrame, claims: DataFrame, n: int) -> DataFrame:
    """Items without most of those that none of the `n` claims names: a bitmap of hashes finds them before they are sent anywhere."""
    if n == 0 or n > SIEVED:
        return items if n else items.limit(0)
    place = F.pmod(F.xxhash64("key", F.lit(1)), F.lit(-(-n * BITS // 64) * 64).cast("long"))
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), (place % 64).cast("int"))
    words = claims.select(F.shiftright(place, 6).alias("_word"), bit.alias("_bit")).groupBy("_word").agg(F.bit_or("_bit").alias("_bits"))
    return items.join(F.broadcast(words), (F.shiftright(place, 6) == F.col("_word")) & (F.col("_bits").bitwiseAND(bit) != 0)).drop("_word", "_bits")


def _attempted(claimed: DataFrame, send: Send) -> DataFrame:
    """Call `send` on each row, where it lies. One that raises fails its own row alone."""
    from time import perf_counter

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for row in batch.to_dict("records"):
                started, at, error = perf_counter(), row.pop("_at"), None
                try:
                    send(row)
                except Exception as raised:  # any failure of user code is an outcome, not a job failure
                    error = raised
                spent = int((perf_counter() - started) * 1000)
                out.append((row["key"], row["attempt"], error is None, None if error is None else str(error), None if error is None else type(error).__name__, spent, at))
            yield pd.DataFrame(out, columns=["key", "attempt", "ok", "error", "error_class", "duration_ms", "at"]).astype({"ok": bool})

    return claimed.mapInPandas(run, "key string, attempt int, ok boolean, error string, error_class string, duration_ms long, at timestamp")


# ------------------------------------------------------------------ outbox


def relay(
    spark: SparkSession, outbox_path: str, ledger: Ledger, mine: Batch, now: datetime, send: Send, n: int | None = BATCH_SIZE,
    share: tuple[int, int] = (0, 1), first: date | None = None,
) -> None:
    """Send the oldest `n` outbox rows that are due, each once. Relay k of K takes share (k, K); days before `first` have nothing open."""
    rows = tables.read_table(spark, outbox_path, schemas.OUTBOX, first=first).drop(*tables.PLACE)
    mine_too = lambda id_: F.pmod(F.xxhash64(id_), F.lit(share[1])) == share[0]
    open_ = publish_headers(rows.filter((F.col("status") == PENDING) & mine_too("id")))
    items = open_.withColumns({"key": F.col("id"), "due_at": F.col("next_attempt_at"), "tried": F.col("attempts")})
    ledger.send(items, mine, now, send, ("created_at", "key"), n, first, mine_too("key"))


def relayed(outbox: DataFrame, ledger: Ledger) -> DataFrame:
    """The outbox as its ledger leaves it: what `apply_outcomes` would have made of every attempt in turn."""
    last = ledger.last().select(F.col("key").alias("id"), "ok", "attempt", "at", "retry_at", error_text("error", "error_class").alias("_error"))
    joined = outbox.join(last, "id", "left")
    done, failed = F.col("ok") == F.lit(True), F.col("ok") == F.lit(False)
    return joined.withColumns({
        "status": F.when(done, PUBLISHED).otherwise(F.col("status")),
        "attempts": F.when(failed, F.col("attempt")).when(done, F.col("attempt") - 1).otherwise(F.col("attempts")),
        "next_attempt_at": F.coalesce("retry_at", "next_attempt_at"),
        "published_at": F.when(done, F.col("at")).otherwise(F.col("published_at")),
        "last_error": F.when(failed, F.col("_error")).when(done.isNull(), F.col("last_error")),
    }).select(*outbox.columns)


def first_open_day(spark: SparkSession, outbox_path: str, ledger: Ledger) -> date | None:
    """The first day with a row that is still to be sent: a relay needs none before it. None if nothing is open."""
    rows = tables.read_table(spark, outbox_path, schemas.OUTBOX)
    done = ledger.outcomes().filter("ok").select(F.col("key").alias("id"))
    return rows.filter(F.col("status") == PENDING).join(done, "id", "left_anti").agg(F.min("day")).first()[0]


def relay_stream(
    ticks: DataFrame, outbox_path: str, ledger_path: str, checkpoint: str, send: Send, policy: Policy = Policy(), n: int | None = BATCH_SIZE,
    share: tuple[int, int] = (0, 1), trigger: dict | None = None,
) -> StreamingQuery:
    """A relay that makes a pass with every batch of `ticks`, any stream that has rows now and then (such as Spark's `rate` source)."""
    spark = ticks.sparkSession
    ledger, writer = Ledger(spark, ledger_path, policy), tables.writer_of(spark, checkpoint)

    def each(batch: DataFrame, batch_id: int) -> None:
        relay(spark, outbox_path, ledger, Batch(writer, batch_id), tables.batch_time(spark, checkpoint, batch_id), send, n, share)

    stream = ticks.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint)
    return stream.trigger(**(trigger or {"processingTime": "1 second"})).start()


# ------------------------------------------------------------------ notifications

#: Five tries, after 2, 4, 8 and 16 seconds.
NOTIFY = Policy(attempts=5, delay=timedelta(seconds=2), growth=2.0)


def notify(alerts: DataFrame, channels: Channels, senders: dict[str, Send], ledger: Ledger, mine: Batch, now: datetime) -> None:
    """
    One pass of delivery: every alert and channel without a success, or a failure that may not be retried yet, is sent once.

    `alerts` may be the alerts of a batch or a stored table; what was delivered before is known by alert, channel and place among the channels.
    """
    fanned = fan_out(alerts, channels)
    items = fanned.withColumns({"key": F.concat_ws("/", "id", "position", "channel"), "due_at": F.lit(datetime(1970, 1, 1)), "tried": F.lit(0)})
    ledger.send(items, mine, now, lambda row: senders[row["channel"]](row))


def notifications(ledger: Ledger) -> DataFrame:
    """The latest outcome of each delivery, as rows of notifications with the number of attempts."""
    parts = F.split("key", "/")
    return ledger.last().select(
        parts[0].alias("alert_id"), parts[2].alias("channel"), F.when(F.col("ok"), "success").otherwise("failed").alias("outcome"), "duration_ms", "attempt",
    )
