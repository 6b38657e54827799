"""Service-level rules evaluated as samples arrive.

A batch adds what its samples make the counters grow to sums per rule, labels and stretch of steps, evaluates the steps that its newest
sample closes, and hands on three small tables: the newest sample of each series, the sums that reach beyond the closed steps, and the
runs of broken steps that go on. The sums add up in any order, so the result doesn't depend on how the samples are cut into batches, and
what is handed on is bounded by the series and the longest range of a rule, however long the stream has run. A batch reads only
what the one before it handed on, so a batch that is repeated gives the same again.
"""

from __future__ import annotations

from collections.abc import Sequence
from datetime import timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from .. import schemas
from ..operators.history import micros
from ..operators.ordered import Running, prefix
from ..operators.series import counter_delta, series_key
from ..operators.slo import SPAN_KEY, STEP, SloRule, holds, longest, rule_spans, rule_values, span_sums, standard_rules, state_rows, used
from ..sources import tables
from ..sources.tables import Batch
from .jobs import _held, _start

_KEY = "rule_no int, label_text string"
#: What a batch hands on to the next one.
CARRIED = {
    "newest": "series string, ts timestamp, name string, labels map<string, string>, value double",
    "sums": f"{_KEY}, _from long, _to long, num double, den double",
    "runs": f"{_KEY}, k long, since long",
    "closed": "k long",
}
#: States of earlier batches that are kept, for batches that are repeated.
KEPT_BATCHES = 20
STATES = T.StructType([
    T.StructField("ts", T.TimestampType()), *(T.StructField(c, T.StringType()) for c in ("rule", "severity", "labels")),
    T.StructField("value", T.DoubleType()), T.StructField("state", T.StringType()),
])


class _Carried:
    """The tables that batches hand on, a folder for each batch."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def before(self, number: int) -> dict[str, DataFrame]:
        fs, place = tables._hadoop(self.spark, self.path)
        names = [s.getPath().getName() for s in fs.listStatus(place)] if fs.exists(place) else []
        # a batch that was lost halfway has no `closed`, which is written last
        done = [n for n in map(int, names) if n < number and fs.exists(tables._hadoop(self.spark, f"{self.path}/{n}/closed/_SUCCESS")[1])]
        if not done:
            return {kind: self.spark.createDataFrame([], schema) for kind, schema in CARRIED.items()}
        return {kind: self.spark.read.schema(schema).parquet(f"{self.path}/{max(done)}/{kind}") for kind, schema in CARRIED.items()}

    def put(self, number: int, **found: DataFrame) -> None:
        for kind in CARRIED:
            found[kind].write.mode("overwrite").parquet(f"{self.path}/{number}/{kind}")
        fs, old = tables._hadoop(self.spark, f"{self.path}/{number - KEPT_BATCHES}")
        fs.delete(old, True)


def watch_rules(
    samples: DataFrame, states_path: str, checkpoint: str, rules: Sequence[SloRule] | None = None, *, late_path: str,
    delay: timedelta = timedelta(0), step: timedelta = STEP, trigger: dict | None = None,
) -> StreamingQuery:
    """
    The states of `slo.evaluate_rules` for every step up to `delay` before the newest sample, each step once, under `states_path`.

    A sample that comes after a step at or behind its time was closed, or that isn't newer than its series, can change nothing
    any more; it goes to `late_path`, as does one without a time. Samples no rule reads are passed over. Other rules need a new
    checkpoint, since what is handed on lies there and is counted by the rules' places in the list.
    """
    spark, rules = samples.sparkSession, list(rules or standard_rules())
    writer, carried = tables.writer_of(spark, checkpoint), _Carried(spark, f"{checkpoint}/carried")

    def each(batch: DataFrame, batch_id: int) -> None:
        mine, before = Batch(writer, batch_id), carried.before(batch_id)
        known = before["closed"].first()
        newest = before["newest"].select("series", F.col("ts").alias("_newest"))
        read = batch.filter(used(rules)).select(*(f.name for f in schemas.SAMPLE.fields)).withColumn("series", series_key())
        late = F.col("ts").isNull() | F.coalesce(F.col("ts") <= F.col("_newest"), F.lit(False))
        if known is not None:
            late = late | (F.unix_micros("ts") <= known.k * micros(step))
        _held(read.join(newest, "series", "left").withColumn("_late", late), lambda rows: work(rows, before, known.k if known else None, mine))

    def work(rows: DataFrame, before: dict[str, DataFrame], start: int | None, mine: Batch) -> None:
        tables.put_batch(rows.filter("_late").drop("_late", "_newest", "series"), late_path, mine, F.col("ts"))
        fresh = rows.filter(~F.col("_late")).select(*before["newest"].columns)
        seen = fresh.agg(F.max(F.unix_micros("ts"))).first()[0]
        if seen is None:  # nothing new, so nothing closes
            carried.put(mine.number, **before)
            return
        reached = (seen - micros(delay)) // micros(step)
        end = reached if start is None else max(start, reached)
        both = before["newest"].unionByName(fresh)
        deltas = counter_delta(both.drop("series"))
        new = rule_spans(deltas, rules, step).filter("_from <= _to").groupBy(*SPAN_KEY, "_from", "_to").agg(*span_sums())
        sums = before["sums"].unionByName(new).groupBy(*SPAN_KEY, "_from", "_to").agg(*span_sums())
        _held(sums, lambda held: close(held, both, before["runs"], start, end, mine))

    def close(sums: DataFrame, both: DataFrame, runs: DataFrame, start: int | None, end: int, mine: Batch) -> None:
        closing = sums.filter(F.col("_from") <= end).withColumn("_to", F.least("_to", F.lit(end)))
        open_ = sums.filter(F.col("_to") > end).withColumn("_from", F.greatest("_from", F.lit(end + 1)))

        def put(states: DataFrame) -> None:
            tables.put_batch(state_rows(states, rules, step), states_path, mine, F.col("ts"))
            last = both.groupBy("series").agg(F.max_by(F.struct("ts", "name", "labels", "value"), "ts").alias("_row")).select("series", "_row.*")
            names = ["series", "ts", "name", "labels", "value"]
            go_on = states.filter((F.col("k") == end) & F.col("_breach")).select(*SPAN_KEY, "k", F.col("_since").alias("since"))
            # no window of an open step reaches an older one
            reach = F.unix_micros("ts") > end * micros(step) - micros(longest(rules))
            carried.put(
                mine.number, newest=last.filter(reach).select(*names),
                sums=open_.groupBy(*SPAN_KEY, "_from", "_to").agg(*span_sums()),
                runs=runs if end == start else go_on,
                closed=both.sparkSession.createDataFrame([(end,)], CARRIED["closed"]),
            )

        most = None if start is None else end - start + 1  # the steps that close, and the one before
        _held(_continued(rule_values(closing, rules), runs, rules, step, most), put)

    return _start(samples, each, checkpoint, trigger)


def _continued(valued: DataFrame, runs: DataFrame, rules: Sequence[SloRule], step: timedelta, most: int | None) -> DataFrame:
    """`series.persisted` for runs that may have begun before these steps: `state` and `_since`, the step at which the run began."""
    old = runs.select(*SPAN_KEY, "k", F.lit(True).alias("_breach"), F.col("since").alias("_begun"))
    rows = valued.withColumns({"k": F.col("k").cast("long"), "_breach": F.coalesce("_breach", F.lit(False)), "_begun": F.lit(None).cast("long")})
    rows = rows.unionByName(old, allowMissingColumns=True)
    behind = prefix(rows, SPAN_KEY, ["k"], [Running("_before", "last", F.struct("k", "_breach"))], bound=most)
    goes_on = F.coalesce(F.col("_before._breach") & (F.col("_before.k") == F.col("k") - 1), F.lit(False))
    starts = F.when(F.col("_breach") & ~goes_on, F.coalesce("_begun", "k"))
    done = prefix(behind, SPAN_KEY, ["k"], [Running("_since", "last", starts, inclusive=True)], bound=most).filter("_begun is null")
    lasted = (F.col("k") - F.col("_since")) * micros(step)
    state = F.when(~F.col("_breach"), "inactive").when(lasted >= holds(rules), "firing").otherwise("pending")
    return done.withColumn("state", state)
