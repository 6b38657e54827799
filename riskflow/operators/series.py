"""Counters and gauges as time series.

Samples are rows `(ts, name, labels, value)`. `as_series` turns the labels in use into columns and adds
one text key per series. Everything over a range of time is one ordered scan per series, summarised into
one row per series (or per series and evaluation step); ratios and quantiles work on those small tables.
"""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .history import micros
from .ordered import Running, prefix


def series_key(name: str = "name", labels: str = "labels") -> Column:
    pairs = F.array_sort(F.map_entries(F.coalesce(F.col(labels), F.create_map().cast("map<string,string>"))))
    text = F.transform(pairs, lambda e: F.concat(e["key"], F.lit("="), F.coalesce(e["value"], F.lit(""))))
    return F.concat(F.col(name), F.lit("{"), F.array_join(text, ","), F.lit("}"))


def matches(name: str | Sequence[str] | None = None, *, eq: dict | None = None, ne: dict | None = None,
            re: dict | None = None, nre: dict | None = None) -> Column:
    """Label matchers as a condition. A missing label equals the empty string; patterns match the whole value."""
    def label(key: str) -> Column:
        return F.coalesce(F.col("labels")[key], F.lit(""))

    found = F.lit(True)
    if name is not None:
        found = F.col("name").isin([name] if isinstance(name, str) else list(name))
    for key, value in (eq or {}).items():
        found = found & (label(key) == value)
    for key, value in (ne or {}).items():
        found = found & (label(key) != value)
    for key, pattern in (re or {}).items():
        found = found & label(key).rlike(f"\\A(?:{pattern})\\z")
    for key, pattern in (nre or {}).items():
        found = found & ~label(key).rlike(f"\\A(?:{pattern})\\z")
    return found


def match(samples: DataFrame, name: str | Sequence[str] | None = None, **matchers) -> DataFrame:
    """The samples (or series of a summary) that fit the matchers."""
    return samples.filter(matches(name, **matchers))


def label_values(samples: DataFrame, name: str, label: str, **matchers) -> DataFrame:
    """Distinct non-empty values of a label."""
    found = match(samples, name, **matchers).select(F.col("labels")[label].alias("value"))
    return found.filter("value is not null and value <> ''").distinct()


def counter_delta(samples: DataFrame, limit: int | None = None, bound: int | None = None) -> DataFrame:
    """Add the previous sample of the series and the growth since; a smaller value is a restart from 0.
    `bound` is a proven upper limit of samples per series, if there is one."""
    keyed = samples.withColumn("series", series_key())
    before = Running("_prev", "last", F.struct("ts", "value"))
    done = prefix(keyed, ["series"], ["ts"], [before], limit=limit, bound=bound)
    before, value = F.col("_prev.value"), F.col("value")
    return done.withColumns(
        {
            "prev_ts": F.col("_prev.ts"),
            "prev_value": before,
            "delta": F.when(before.isNotNull(), F.when(value < before, value).otherwise(value - before)),
        }
    ).drop("_prev")


def _labels(by: Sequence[str]) -> list[Column]:
    """Labels as columns; the name `series` stands for the whole label set."""
    return [
        F.col("series") if b == "series" else F.coalesce(F.col("labels")[b], F.lit("")).alias(b) for b in by
    ]


def samples_within(width: timedelta, scrape: timedelta | None) -> int | None:
    """Most samples a series can have in a time range when scrapes are at least `scrape` apart."""
    return None if scrape is None else micros(width) // micros(scrape) + 1


def in_window(samples: DataFrame, t0: datetime, t1: datetime) -> DataFrame:
    """Samples in `(t0, t1]`."""
    return samples.filter((F.col("ts") > F.lit(t0)) & (F.col("ts") <= F.lit(t1)))


def summarise(samples: DataFrame, t0: datetime, t1: datetime, rate_interval: timedelta = timedelta(minutes=1),
              extrapolate: bool = False, limit: int | None = None, scrape: timedelta | None = None) -> DataFrame:
    """One row per series for `(t0, t1]`: growth over the range (`increase`), per-second growth over the
    last `rate_interval` (`rate`), growth per second between the last two samples of the last minute
    (`irate`), and the latest value (`gauge`).

    `scrape` is the smallest distance between two samples of a series, if known: it bounds their number
    and saves the search for oversized series.

    With `extrapolate` the growth is stretched to the edges of its window, as far as the spacing of the
    samples allows and never below zero at the start; otherwise it is the plain sum of the deltas.
    """
    span = (t1 - t0).total_seconds()
    seconds = rate_interval.total_seconds()
    rate_from, irate_from = t1 - rate_interval, t1 - timedelta(minutes=1)
    start = min(t0, rate_from, irate_from)
    deltas = counter_delta(in_window(samples, start, t1), limit, samples_within(t1 - start, scrape))

    def grown(start: datetime) -> Column:
        return F.sum(F.when(F.col("prev_ts") > F.lit(start), F.col("delta")))

    def edge(fn, start: datetime, col: str = "ts") -> Column:
        return fn(F.when(F.col("ts") > F.lit(start), F.col(col)))

    pair = F.struct("prev_ts", "ts", "delta")
    aggregated = deltas.groupBy("name", "series").agg(
        F.first("labels").alias("labels"),
        grown(t0).alias("increase"),
        grown(rate_from).alias("_rated"),
        F.max_by(F.when(F.col("prev_ts") > F.lit(irate_from), pair), F.col("ts")).alias("_last"),
        F.max_by("value", "ts").alias("gauge"),
        *(
            c
            for tag, start in (("a", t0), ("b", rate_from))
            for c in (
                edge(F.min, start).alias(f"_{tag}_first"),
                edge(F.max, start).alias(f"_{tag}_end"),
                F.min_by(F.when(F.col("ts") > F.lit(start), F.col("value")),
                         F.when(F.col("ts") > F.lit(start), F.col("ts"))).alias(f"_{tag}_value"),
                F.count(F.when(F.col("ts") > F.lit(start), 1)).alias(f"_{tag}_n"),
            )
        ),
    )
    increase, rated = F.col("increase"), F.col("_rated")
    if extrapolate:
        increase = increase * _stretch("a", t0, t1, increase)
        rated = rated * _stretch("b", rate_from, t1, rated)
    gap = (F.unix_micros("_last.ts") - F.unix_micros("_last.prev_ts")) / 1e6
    return aggregated.select(
        "name", "series", "labels",
        increase.alias("increase"),
        (rated / seconds).alias("rate"),
        F.when(gap > 0, F.col("_last.delta") / gap).alias("irate"),
        "gauge",
        (increase / span).alias("range_rate"),
    )


def _stretch(tag: str, start: datetime, end: datetime, grown: Column) -> Column:
    """Factor that extends a sampled interval to its window: by at most half a sample spacing when the
    edge is far, and at the start no further than where the counter would have been zero."""
    first, last = F.unix_micros(f"_{tag}_first") / 1e6, F.unix_micros(f"_{tag}_end") / 1e6
    covered = last - first
    spacing = covered / (F.col(f"_{tag}_n") - 1)
    head = first - F.unix_micros(F.lit(start)) / 1e6
    tail = F.unix_micros(F.lit(end)) / 1e6 - last
    to_zero = F.when((grown > 0) & (F.col(f"_{tag}_value") >= 0), covered * F.col(f"_{tag}_value") / grown)
    head = F.when(head >= spacing * 1.1, spacing / 2).otherwise(head)
    head = F.least(head, F.coalesce(to_zero, head))
    tail = F.when(tail >= spacing * 1.1, spacing / 2).otherwise(tail)
    return F.when(covered > 0, (covered + head + tail) / covered).otherwise(1.0)


def total(summary: DataFrame, col: str, by: Sequence[str] = (), agg: str = "sum", out: str = "value") -> DataFrame:
    """Aggregate one column of the series summary by labels; series without a value are left out."""
    kept = summary.filter(F.col(col).isNotNull())
    value = {"sum": F.sum, "avg": F.avg, "max": F.max, "min": F.min}[agg](col)
    grouped = kept.select(*_labels(by), col).groupBy(*by).agg(value.alias(out))
    return grouped if by else grouped.filter(F.col(out).isNotNull())


def increase(samples: DataFrame, by: Sequence[str], t0: datetime, t1: datetime, **kw) -> DataFrame:
    return total(summarise(samples, t0, t1, **kw), "increase", by)


def rate(samples: DataFrame, by: Sequence[str], t1: datetime, range_: timedelta, **kw) -> DataFrame:
    return total(summarise(samples, t1 - range_, t1, range_, **kw), "rate", by)


def irate(samples: DataFrame, by: Sequence[str], t1: datetime, **kw) -> DataFrame:
    return total(summarise(samples, t1 - timedelta(minutes=1), t1, **kw), "irate", by)


def gauge(samples: DataFrame, agg: str, by: Sequence[str], t1: datetime, lookback: timedelta = timedelta(minutes=5)) -> DataFrame:
    """Latest value per series not older than `lookback`, aggregated by labels."""
    kept = in_window(samples, t1 - lookback, t1).withColumn("series", series_key())
    latest = kept.groupBy("series").agg(F.first("labels").alias("labels"), F.max_by("value", "ts").alias("gauge"))
    return total(latest, "gauge", by, agg)


# ------------------------------------------------------------------ arithmetic between small results


def single(df: DataFrame) -> DataFrame:
    """A frame that must have one row at most, as one row is all that may be joined without labels; fails if it has more."""
    row = df.agg(F.count(F.lit(1)).alias("_n"), *(F.first(c).alias(c) for c in df.columns))
    checked = F.when(F.col("_n") > 1, F.raise_error(F.lit("a vector without labels has several rows"))).otherwise(F.col("_n") == 1)
    return row.filter(checked.cast("boolean")).drop("_n")


def safe_ratio(num: DataFrame, den: DataFrame, on: Sequence[str] = (), floor: float | None = 1.0,
               cap: float | None = None, require_positive: bool = False) -> DataFrame:
    """`num / max(den, floor)`, optionally capped, optionally only where the denominator is positive.
    Without `floor` a zero denominator gives null. With no `on` both sides are single rows."""
    right = den.withColumnRenamed("value", "_den")
    joined = num.join(right, list(on)) if on else num.join(F.broadcast(single(right)))
    base = F.col("_den") if floor is None else F.greatest(F.col("_den"), F.lit(float(floor)))
    value = F.col("value") / F.nullif(base, F.lit(0.0))
    if cap is not None:
        value = F.least(value, F.lit(float(cap)))
    if require_positive:
        joined = joined.filter(F.col("_den") > 0)
    return joined.withColumn("value", value).drop("_den")


def scaled(df: DataFrame, factor: float) -> DataFrame:
    return df.withColumn("value", F.col("value") * F.lit(float(factor)))


def mean_latency(summary: DataFrame, name: str, by: Sequence[str] = (), col: str = "increase",
                 require_positive: bool = False, factor: float = 1.0) -> DataFrame:
    """Growth of `<name>_sum` over growth of `<name>_count`."""
    parts = [total(summary.filter(F.col("name") == f"{name}_{p}"), col, by) for p in ("sum", "count")]
    return scaled(safe_ratio(*parts, on=by, require_positive=require_positive), factor)


_ARITHMETIC = {"-": lambda a, b: a - b, "+": lambda a, b: a + b, "*": lambda a, b: a * b,
               "/": lambda a, b: a / F.nullif(b, F.lit(0.0))}


def vector_join(a: DataFrame, b: DataFrame, on: Sequence[str], op: str, keep: Sequence[str] = ()) -> DataFrame:
    """Combine two gauge tables label by label. `a` and `b` have label columns and `value`."""
    right = b.select(*on, *keep, F.col("value").alias("_other"))
    joined = a.join(right, list(on)) if on else a.join(F.broadcast(single(right)))
    return joined.withColumn("value", _ARITHMETIC[op](F.col("value"), F.col("_other"))).drop("_other")


def vector_or(a: DataFrame, b: DataFrame, on: Sequence[str] = ()) -> DataFrame:
    """Rows of `a`, and rows of `b` whose labels do not occur in `a`."""
    if on:
        both = a.select(*on, F.col("value").alias("_a"), F.lit(True).alias("_in_a")).join(
            b.select(*on, F.col("value").alias("_b")), list(on), "full"
        )
        return both.select(*on, F.when(F.col("_in_a"), F.col("_a")).otherwise(F.col("_b")).alias("value"))
    # both sides are single values: prefer the first that exists
    ranked = a.select(F.lit(0).alias("_r"), "value").union(b.select(F.lit(1), F.col("value")))
    return ranked.agg(F.min_by("value", "_r").alias("value"), F.count(F.lit(1)).alias("_n")).filter("_n > 0").drop("_n")


def latest_vector(summary: DataFrame, name: str, labels: Sequence[str]) -> DataFrame:
    """The gauge of every series of a metric with its labels as columns."""
    return summary.filter(F.col("name") == name).select(*_labels(labels), F.col("gauge").alias("value"))


def consumer_lag(end: DataFrame, committed: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """End offset minus committed offset per topic and partition, never negative, summed by labels."""
    on = [c for c in ("topic", "partition", "instance", "job") if c in end.columns and c in committed.columns]
    gap = vector_join(committed, end, on, "-").withColumn("value", F.greatest(-F.col("value"), F.lit(0.0)))
    return gap.groupBy(*by).agg(F.sum("value").alias("value"))


def histogram_quantile(buckets: DataFrame, q: float, by: Sequence[str] = ()) -> DataFrame:
    """Quantile from cumulative buckets (`le`, `value`), interpolated inside the bucket it falls in.

    The buckets of one group are few (one per bound), so they fit one array.
    """
    bound = F.when(F.col("le").isin("+Inf", "Inf"), F.lit(float("inf"))).otherwise(F.col("le").cast("double"))
    merged = buckets.groupBy(*by, bound.alias("_le")).agg(F.sum("value").alias("_n"))
    sorted_ = merged.groupBy(*by).agg(F.sort_array(F.collect_list(F.struct("_le", "_n"))).alias("_b"))
    n = F.size("_b")
    top = F.element_at("_b", -1)
    rank = top["_n"] * F.lit(q)
    at = F.size(F.filter("_b", lambda b: b["_n"] < rank))  # buckets below the rank
    hit = F.get("_b", at)
    low_bound = F.when(at == 0, F.lit(0.0)).otherwise(F.get("_b", at - 1)["_le"])
    low_count = F.when(at == 0, F.lit(0.0)).otherwise(F.get("_b", at - 1)["_n"])
    inside = low_bound + (hit["_le"] - low_bound) * (rank - low_count) / F.nullif(hit["_n"] - low_count, F.lit(0.0))
    value = (
        F.when((n < 2) | (top["_le"] != float("inf")) | (top["_n"] == 0), F.lit(float("nan")))
        .when(hit["_le"] == float("inf"), F.get("_b", n - 2)["_le"])  # beyond the last finite bound
        .when((at == 0) & (hit["_le"] <= 0), hit["_le"])
        .otherwise(inside)
    )
    return sorted_.select(*by, value.alias("value"))


def reduce_series(df: DataFrame, calc: str, by: Sequence[str] = (), ts: str = "ts") -> DataFrame:
    """One number per series of `(ts, value)`: last, mean, max, min or sum of the non-null values."""
    value = {
        "last": F.max_by("value", F.when(F.col("value").isNotNull(), F.col(ts))),
        "mean": F.avg("value"), "max": F.max("value"), "min": F.min("value"), "sum": F.sum("value"),
    }[calc]
    return df.groupBy(*by).agg(value.alias("value"))


# ------------------------------------------------------------------ evaluation on a grid of steps


def increase_steps(samples: DataFrame, by: Sequence[str], range_: timedelta, step: timedelta = timedelta(seconds=15),
                   limit: int | None = None) -> DataFrame:
    """Growth over the trailing range at every step `k` (time = k * step): columns k, labels, value.

    `samples` may carry the deltas already (from `counter_delta`), so that several calls share one scan.
    A delta counts at the steps whose window holds both of its samples. Deltas with the same first and
    last step are added up before they are spread over their steps, so the spread works on aggregates.
    """
    known = samples if "delta" in samples.columns else counter_delta(samples, limit)
    deltas = known.filter(F.col("delta").isNotNull())
    first, last = step_span(micros(range_), micros(step))
    spans = deltas.select(*_labels(by), first.alias("_from"), last.alias("_to"), "delta")
    return spread_steps(spans, by, F.sum("delta").alias("value"))


def step_span(width: int | Column, stride: int) -> tuple[Column, Column]:
    """First and last step whose trailing window of `width` micros holds both samples of a delta."""
    return _up(F.unix_micros("ts"), stride), _up(F.unix_micros("prev_ts") + width, stride) - 1


def _up(value: Column, stride: int) -> Column:
    """Smallest k with k * stride >= value, in whole numbers."""
    return ((value + F.pmod(-value, F.lit(stride))) / F.lit(stride)).cast("long")


def spread_steps(spans: DataFrame, by: Sequence[str], *sums: Column) -> DataFrame:
    """Add up rows with the same `_from` and `_to`, spread them over those steps and add up per step.
    `sums` are sums named like the columns they read after the first pass."""
    kept = spans.filter(F.col("_from") <= F.col("_to"))
    merged = kept.groupBy(*by, "_from", "_to").agg(*sums)
    names = [c for c in merged.columns if c not in (*by, "_from", "_to")]
    spread = merged.select(*by, F.explode(F.sequence("_from", "_to")).alias("k"), *names)
    return spread.groupBy("k", *by).agg(*(F.sum(n).alias(n) for n in names))


def at_step(df: DataFrame, step: timedelta = timedelta(seconds=15)) -> DataFrame:
    return df.withColumn("ts", F.timestamp_micros(F.col("k") * F.lit(micros(step))))


def rate_steps(samples: DataFrame, by: Sequence[str], range_: timedelta, step: timedelta = timedelta(seconds=15),
               limit: int | None = None) -> DataFrame:
    return scaled(increase_steps(samples, by, range_, step, limit), 1.0 / range_.total_seconds())


def _held_steps(rows: DataFrame, until: Column, step: timedelta) -> DataFrame:
    """Each row of a series (`series`, `ts`) at the steps `k` from its time on, up to `until` or the series' next row.

    Of rows within one step the last counts. After that a series has a row per step at most, which bounds its window.
    """
    stride = micros(step)
    kept = [c for c in rows.columns if c != "series"]
    first = _up(F.unix_micros("ts"), stride)
    per_step = rows.withColumn("_until", until).groupBy("series", first.alias("_from")).agg(F.max_by(F.struct(*kept, "_until"), "ts").alias("_row"))
    following = F.lead("_from").over(Window.partitionBy("series").orderBy("_from"))
    last = F.least(F.coalesce(following, F.lit(1 << 62)), _up(F.col("_row._until"), stride)) - 1
    spans = per_step.withColumn("_to", last).filter(F.col("_from") <= F.col("_to"))
    return spans.select("series", "_row.*", F.explode(F.sequence("_from", "_to")).alias("k")).drop("_until")


def gauge_steps(samples: DataFrame, agg: str, by: Sequence[str], lookback: timedelta = timedelta(minutes=5),
                step: timedelta = timedelta(seconds=15)) -> DataFrame:
    """Latest value per series not older than `lookback` at every step, aggregated by labels: columns k, labels, value."""
    rows = samples.select(series_key().alias("series"), "ts", "labels", "value")
    held = _held_steps(rows, F.unix_micros("ts") + micros(lookback), step)
    value = {"sum": F.sum, "avg": F.avg, "max": F.max, "min": F.min}[agg]("value")
    return held.select("k", *_labels(by), "value").groupBy("k", *by).agg(value.alias("value"))


def irate_steps(samples: DataFrame, by: Sequence[str], range_: timedelta = timedelta(minutes=1),
                step: timedelta = timedelta(seconds=15), limit: int | None = None) -> DataFrame:
    """Growth per second between the last two samples of the trailing range at every step, summed by labels."""
    known = samples if "delta" in samples.columns else counter_delta(samples, limit)
    seconds = (F.unix_micros("ts") - F.unix_micros("prev_ts")) / 1e6
    rows = known.filter(F.col("delta").isNotNull()).select("series", "ts", "labels", (F.col("delta") / seconds).alias("value"), "prev_ts")
    held = _held_steps(rows, F.unix_micros("prev_ts") + micros(range_), step)
    return held.select("k", *_labels(by), "value").groupBy("k", *by).agg(F.sum("value").alias("value"))


def mean_latency_steps(samples: DataFrame, name: str, by: Sequence[str], range_: timedelta, factor: float = 1.0,
                       step: timedelta = timedelta(seconds=15), limit: int | None = None) -> DataFrame:
    """Growth of `<name>_sum` over growth of `<name>_count` in the trailing range at every step."""
    deltas = counter_delta(match(samples, [f"{name}_sum", f"{name}_count"]), limit)
    parts = [increase_steps(deltas.filter(F.col("name") == f"{name}_{p}"), by, range_, step) for p in ("sum", "count")]
    return scaled(safe_ratio(*parts, on=["k", *by]), factor)


def quantile_steps(samples: DataFrame, q: float, by: Sequence[str], range_: timedelta,
                   step: timedelta = timedelta(seconds=15), limit: int | None = None) -> DataFrame:
    """Quantile of the growth of cumulative buckets in the trailing range at every step."""
    return histogram_quantile(increase_steps(samples, ["le", *by], range_, step, limit), q, ["k", *by])


def stage_gap(in_: DataFrame, out_: DataFrame, width: timedelta, step: timedelta = timedelta(seconds=15)) -> DataFrame:
    """Rate into a stage minus rate out of it at every step; positive means a growing backlog."""
    a, b = rate_steps(in_, [], width, step), rate_steps(out_, [], width, step)
    return at_step(vector_join(a, b, ["k"], "-"), step)


def tumbling_count(df: DataFrame, ts: str, width: str, *by: str) -> DataFrame:
    counted = df.groupBy(F.window(ts, width).alias("_w"), *by).agg(F.count(F.lit(1)).alias("n"))
    return counted.select(F.col("_w.start").alias("start"), *by, "n")


def sliding(df: DataFrame, ts: str, width: str, step: str, *by: str) -> DataFrame:
    """Event counts in overlapping windows. Rows are counted per step first, then spread over windows."""
    per_step = tumbling_count(df, ts, step, *by)
    spread = per_step.groupBy(F.window("start", width, step).alias("_w"), *by).agg(F.sum("n").alias("n"))
    return spread.select(F.col("_w.start").alias("start"), F.col("_w.end").alias("end"), *by, "n")


def persisted(df: DataFrame, flag: str, for_: timedelta | Column, by: Sequence[str] = (), step: timedelta = timedelta(seconds=15),
              limit: int | None = None, bound: int | None = None) -> DataFrame:
    """State of a condition evaluated at steps `k`: inactive, pending, or firing once it has held at every
    step for `for_` (a duration, or a column of microseconds). A step without a row breaks the run."""
    hold = F.lit(micros(for_)) if isinstance(for_, timedelta) else for_
    rows = df.withColumns({"k": F.col("k").cast("long"), "_held": F.coalesce(F.col(flag), F.lit(False))})
    same = dict(limit=limit, bound=bound)
    behind = prefix(rows, list(by), ["k"], [Running("_before", "last", F.struct("k", "_held"))], **same)
    goes_on = F.col("_before._held") & (F.col("_before.k") == F.col("k") - 1)
    starts = F.when(F.col("_held") & ~F.coalesce(goes_on, F.lit(False)), F.col("k"))
    since = prefix(behind, list(by), ["k"], [Running("_since", "last", starts, inclusive=True)], **same)
    lasted = (F.col("k") - F.col("_since")) * micros(step)
    state = F.when(~F.col("_held"), "inactive").when(lasted >= hold, "firing").otherwise("pending")
    return since.withColumn("state", state).drop("_held", "_before", "_since")
