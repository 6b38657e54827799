"""Service-level rules evaluated on a grid of steps, with persistence.

All rules are evaluated in one pass: a delta is marked with every rule side it belongs to, the growth per
rule, side, labels and step comes from one aggregation, and one scan per rule and labels finds the runs.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .history import micros
from .series import at_step, counter_delta, matches, persisted, samples_within, spread_steps, step_span

STEP = timedelta(seconds=15)


@dataclass(frozen=True)
class SloRule:
    """A rule on the growth of a counter, or on the ratio of two rates, over a trailing range.

    `num` and `den` are keyword arguments of `series.matches`. Without `den` the value is the growth of
    `num`; with it, the rate of `num` over the rate of `den`, the latter not below `floor`. `by` are the
    labels kept apart (`series`: each series by itself).
    """

    name: str
    num: dict
    breach: str  # ">" or "<"
    limit: float
    range_: timedelta
    for_: timedelta
    severity: str
    den: dict | None = None
    by: Sequence[str] = ()
    floor: float = 1.0
    require_positive: bool = False

    def sides(self) -> list[tuple[int, Column]]:
        return [(i, matches(**m)) for i, m in enumerate((self.num, self.den)) if m is not None]

    def label_text(self) -> Column:
        parts = [
            F.col("series") if b == "series" else F.concat(F.lit(f"{b}="), F.coalesce(F.col("labels")[b], F.lit("")))
            for b in self.by
        ]
        return F.concat_ws(",", *parts) if parts else F.lit("")

    def value(self) -> Column:
        if self.den is None:
            return F.col("num")
        seconds = self.range_.total_seconds()
        return F.col("num") / seconds / F.greatest(F.col("den") / seconds, F.lit(float(self.floor)))

    def breached(self, value: Column) -> Column:
        return value > self.limit if self.breach == ">" else value < self.limit


def standard_rules(floor: float = 1.0) -> list[SloRule]:
    """The eight rules. With the default floor of 1 a stage slower than one event per second reads lower
    than it is."""
    m0, m1, m5, m10, m15 = (timedelta(minutes=m) for m in (0, 1, 5, 10, 15))
    app = ["application"]
    published = dict(name="transaction_events_published_total", eq={"outcome": "success"})
    frauds = dict(name="fraud_decisions_total", eq={"decision": "fraud"})
    alerts = dict(name="fraud_alerts_total")
    notified = "fraud_alert_notifications_total"

    def mean(rule: str, metric: str, seconds: float) -> SloRule:
        num, den = dict(name=f"{metric}_sum"), dict(name=f"{metric}_count")
        return SloRule(rule, num, ">", seconds, m10, m10, "warning", den, app, floor)

    def growth(rule: str, metric: str, range_: timedelta, severity: str, by: Sequence[str]) -> SloRule:
        return SloRule(rule, dict(name=metric), ">", 0, range_, m0, severity, by=by)

    return [
        growth("FraudAlertDetected", "fraud_alerts_total", m1, "warning", ["series"]),
        SloRule("FraudPipelineCoverageSLOViolation", dict(name="fraud_decisions_total"), "<", 0.95, m5, m10, "critical",
                published, floor=floor, require_positive=True),
        # both sides are summed over all applications: alerts and decisions come from different services
        SloRule("FraudToAlertConversionSLOViolation", alerts, "<", 0.98, m10, m15, "critical", frauds, floor=floor),
        SloRule("NotificationFailureRateHigh", dict(name=notified, eq={"outcome": "failed"}), ">", 0.05, m10, m10, "warning",
                dict(name=notified, re={"outcome": "success|failed"}), app, floor),
        mean("FraudEvaluationLatencyHigh", "fraud_evaluation_latency_seconds", 0.25),
        mean("AlertNotificationLatencyHigh", "fraud_alert_notification_latency_seconds", 1.5),
        growth("KafkaDlqTrafficDetected", "kafka_dlq_events_received_total", m5, "warning", app),
        growth("KafkaDlqReprocessFailed", "kafka_dlq_events_failed_total", m5, "critical", app),
    ]


def _per_rule(rules: Sequence[SloRule], make) -> Column:
    """The column `make(rule)` of the row's own rule."""
    out = None
    for i, rule in enumerate(rules):
        out = F.when(F.col("rule_no") == i, make(rule)) if out is None else out.when(F.col("rule_no") == i, make(rule))
    return out


def evaluate_rules(samples: DataFrame, rules: Sequence[SloRule] | None = None, step: timedelta = STEP,
                   t0: datetime | None = None, t1: datetime | None = None,
                   scrape: timedelta | None = None) -> DataFrame:
    """(ts, rule, severity, labels, value, state) for every step at which a rule has a value; `state` is
    inactive, pending or firing.

    With `t0` and `t1` only those steps are evaluated and only the samples they reach are read. `scrape`
    is the smallest distance between two samples of a series, if known.
    """
    rules = list(rules or standard_rules())
    kept = samples.filter(used(rules))
    bound = most = None
    if t0 is not None and t1 is not None:
        kept = kept.filter((F.col("ts") > F.lit(t0 - longest(rules))) & (F.col("ts") <= F.lit(t1)))
        bound = micros(t1 - t0) // micros(step) + 1
        most = samples_within(t1 - t0 + longest(rules), scrape)
    spans = rule_spans(counter_delta(kept, bound=most), rules, step)
    if bound is not None:
        first = F.greatest("_from", F.lit(-(-_us(t0) // micros(step))))
        last = F.least("_to", F.lit(_us(t1) // micros(step)))
        spans = spans.withColumns({"_from": first, "_to": last})
    states = persisted(rule_values(spans, rules), "_breach", holds(rules), SPAN_KEY, step, bound=bound)
    return state_rows(states, rules, step)


SPAN_KEY = ["rule_no", "label_text"]


def used(rules: Sequence[SloRule]) -> Column:
    """Whether a sample belongs to a side of any rule."""
    found = F.lit(False)
    for rule in rules:
        for _, fits in rule.sides():
            found = found | fits
    return found


def longest(rules: Sequence[SloRule]) -> timedelta:
    return max(rule.range_ for rule in rules)


def rule_spans(deltas: DataFrame, rules: Sequence[SloRule], step: timedelta = STEP) -> DataFrame:
    """(rule_no, label_text, _from, _to, num, den): what each delta adds to each side of a rule, and at which steps."""
    marks = [
        F.when(fits, F.struct(F.lit(no).alias("rule_no"), F.lit(side).alias("side"), rule.label_text().alias("label_text"),
                              F.lit(micros(rule.range_)).alias("width")))
        for no, rule in enumerate(rules)
        for side, fits in rule.sides()
    ]
    known = deltas.filter(F.col("delta").isNotNull())
    marked = known.select("ts", "prev_ts", "delta", F.explode(F.array_compact(F.array(*marks))).alias("_m"))
    first, last = step_span(F.col("_m.width"), micros(step))
    return marked.select(
        "_m.rule_no", "_m.label_text", first.alias("_from"), last.alias("_to"),
        F.when(F.col("_m.side") == 0, F.col("delta")).alias("num"), F.when(F.col("_m.side") == 1, F.col("delta")).alias("den"),
    )


def span_sums() -> list[Column]:
    return [F.sum("num").alias("num"), F.sum("den").alias("den")]


def rule_values(spans: DataFrame, rules: Sequence[SloRule]) -> DataFrame:
    """(k, rule_no, label_text, num, den, value, _breach) for the steps at which a rule has a value."""
    grown = spread_steps(spans, SPAN_KEY, *span_sums())
    both = F.col("num").isNotNull() & _per_rule(rules, lambda r: F.lit(r.den is None) | F.col("den").isNotNull())
    positive = _per_rule(rules, lambda r: F.lit(not r.require_positive) | (F.col("den") > 0))
    valued = grown.filter(both & positive).withColumn("value", _per_rule(rules, SloRule.value))
    return valued.withColumn("_breach", _per_rule(rules, lambda r: r.breached(F.col("value"))))


def holds(rules: Sequence[SloRule]) -> Column:
    """How long, in micros, the row's rule has to be broken before it fires."""
    return _per_rule(rules, lambda r: F.lit(micros(r.for_)))


def state_rows(states: DataFrame, rules: Sequence[SloRule], step: timedelta = STEP) -> DataFrame:
    return at_step(states, step).select(
        "ts", _per_rule(rules, lambda r: F.lit(r.name)).alias("rule"),
        _per_rule(rules, lambda r: F.lit(r.severity)).alias("severity"), F.col("label_text").alias("labels"), "value", "state",
    )


def evaluate_rule(samples: DataFrame, rule: SloRule, step: timedelta = STEP, t0: datetime | None = None,
                  t1: datetime | None = None) -> DataFrame:
    return evaluate_rules(samples, [rule], step, t0, t1)


def _us(t: datetime) -> int:
    return round(t.timestamp() * 1_000_000)


def firing(states: DataFrame, names: Sequence[str] | None = None, at: datetime | None = None) -> DataFrame:
    kept = states.filter(F.col("state") == "firing")
    if names is not None:
        kept = kept.filter(F.col("rule").isin(list(names)))
    if at is not None:
        kept = kept.filter(F.col("ts") == F.lit(at))
    return kept


def any_firing(states: DataFrame, names: Sequence[str], at: datetime | None = None) -> DataFrame:
    """1 when one of the rules fires, else 0."""
    return firing(states, names, at).agg(F.when(F.count(F.lit(1)) > 0, 1.0).otherwise(0.0).alias("value"))
