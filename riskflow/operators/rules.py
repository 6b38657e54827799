"""Weighted risk rules as column expressions: no Python runs per row."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field
from datetime import timedelta
from decimal import Decimal

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .history import against_stored, with_history

# Names, weights, merchants and version as they appear in decisions and events.
HIGH_AMOUNT, HIGH_AMOUNT_WEIGHT = "HIGH_AMOUNT", 45
HIGH_VELOCITY, HIGH_VELOCITY_WEIGHT = "HIGH_VELOCITY", 35
COUNTRY_CHANGE, COUNTRY_CHANGE_WEIGHT = "COUNTRY_CHANGE_IN_SHORT_WINDOW", 30
HIGH_RISK_MERCHANT, HIGH_RISK_MERCHANT_WEIGHT = "HIGH_RISK_MERCHANT", 25
HIGH_RISK_MERCHANTS = ("MRC-999", "MRC-666", "MRC-404")
RULE_VERSION = "v1.0.0"
MAX_SCORE = 100


@dataclass(frozen=True)
class RuleConfig:
    high_amount_threshold: Decimal = Decimal("10000.00")
    velocity_max_transactions: int = 5
    velocity_window: timedelta = timedelta(minutes=1)
    country_change_window: timedelta = timedelta(minutes=30)
    fraud_score_threshold: int = 70
    high_risk_merchants: Sequence[str] = HIGH_RISK_MERCHANTS

    @property
    def reach(self) -> timedelta:
        return max(self.velocity_window, self.country_change_window)


@dataclass(frozen=True)
class Rule:
    """One rule: a boolean column over a transaction with its history. Null counts as false."""

    name: str
    predicate: Column = field(compare=False)
    weight: int

    @property
    def hit(self) -> Column:
        return F.coalesce(self.predicate, F.lit(False))


def high_amount(config: RuleConfig) -> Rule:
    return Rule(HIGH_AMOUNT, F.col("amount") > F.lit(config.high_amount_threshold), HIGH_AMOUNT_WEIGHT)


def high_velocity(config: RuleConfig) -> Rule:
    return Rule(
        HIGH_VELOCITY, F.col("prior_count") + 1 >= config.velocity_max_transactions, HIGH_VELOCITY_WEIGHT
    )


def country_change(config: RuleConfig) -> Rule:
    changed = F.lower("prev_country") != F.lower("country")
    recent = F.col("prev_occurred_at") > F.col("occurred_at") - F.lit(config.country_change_window)
    return Rule(COUNTRY_CHANGE, changed & recent, COUNTRY_CHANGE_WEIGHT)


def on_list(col: str, values: Sequence[str]) -> Column:
    """Case-insensitive membership in a short list; no trimming, null is not a member."""
    return F.coalesce(F.upper(F.col(col)).isin([v.upper() for v in values]), F.lit(False))


def high_risk_merchant(config: RuleConfig) -> Rule:
    return Rule(HIGH_RISK_MERCHANT, on_list("merchant_id", config.high_risk_merchants), HIGH_RISK_MERCHANT_WEIGHT)


def flag_listed(df: DataFrame, col: str, listed: DataFrame, value: str, out: str = "listed") -> DataFrame:
    """Case-insensitive membership in a table of any size. Spark picks the join from the table's size,
    and a hot value is handled by its skew-join rule; values are made unique so rows never multiply."""
    members = listed.select(F.upper(F.col(value)).alias("_member")).filter("_member is not null").distinct()
    joined = df.join(members, F.upper(F.col(col)) == F.col("_member"), "left")
    return joined.withColumn(out, F.col("_member").isNotNull()).drop("_member")


def default_rules(config: RuleConfig = RuleConfig()) -> list[Rule]:
    """The standard rules in the order their names are reported."""
    return [high_amount(config), high_velocity(config), country_change(config), high_risk_merchant(config)]


def evaluate(df: DataFrame, rules: Sequence[Rule], threshold: int = 70) -> DataFrame:
    """Add risk_score (capped sum of weights), fraudulent and reasons (rule order)."""
    total = F.lit(0)
    for rule in rules:
        total = total + F.when(rule.hit, F.lit(rule.weight)).otherwise(F.lit(0))
    named = F.array(*(F.when(rule.hit, F.lit(rule.name)) for rule in rules))
    score = F.least(F.lit(MAX_SCORE), total).cast("int")
    return df.withColumns(
        {
            "risk_score": score,
            "fraudulent": score >= threshold,
            "reasons": F.array_compact(named),
        }
    )


def score(df: DataFrame, config: RuleConfig = RuleConfig(), rules: Sequence[Rule] | None = None,
          limit: int | None = None) -> DataFrame:
    """Score a whole table of transactions in event-time order; one shuffle, on the user."""
    known = with_history(df, config.velocity_window, limit=limit)
    return evaluate(known, rules or default_rules(config), config.fraud_score_threshold)


def score_batch(new: DataFrame, history: DataFrame, config: RuleConfig = RuleConfig(),
                rules: Sequence[Rule] | None = None, limit: int | None = None) -> DataFrame:
    """Score new transactions against those already stored."""
    known = against_stored(new, history, config.velocity_window, config.reach, limit)
    return evaluate(known, rules or default_rules(config), config.fraud_score_threshold)
