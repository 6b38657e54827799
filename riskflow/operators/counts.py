"""Business counters, timers and load reports as aggregations. All combine before the shuffle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.labels import status_class
from ..session import settled
from .ordered import Running, first_rows, numbered, prefix



def _count(name: str) -> Column:
    return F.count(F.lit(1)).alias(name)


def decisions_by_label(scored: DataFrame) -> DataFrame:
    label = F.when(F.col("fraudulent"), "fraud").otherwise("clean").alias("decision")
    return scored.groupBy(label).agg(_count("decisions"))


def rule_hits(scored: DataFrame) -> DataFrame:
    return scored.select(F.explode("reasons").alias("rule")).groupBy("rule").agg(_count("hits"))


def received_by_channel(requests: DataFrame) -> DataFrame:
    return requests.groupBy("channel").agg(_count("received"))


def outcome_counts(df: DataFrame, *by: str) -> DataFrame:
    return df.groupBy(*(by or ("outcome",))).agg(_count("n"))


def timer_summary(df: DataFrame, duration: str, *by: str) -> DataFrame:
    d = F.col(duration)
    return df.groupBy(*by).agg(
        F.count(d).alias("count"), F.sum(d).alias("total"), F.max(d).alias("max"), F.avg(d).alias("mean")
    )


def dlq_counts(letters: DataFrame, *by: str) -> DataFrame:
    """Received, reprocessed and failed dead letters; `outcome` is reprocessed or failed."""
    def n(outcome: str) -> Column:
        return F.count(F.when(F.col("outcome") == outcome, 1)).alias(outcome)

    return letters.groupBy(*by).agg(_count("received"), n("reprocessed"), n("failed"))


def metric_delta(samples: DataFrame, name: str) -> DataFrame:
    """Total of a metric over all label sets at its first and last scrape, and the difference."""
    kept = samples.filter(F.col("name") == name)
    totals = kept.groupBy("ts").agg(F.sum("value").alias("total"))
    return totals.agg(
        F.min_by("total", "ts").alias("before"), F.max_by("total", "ts").alias("after")
    ).withColumn("delta", F.col("after") - F.col("before"))


def nearest_rank(df: DataFrame, value: str, shares: dict[str, float], limit: int | None = None) -> DataFrame:
    """Exact nearest-rank percentiles: the value at sorted position `ceil(n * p)`, at least the first.

    Values are counted first, and the counts are summed along the sorted distinct values by a scan that
    splits, so neither many rows nor many distinct values gather in one task.
    """
    counted = settled(df.filter(F.col(value).isNotNull()).groupBy(value).agg(_count("_n")))
    return ranks(counted, value, shares, limit)


def ranks(counted: DataFrame, value: str, shares: dict[str, float], limit: int | None = None) -> DataFrame:
    """`nearest_rank` of values that are counted (`_n`) and settled already."""
    total = counted.agg(F.sum("_n")).first()[0] or 0
    ranked = prefix(counted, [], [value], [Running("_upto", "sum", F.col("_n"), inclusive=True)], limit=limit)
    picks = []
    for name, share in shares.items():
        rank = max(1, -(-int(round(total * share * 1_000_000)) // 1_000_000))
        inside = (F.col("_upto") >= rank) & (F.col("_upto") - F.col("_n") < rank)
        picks.append(F.max(F.when(inside, F.col(value))).alias(name))
    return ranked.agg(*picks)


def load_report(results: DataFrame, share: float = 0.95, limit: int | None = None, expected: int = 201) -> DataFrame:
    """Requests, errors (any status but `expected`), error rate and nearest-rank latency of a load run."""
    wrong = ~F.coalesce(F.col("statusCode") == expected, F.lit(False))
    # one pass over the results; totals and ranks read the counts per latency
    counted = settled(results.groupBy("latencyMs").agg(_count("_n"), F.count(F.when(wrong, 1)).alias("_wrong")))
    zero = F.lit(0).cast("long")
    totals = counted.agg(F.coalesce(F.sum("_n"), zero).alias("requests"), F.coalesce(F.sum("_wrong"), zero).alias("errors"))
    totals = totals.withColumn("error_rate", F.col("errors") / F.greatest(F.col("requests"), F.lit(1)))
    return totals.join(F.broadcast(ranks(counted.filter("latencyMs is not null"), "latencyMs", {"p95": share}, limit)))


def status_classes(results: DataFrame, code: str = "statusCode") -> DataFrame:
    return results.groupBy(status_class(code).alias("status_class")).agg(_count("n"))


# Verdict limits of a load run (failure share, milliseconds).
MAX_FAILED_SHARE, MAX_P95_MS, MAX_P99_MS = 0.15, 3500, 5000


def trend_stats(results: DataFrame, limit: int | None = None) -> DataFrame:
    """avg/min/med/p90/p95/p99/max of latency (exact, interpolated between neighbours) and the verdicts.

    Interpolated percentiles need the two values around position `(n - 1) * p`; both come from the same
    counted scan as `nearest_rank`.
    """
    kept = results.filter(F.col("latencyMs").isNotNull())
    failed = F.coalesce((F.col("statusCode") < 200) | (F.col("statusCode") >= 400), F.lit(True))
    counted = settled(kept.groupBy("latencyMs").agg(_count("_n"), F.count(F.when(failed, 1)).alias("_failed")))
    total = counted.agg(F.sum("_n")).first()[0] or 0
    ranked = prefix(counted, [], ["latencyMs"], [Running("_upto", "sum", F.col("_n"), inclusive=True)], limit=limit)

    def at(position: int) -> Column:
        inside = (F.col("_upto") > position) & (F.col("_upto") - F.col("_n") <= position)
        return F.max(F.when(inside, F.col("latencyMs"))).cast("double")

    picks = {}
    for name, share in (("med", 0.5), ("p90", 0.9), ("p95", 0.95), ("p99", 0.99)):
        place = max(total - 1, 0) * share
        low = int(place)
        part = place - low
        picks[name] = at(low) if part == 0 else at(low) + (at(min(low + 1, max(total - 1, 0))) - at(low)) * part
    stats = ranked.agg(
        (F.sum(F.col("latencyMs") * F.col("_n")) / F.sum("_n")).alias("avg"),
        F.min("latencyMs").alias("min"),
        F.max("latencyMs").alias("max"),
        (F.sum("_failed") / F.sum("_n")).alias("failed_share"),
        *(c.alias(name) for name, c in picks.items()),
    )
    return stats.withColumns(
        {
            "failed_ok": F.col("failed_share") < MAX_FAILED_SHARE,
            "latency_ok": (F.col("p95") < MAX_P95_MS) & (F.col("p99") < MAX_P99_MS),
        }
    )


def attempt_number(df: DataFrame, id_col: str, ts: str, limit: int | None = None) -> DataFrame:
    """Number the attempts of each id by time, from 1."""
    return numbered(df, [id_col], [ts], "attempt", limit=limit)


def top_k(df: DataFrame, value: str, k: int, partition: list[str] | None = None, tie: list[str] | None = None) -> DataFrame:
    """The `k` rows with the greatest value, overall or per partition; ties by the `tie` columns."""
    tie = tie or [c for c in df.columns if c != value]
    best = [F.col(value).desc(), *tie]
    return first_rows(df, partition, best, k) if partition else df.orderBy(*best).limit(k)
