"""What a user did before: counts in a trailing window and the latest earlier row.

The trailing count is a sweep. Each row opens at its own time and closes one window later, and the
count for a row is the number of rows open when it arrives. One sort per user gives both the count and
the latest row, in time linear in the rows even when a user has millions of rows inside one window
(a sliding RANGE frame re-aggregates its whole buffer for every row).
"""

from __future__ import annotations

from collections.abc import Sequence
from datetime import timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ordered import Running, prefix

_BEFORE_ALL = -(1 << 62)


def micros(width: timedelta) -> int:
    return (width.days * 86_400 + width.seconds) * 1_000_000 + width.microseconds


def _sweep(
    df: DataFrame, key: str, us: Column, seq: str, width: timedelta, count: str, extra: Sequence[Running],
    stored: Column | None = None, limit: int | None = None,
) -> DataFrame:
    """One row in, the same row out, with `count` and the running values in `extra`.

    Rows where `stored` is true arrived before all others, so they are open from the start.
    """
    opens = us if stored is None else F.when(stored, F.lit(_BEFORE_ALL)).otherwise(us)
    # a close sorts ahead of an open at the same instant: the lower bound of the window is strict
    edges = F.explode(
        F.array(
            F.struct(opens.alias("at"), F.lit(1).alias("step")),
            F.struct((us + F.lit(micros(width))).alias("at"), F.lit(-1).alias("step")),
        )
    )
    kept = [c for c in df.columns if c not in (key, seq)]
    swept = df.withColumn("_edge", edges).select(
        key,
        seq,
        F.col("_edge.at").alias("_at"),
        F.col("_edge.step").alias("_step"),
        # closing edges carry no payload through the shuffle
        *(F.when(F.col("_edge.step") > 0, F.col(c)).alias(c) for c in kept),
    )
    running = [Running(count, "sum", F.col("_step").cast("long")), *extra]
    done = prefix(swept, [key], ["_at", "_step", seq], running, limit=limit)
    return (
        done.filter(F.col("_step") > 0)
        .withColumn(count, F.coalesce(F.col(count), F.lit(0).cast("long")))
        .select(*df.columns, count, *(e.name for e in extra))
    )


def _latest(ts: str, seq: str, cols: Sequence[str]) -> Running:
    row = F.struct(F.col(ts).alias("_ts"), F.col(seq).alias("_seq"), F.struct(*cols).alias("_row"))
    return Running("_latest", "max", F.when(F.col("_step") > 0, row))


def trailing_count(
    df: DataFrame, key: str, ts: str, seq: str, width: timedelta, out: str = "n", limit: int | None = None
) -> DataFrame:
    """Rows of the same key in `(ts - width, ts]` that come earlier in `(ts, seq)` order."""
    return _sweep(df, key, F.unix_micros(F.col(ts)), seq, width, out, [], limit=limit)


def velocity_count(
    df: DataFrame, user: str = "user_id", ts: str = "occurred_at", seq: str = "seq",
    window: timedelta = timedelta(minutes=1), out: str = "prior_count", limit: int | None = None,
) -> DataFrame:
    """Earlier transactions of the user inside the trailing window; the row itself is not counted."""
    return trailing_count(df, user, ts, seq, window, out, limit)


def last_transaction(
    df: DataFrame, user: str = "user_id", ts: str = "occurred_at", seq: str = "seq",
    cols: Sequence[str] = ("country", "occurred_at"), out: str = "prev", limit: int | None = None,
) -> DataFrame:
    """The user's latest earlier transaction (ties: latest arrival), as `<out>_<col>`."""
    row = F.struct(*cols)
    done = prefix(df, [user], [ts, seq], [Running("_latest", "last", row)], limit=limit)
    return done.withColumns({f"{out}_{c}": F.col("_latest")[c] for c in cols}).drop("_latest")


def with_history(
    df: DataFrame, window: timedelta, user: str = "user_id", ts: str = "occurred_at", seq: str = "seq",
    stored: str | None = None, limit: int | None = None,
) -> DataFrame:
    """Count and latest row together, in one shuffle: adds prior_count, prev_country and prev_occurred_at.

    `stored` names a boolean column that marks rows which arrived before all others. They count whatever
    their time is, so a late event sees history that lies after it.
    """
    done = _sweep(
        df, user, F.unix_micros(F.col(ts)), seq, window, "prior_count", [_latest(ts, seq, ["country"])],
        F.col(stored) if stored else None, limit,
    )
    return done.withColumns(
        {"prev_country": F.col("_latest._row.country"), "prev_occurred_at": F.col("_latest._ts")}
    ).drop("_latest")


def against_stored(
    new: DataFrame, history: DataFrame, window: timedelta, reach: timedelta, limit: int | None = None
) -> DataFrame:
    """`with_history` for a new batch whose users already have rows in a stored history table.

    Stored rows older than the earliest new row minus `reach` (the longest rule window) can change no
    rule. They are left out by a literal bound, which prunes files and partitions.
    """
    earliest = earliest_us(new, "occurred_at")
    cols = ["user_id", "occurred_at", "seq", "country"]
    if earliest is None:
        recent = history.select(*cols).limit(0)
    else:
        recent = after(history, "occurred_at", earliest - micros(reach)).select(*cols)
        # rows of users that the batch doesn't have can change nothing, and are not sorted
        recent = recent.join(new.select("user_id").distinct(), "user_id", "left_semi").select(*cols)
    both = new.withColumn("_stored", F.lit(False)).unionByName(
        recent.withColumn("_stored", F.lit(True)), allowMissingColumns=True
    )
    done = with_history(both, window, stored="_stored", limit=limit)
    return done.filter(~F.col("_stored")).drop("_stored")


def earliest_us(df: DataFrame, ts: str) -> int | None:
    """The smallest time as microseconds, which no time zone of the driver can shift."""
    return df.agg(F.min(F.unix_micros(F.col(ts)))).first()[0]


def after(stored: DataFrame, ts: str, us: int) -> DataFrame:
    """Rows later than an instant; of a table kept by day only the days it can lie in are read."""
    bound = F.timestamp_micros(F.lit(us))
    kept = stored.filter(F.col(ts) > bound)
    return kept.filter(F.col("day") >= F.to_date(bound)) if "day" in stored.columns else kept


def expire(df: DataFrame, ts: str, cutoff) -> DataFrame:
    """Drop rows older than the cutoff (history and processed markers alike)."""
    return df.filter(F.col(ts) >= cutoff)
