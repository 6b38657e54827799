"""Ordered per-key scans that stay parallel when one key holds a large part of all rows.

A plain window sends every row of a key to one task. `prefix` does the same while no key is larger
than `rows_per_task`; a larger key is cut along the sort order into chunks of about that size. Each
chunk is scanned by its own task, and one row per chunk carries what came before it. Everything that
is broadcast or collected (the cut points and the chunk totals) is bounded by MAX_CHUNKS, whatever
the size of the data, because the chunk size grows once the oversized keys together pass MAX_CHUNKS * rows_per_task.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import rows_per_task

MAX_CHUNKS = 16_384
_SAMPLES_PER_CUT = 16
_GROUP_LIMIT = "spark.sql.optimizer.windowGroupLimitThreshold"
_SIZE_SAMPLES = 2_000  # sampled rows that stand for one full chunk when key sizes are estimated


@dataclass(frozen=True)
class Running:
    """One running value: `kind` is sum, max, min or last (latest non-null) over the rows before."""

    name: str
    kind: str
    value: Column
    inclusive: bool = False


_WINDOWED = {
    "sum": F.sum,
    "max": F.max,
    "min": F.min,
    "last": lambda c: F.last(c, ignorenulls=True),
}


def _combined(kind: str, local: Column, carried: Column) -> Column:
    if kind == "sum":
        return F.when(local.isNull() & carried.isNull(), F.lit(None)).otherwise(
            F.coalesce(local, F.lit(0)) + F.coalesce(carried, F.lit(0))
        )
    if kind == "last":
        return F.coalesce(local, carried)
    # greatest/least do not take structs, so compare explicitly
    better = local > carried if kind == "max" else local < carried
    return F.when(carried.isNull() | better, local).otherwise(carried)


def cut_points(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], limit: int | None = None
) -> DataFrame | None:
    """Where to cut each oversized key along `order`; None when no key is oversized.

    As in range partitioning, samples decide only *which* keys are cut and *where*. Every row is kept, and
    any choice of cuts gives the same result. What is collected is bounded by MAX_CHUNKS.
    """
    spark = df.sparkSession
    limit = limit or rows_per_task(spark)
    share = min(1.0, _SIZE_SAMPLES / limit)
    seen = df.select(*keys) if share == 1.0 else df.select(*keys).sample(share, seed=0)
    sizes = seen.groupBy(*keys).agg((F.count(F.lit(1)) / F.lit(share)).alias("_rows"))
    # only keys that are cut count: a long table of small keys must not raise the limit
    crowded, largest = sizes.agg(F.sum(F.when(F.col("_rows") > limit, F.col("_rows"))), F.max("_rows")).first()
    if largest is None or largest <= limit:
        return None
    limit = max(limit, -(-crowded // MAX_CHUNKS))
    found = sizes.filter(F.col("_rows") > limit).select(
        *(F.col(k).alias(f"_h_{k}") for k in keys), "_rows", F.ceil(F.col("_rows") / F.lit(limit)).alias("_chunks")
    )
    hot = spark.createDataFrame(found.collect(), found.schema)  # at most crowded / limit <= MAX_CHUNKS keys
    marked = df.select(*keys, F.struct(*order).alias("_at")).join(
        F.broadcast(hot), _same([F.col(k) for k in keys], [F.col(f"_h_{k}") for k in keys])
    )
    picked = marked.filter(F.rand(seed=0) < F.col("_chunks") * _SAMPLES_PER_CUT / F.col("_rows"))
    sampled = picked.groupBy(*keys).agg(
        F.max("_chunks").alias("_chunks"), F.sort_array(F.collect_set("_at")).alias("_found")
    )
    wanted = F.least(F.col("_chunks"), F.size("_found"))
    cuts = F.transform(
        F.sequence(F.lit(1), F.greatest(wanted - 1, F.lit(1))),
        lambda i: F.element_at("_found", F.greatest(F.lit(1), (i * F.size("_found") / wanted).cast("int"))),
    )
    table = sampled.select(*(F.col(k).alias(f"_k_{k}") for k in keys), F.array_distinct(cuts).alias("_cuts"))
    return spark.createDataFrame(table.collect(), table.schema)


def _same(left: Sequence[Column], right: Sequence[Column]) -> Column:
    condition = F.lit(True)
    for a, b in zip(left, right):
        condition = condition & a.eqNullSafe(b)
    return condition


def with_chunk(df: DataFrame, keys: Sequence[str], order: Sequence[str], cuts: DataFrame) -> DataFrame:
    """Add `_chunk` (0 for keys that were not cut) by binary search in the key's cut points."""
    found = df.join(F.broadcast(cuts), _same([F.col(k) for k in keys], [F.col(f"_k_{k}") for k in keys]), "left")
    here = F.struct(*order)
    # the cuts lie on the driver; as many steps as the longest list of them takes, which is few unless a key is enormous
    longest = cuts.agg(F.max(F.size("_cuts"))).first()[0] or 1
    steps = F.array(*(F.lit(1 << p) for p in range(longest.bit_length() - 1, -1, -1)))
    position = F.aggregate(
        steps,
        F.lit(0),
        lambda at, step: F.when(
            (at + step <= F.size("_cuts")) & (F.get("_cuts", at + step - 1) < here), at + step
        ).otherwise(at),
    )
    chunk = F.when(F.col("_cuts").isNull(), F.lit(0)).otherwise(position)
    return found.withColumn("_chunk", chunk).drop("_cuts", *(f"_k_{k}" for k in keys))


def prefix(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    values: Sequence[Running],
    limit: int | None = None,
    bound: int | None = None,
) -> DataFrame:
    """Add running values over the rows of the same key that come earlier in `order`.

    `order` must be a total order within a key (end it with a unique column). `bound` is a proven
    upper limit of rows per key; when it is within `limit` the size check is skipped.
    """
    limit = limit or rows_per_task(df.sparkSession)
    if not keys:
        split = prefix(df.withColumn("_all", F.lit(0)), ["_all"], order, values, limit, bound)
        return split.drop("_all")
    cuts = None if bound is not None and bound <= limit else cut_points(df, keys, order, limit)
    partition = list(keys)
    if cuts is not None:
        df = with_chunk(df, keys, order, cuts)
        partition.append("_chunk")
    ordered = Window.partitionBy(*partition).orderBy(*order)
    before = ordered.rowsBetween(Window.unboundedPreceding, -1)
    upto = ordered.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    local = {v.name: _WINDOWED[v.kind](v.value).over(upto if v.inclusive else before) for v in values}
    if cuts is None:
        return df.withColumns(local)

    at = F.struct(*order)
    totals = [
        (F.max_by(v.value, F.when(v.value.isNotNull(), at)) if v.kind == "last" else _WINDOWED[v.kind](v.value)).alias(v.name)
        for v in values
    ]
    split_keys = F.broadcast(cuts.select(*(f"_k_{k}" for k in keys)))
    per_chunk = (
        df.join(split_keys, _same([F.col(k) for k in keys], [F.col(f"_k_{k}") for k in keys]), "left_semi")
        .groupBy(*partition)
        .agg(*totals)
    )
    earlier = Window.partitionBy(*keys).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    carry = per_chunk.select(
        *(F.col(k).alias(f"_k_{k}") for k in partition),
        *(_WINDOWED[v.kind](F.col(v.name)).over(earlier).alias(f"_c_{v.name}") for v in values),
    )
    joined = df.withColumns(local).join(
        F.broadcast(carry), _same([F.col(k) for k in partition], [F.col(f"_k_{k}") for k in partition]), "left"
    )
    return joined.withColumns(
        {v.name: _combined(v.kind, F.col(v.name), F.col(f"_c_{v.name}")) for v in values}
    ).drop("_chunk", *(f"_k_{k}" for k in partition), *(f"_c_{v.name}" for v in values))


def numbered(df: DataFrame, keys: Sequence[str], order: Sequence[str], out: str = "n", **kw) -> DataFrame:
    """`row_number` within the key."""
    return prefix(df, keys, order, [Running(out, "sum", F.lit(1).cast("long"), inclusive=True)], **kw)


def previous_row(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], cols: Sequence[str], out: str = "prev", **kw
) -> DataFrame:
    """The columns `cols` of the row just before, as `<out>_<col>`."""
    done = prefix(df, keys, order, [Running("_prev", "last", F.struct(*cols))], **kw)
    return done.withColumns({f"{out}_{c}": F.col("_prev")[c] for c in cols}).drop("_prev")


def latest_arrived(
    df: DataFrame, keys: Sequence[str], ts: str, seq: str, cols: Sequence[str], out: str = "prev", **kw
) -> DataFrame:
    """Among rows that arrived earlier (smaller `seq`), the columns of the one with the greatest `ts`."""
    best = F.struct(F.col(ts).alias("_ts"), F.col(seq).alias("_seq"), F.struct(*cols).alias("_row"))
    done = prefix(df, keys, [seq], [Running("_best", "max", best)], **kw)
    return done.withColumns({f"{out}_{c}": F.col("_best")["_row"][c] for c in cols}).drop("_best")


def first_arrival(df: DataFrame, ids: Sequence[str], seq: str) -> DataFrame:
    """Keep the first row per id (a row without `seq` comes first). Aggregated before the shuffle, so many copies of one id are harmless."""
    rest = [c for c in df.columns if c not in ids]
    first = df.groupBy(*ids).agg(F.min_by(F.struct(*rest), F.struct(seq)).alias("_first"))
    return first.select(*(F.col(c) if c in ids else F.col("_first")[c].alias(c) for c in df.columns))


def latest_per_key(df: DataFrame, keys: Sequence[str], ts: str, seq: str) -> DataFrame:
    """Keep the row with the greatest `(ts, seq)` per key."""
    rest = [c for c in df.columns if c not in keys]
    last = df.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(ts, seq)).alias("_last"))
    return last.select(*(F.col(c) if c in keys else F.col("_last")[c].alias(c) for c in df.columns))


def first_rows(df: DataFrame, keys: Sequence[str], order: Sequence[Column | str], n: int) -> DataFrame:
    """The first `n` rows per key. Spark limits every key to `n` rows in each task before the shuffle, so a
    key of any size reaches its task as a few rows; the setting up to which it does so is raised to `n`."""
    spark = df.sparkSession
    if int(spark.conf.get(_GROUP_LIMIT)) < n:
        spark.conf.set(_GROUP_LIMIT, str(n))
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("_n", place).filter(F.col("_n") <= n).drop("_n")


def last_samples(df: DataFrame, keys: Sequence[str], ts: str, n: int) -> DataFrame:
    """The newest `n` rows per key."""
    return first_rows(df, keys, [F.col(ts).desc()], n)
