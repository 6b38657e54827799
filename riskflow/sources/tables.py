"""Append-only tables as Parquet folders that several writers share and that survive repeated and lost batches.

Rows live under `day=D/writer=W/batch_id=N`. A writer is a stream with its checkpoint; writing one of its batches again
replaces that batch only, so a task or a whole batch may be repeated. A reader that works on batch N of a writer leaves
out that writer's batches from N on, and reads all batches of other writers. Readers open only the days in reach.
Compacted rows keep the writer and batch they came from; a batch that is repeated after compaction leaves a note under `_replaced`,
and readers pass over its compacted rows.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import dataclass
from datetime import date, datetime, timezone

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import schemas
from ..session import settled, shared_folder

PLACE = ("day", "writer", "batch_id")
COMPACTED = "compacted"
ORIGIN = ("_from_writer", "_from_batch")
REPLACED = "_replaced"
_NO_DAY = "__HIVE_DEFAULT_PARTITION__"


@dataclass(frozen=True)
class Batch:
    """One batch of one writer."""

    writer: str
    number: int


def _hadoop(spark: SparkSession, path: str):
    jvm = spark._jvm
    place = jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()), place


@contextmanager
def staged(*parts: DataFrame) -> Iterator[DataFrame]:
    """The rows of `parts`, made one after another, as files of their own in the shared folder, for as long as several outputs read them: no
    executor's memory holds them, a reader of few columns opens only these, and a lost executor loses nothing."""
    df, spark = parts[0], parts[0].sparkSession
    folder = f"{shared_folder(spark)}/staged/{uuid.uuid4()}"
    # files have no columns without a type
    untyped = [f.name for f in df.schema if isinstance(f.dataType, T.NullType)]
    try:
        for part in parts:
            part.drop(*untyped).write.mode("append").option("compression", "zstd").parquet(folder)
        held = spark.read.schema(df.drop(*untyped).schema).parquet(folder)
        yield held.select(*(F.lit(None).alias(c) if c in untyped else c for c in df.columns))
    finally:
        fs, place = _hadoop(spark, folder)
        fs.delete(place, True)


def writer_of(spark: SparkSession, checkpoint: str) -> str:
    """The name of the stream that has this checkpoint, kept inside it: a new checkpoint is a new writer."""
    fs, place = _hadoop(spark, f"{checkpoint}/writer-name")
    if fs.exists(place):
        return fs.listStatus(place)[0].getPath().getName()
    name = uuid.uuid4().hex[:12]
    fs.mkdirs(place.suffix(f"/{name}"))
    return name


def batch_time(spark: SparkSession, checkpoint: str, number: int) -> datetime:
    """When a batch was first tried, kept in its checkpoint: a repeated batch gives its rows the same time."""
    fs, place = _hadoop(spark, f"{checkpoint}/batch-times/{number}")
    if fs.exists(place):
        micros = int(fs.listStatus(place)[0].getPath().getName())
        return datetime.fromtimestamp(micros // 1_000_000, timezone.utc).replace(microsecond=micros % 1_000_000)
    now = datetime.now(timezone.utc)
    fs.mkdirs(place.suffix(f"/{int(now.timestamp()) * 1_000_000 + now.microsecond}"))
    # a stream never goes back by more than a few batches
    fs.delete(_hadoop(spark, f"{checkpoint}/batch-times/{number - 100}")[1], True)
    return now


def _with_partitions(schema: T.StructType) -> T.StructType:
    place = [T.StructField("day", T.DateType()), T.StructField("writer", T.StringType()), T.StructField("batch_id", T.LongType())]
    return T.StructType([*schema.fields, *place])


def _with_origin(schema: T.StructType) -> T.StructType:
    """The columns of stored files: compacted ones have two more, which are null elsewhere."""
    return T.StructType([*schema.fields, T.StructField(ORIGIN[0], T.StringType()), T.StructField(ORIGIN[1], T.LongType())])


def _days(spark: SparkSession, path: str, first: date | None, last: date | None) -> list[str]:
    """Folders of the days in a range (rows without a day always count); one listing of the top folder."""
    fs, place = _hadoop(spark, path)
    if not fs.exists(place):
        return []
    names = [s.getPath().getName() for s in fs.listStatus(place) if s.isDirectory() and s.getPath().getName().startswith("day=")]
    low, high = (d.isoformat() if d else None for d in (first, last))
    kept = [n for n in names if n == f"day={_NO_DAY}" or ((low is None or n[4:] >= low) and (high is None or n[4:] <= high))]
    return sorted(f"{path}/{n}" for n in kept)


def read_table(
    spark: SparkSession, path: str, schema: T.StructType, before: Batch | None = None, first: date | None = None,
    last: date | None = None,
) -> DataFrame:
    """Rows of the days from `first` to `last`, without batches of the reader's own writer from its own batch on."""
    return _read(spark, path, schema, before, first, last).drop(*ORIGIN)


def _read(
    spark: SparkSession, path: str, schema: T.StructType, before: Batch | None = None, first: date | None = None,
    last: date | None = None,
) -> DataFrame:
    days, stored = _days(spark, path, first, last), _with_partitions(_with_origin(schema))
    if not days:
        return spark.createDataFrame([], stored)
    table = spark.read.schema(stored).option("basePath", path).parquet(*days)
    writer, number = F.coalesce(ORIGIN[0], "writer"), F.coalesce(ORIGIN[1], "batch_id")
    fs, notes = _hadoop(spark, f"{path}/{REPLACED}")
    if fs.exists(notes):
        again = [status.getPath().getName() for status in fs.listStatus(notes)]
        table = table.filter(F.col(ORIGIN[0]).isNull() | ~F.concat_ws("-", *ORIGIN).isin(again))
    if before is None:
        return table
    return table.filter((writer != before.writer) | (number < before.number))


def put_batch(df: DataFrame, path: str, batch: Batch, day: Column | None, codec: str | None = None) -> None:
    """Write a batch, replacing an earlier attempt at the same batch, on whatever days that had rows."""
    placed = df.withColumns({
        "day": F.lit(None).cast("date") if day is None else F.to_date(day), "writer": F.lit(batch.writer), "batch_id": F.lit(batch.number).cast("long"),
    })
    fs, pattern = _hadoop(df.sparkSession, f"{path}/day=*/writer={batch.writer}/batch_id={batch.number}")
    for status in fs.globStatus(pattern) or []:
        fs.delete(status.getPath(), True)
    if fs.globStatus(_hadoop(df.sparkSession, f"{path}/day=*/writer={COMPACTED}")[1]):
        fs.mkdirs(_hadoop(df.sparkSession, f"{path}/{REPLACED}/{batch.writer}-{batch.number}")[1])
    writer = placed.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
    if codec:
        writer = writer.option("compression", codec)
    writer.partitionBy(*PLACE).parquet(path)


def append_transactions(df: DataFrame, path: str, batch: Batch) -> None:
    names = [f.name for f in schemas.TRANSACTION.fields]
    put_batch(df.select(*names), path, batch, F.col("created_at"))


def stored_ids(df: DataFrame, stored: DataFrame, column: str) -> DataFrame:
    """Those ids of the batch that are stored, on whatever day: only the id column of the table is read."""
    return stored.select(column).join(df.select(column).distinct(), column, "left_semi").distinct()


def history_ids(spark: SparkSession, path: str):
    """The index of the transaction ids of a history, beside it. A history that was written without one gets it now."""
    from .ids import IdIndex

    index = IdIndex(spark, f"{path}-ids")
    if not index.exists() and _days(spark, path, None, None):
        # one part for each writer and batch, as if the batches had come in with it
        rows = _read(spark, path, schemas.HISTORY).select(
            F.col("transaction_id").alias("id"), F.coalesce(ORIGIN[0], "writer").alias("by_writer"), F.coalesce(ORIGIN[1], "batch_id").alias("by_batch")
        )
        index.load(rows.where("id is not null"))
    return index


def append_history(df: DataFrame, path: str, batch: Batch) -> None:
    """History rows whose transaction id is not stored yet; their ids go to the index first, so that no other writer takes one."""
    names = [f.name for f in schemas.HISTORY.fields]
    rows = _first_of_transaction(df.select(*names))
    index = history_ids(df.sparkSession, path)
    known = index.stored(rows.select(F.col("transaction_id").alias("id")), batch)
    put_new_history(rows.join(known.withColumnRenamed("id", "transaction_id"), "transaction_id", "left_anti").select(*names), path, batch)


def _first_of_transaction(rows: DataFrame) -> DataFrame:
    from ..operators.ordered import first_arrival

    return first_arrival(rows, ["transaction_id"], "seq")


def put_new_history(rows: DataFrame, path: str, batch: Batch) -> None:
    """History rows of transactions that are known to be new, one each."""
    index = history_ids(rows.sparkSession, path)
    index.put(rows.select(F.col("transaction_id").alias("id")), batch)
    put_batch(rows.select(*(f.name for f in schemas.HISTORY.fields)), path, batch, F.col("occurred_at"))


def append_markers(df: DataFrame, path: str, batch: Batch, at: Column) -> None:
    """Markers of processed events, by the day on which they were processed."""
    put_batch(df.select("event_id", at.alias("processed_at")), path, batch, at)


def append_alerts(df: DataFrame, path: str, batch: Batch) -> None:
    names = [f.name for f in schemas.ALERT.fields]
    put_batch(df.select(*names), path, batch, F.col("created_at"))


def read_alerts(spark: SparkSession, path: str, t0=None, t1=None) -> DataFrame:
    """Stored alerts; with a time range (both ends included) only the days it touches are read."""
    from ..operators.alerts import in_range

    table = read_table(spark, path, schemas.ALERT)
    if t0 is not None:
        table = table.filter(F.col("day") >= F.to_date(F.lit(t0)))
    if t1 is not None:
        table = table.filter(F.col("day") <= F.to_date(F.lit(t1)))
    return in_range(table, "created_at", t0, t1).drop(*PLACE)


def expire_table(spark: SparkSession, path: str, schema: T.StructType, ts: str, cutoff, target: str) -> None:
    """Write the rows not older than the cutoff to a new folder; whole days before it are not read. Rows without a time stay."""
    kept = read_table(spark, path, schema).filter(
        F.coalesce(F.col("day") >= F.to_date(F.lit(cutoff)), F.lit(True)) & F.coalesce(F.col(ts) >= F.lit(cutoff), F.lit(True))
    )
    kept.write.mode("overwrite").partitionBy(*PLACE).parquet(target)


def expire_days(spark: SparkSession, path: str, schema: T.StructType, ts: str, cutoff: datetime) -> None:
    """
    Drop the rows older than the cutoff in place: folders of whole days before it go unread, and of the cutoff's own day only the
    batches that have such rows are written again, each replaced on its own. Rows without a day or a time stay.

    A stream may go on meanwhile: its own newest batch of that day is left for the next time.
    """
    day = cutoff.astimezone(timezone.utc).date()
    for folder in _days(spark, path, None, None):
        name = folder.rsplit("day=", 1)[1]
        if name != _NO_DAY and name < day.isoformat():
            fs, place = _hadoop(spark, folder)
            fs.delete(place, True)
    rows = _read(spark, path, schema, first=day, last=day).filter(F.col("day") == F.lit(day))
    newest = read_table(spark, path, schema).groupBy("writer").agg(F.max("batch_id").alias("newest"))
    old = rows.filter(F.col(ts) < F.lit(cutoff)).select("writer", "batch_id").distinct().join(F.broadcast(newest), "writer")
    # as many as the batches of a day
    touched = [Batch(r.writer, r.batch_id) for r in old.filter((F.col("writer") == COMPACTED) | (F.col("batch_id") < F.col("newest"))).collect()]
    for batch in touched:
        own = rows.filter((F.col("writer") == batch.writer) & (F.col("batch_id") == batch.number) & F.coalesce(F.col(ts) >= F.lit(cutoff), F.lit(True)))
        kept = settled(own)
        fs, place = _hadoop(spark, f"{path}/day={day.isoformat()}/writer={batch.writer}/batch_id={batch.number}")
        if kept.isEmpty():
            fs.delete(place, True)
        else:
            kept.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*PLACE).parquet(path)


#: Rows of a day that compaction gives to one task.
ROWS_PER_FILE = 1_000_000


def compact_table(spark: SparkSession, path: str, schema: T.StructType, closed_before: date, target: str) -> None:
    """A copy of a table in which the many small batches of each closed day are one; open days keep their batches. A stream that goes on with
    the copy can still repeat its last batch, wherever its rows lie."""
    rows, closed = _read(spark, path, schema), F.col("day") < F.lit(closed_before)
    moved = closed & (F.col("writer") != COMPACTED)
    merged = rows.withColumns({
        ORIGIN[0]: F.when(moved, F.col("writer")).otherwise(F.col(ORIGIN[0])), ORIGIN[1]: F.when(moved, F.col("batch_id")).otherwise(F.col(ORIGIN[1])),
        "writer": F.when(closed, COMPACTED).otherwise(F.col("writer")), "batch_id": F.when(closed, 0).otherwise(F.col("batch_id")),
    })
    # rows of one day may be many, so a day is dealt out by its size and not sent to one task
    sizes = merged.groupBy("day").agg(F.ceil(F.count(F.lit(1)) / ROWS_PER_FILE).cast("long").alias("_files")).withColumnRenamed("day", "_day")
    dealt = merged.join(F.broadcast(sizes), F.col("day").eqNullSafe(F.col("_day")))
    names = [f.name for f in schema.fields]
    dealt = dealt.withColumn("_file", F.pmod(F.xxhash64(*names), F.col("_files")))
    dealt.repartition("day", "_file").select(*names, *ORIGIN, *PLACE).write.mode("overwrite").partitionBy(*PLACE).parquet(target)
