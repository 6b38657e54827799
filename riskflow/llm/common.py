"""Helpers shared by the operators: tables in the shared folder, binary files on any store, row keys, word patterns."""

from __future__ import annotations

import sys
import types
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from typing import TypeVar

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from riskflow.session import shared_folder

T = TypeVar("T")
#: Rows of one Arrow batch where rows carry whole texts: bounds what a Python worker holds at once.
TEXTS_PER_BATCH = 256


def small_batches(spark: SparkSession) -> None:
    """From here on, Arrow batches of few rows: they carry whole texts."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(TEXTS_PER_BATCH))


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    """One of the given tables, with small Arrow batches from here on: its rows carry whole texts."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def new_folder(spark: SparkSession, name: str) -> str:
    """A fresh folder path under the shared checkpoint folder."""
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """`df` written once to the shared folder and read back: cuts lineage, survives lost executors."""
    path = new_folder(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def filesystem(path: str):
    """The Arrow file system of a folder and the path within it; works where Spark's URI is file, hdfs, s3 or gs."""
    from pyarrow import fs

    if "://" not in path and not path.startswith("file:"):
        return fs.LocalFileSystem(), path
    if path.startswith("file:"):
        return fs.LocalFileSystem(), "/" + path.removeprefix("file:").lstrip("/")
    return fs.FileSystem.from_uri(path.replace("s3a://", "s3://", 1))


def packed(docs: DataFrame) -> DataFrame:
    """`row` (all columns of a table with doc_id and text, as a struct, so that no name can clash), key_id and key_hash."""
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"))
    return rows.select("row", *_keys("row.doc_id", "row.text"))


def _keys(doc_id: str, text: str) -> list[Column]:
    return [F.coalesce(F.col(doc_id).cast("long"), F.lit(-(2**63))).alias("key_id"), F.xxhash64(text).alias("key_hash")]


def keyed(docs: DataFrame) -> DataFrame:
    """`docs` with key_id and key_hash beside its own columns, which must not have these names."""
    return docs.select("*", *_keys("doc_id", "text"))


def row_keys(docs: DataFrame) -> DataFrame:
    """
    (key_id, key_hash, text): keys for joins back to rows of (doc_id, text).

    Null ids get a value of their own. Rows equal in both columns share a key, so what is joined back must have one row
    per key.
    """
    return docs.select(*_keys("doc_id", "text"), "text")


def tasks_for(spark: SparkSession, amount: int, per_task: int) -> int:
    """How many tasks share `amount` (bytes or rows) when one takes `per_task`; at least one per core."""
    return max(spark.sparkContext.defaultParallelism, -(-amount // per_task))


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z only; `lower`, which is faster, where a text has no other letters to change."""
    only_ascii = F.octet_length(text) == F.char_length(text)
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return F.when(only_ascii, F.lower(text)).otherwise(F.translate(text, upper, lower))


def held_out(doc_id: Column) -> Column:
    """Whether a document's label may not be learned from: crc32 of its id as text, modulo 5, is 0."""
    return F.crc32(F.encode(F.coalesce(doc_id.cast("string"), F.lit("")), "UTF-8")) % 5 == 0


@contextmanager
def batch_rows(spark: SparkSession, rows: int) -> Iterator[None]:
    """Arrow batches of up to `rows` rows for jobs run within: for narrow rows."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, str(rows))
    try:
        yield
    finally:
        spark.conf.set(key, before)


def batches(frames: Iterator) -> Iterator:
    """Pandas frames that have rows."""
    return (frame for frame in frames if len(frame))


def frame(rows: list, columns: list[str], longs: list[str]) -> pd.DataFrame:
    """A Pandas frame whose columns `longs` are whole numbers or null; plain Pandas would round them to floats."""
    out = pd.DataFrame(rows, columns=columns, dtype=object)
    return out.assign(**{c: pd.array(out[c], "Int64") for c in longs})


def per_worker(key: tuple, make: Callable[[], T]) -> T:
    """
    What `make` gives, made once in a Python worker and kept for its later tasks (the code itself comes anew with each task).

    One thing is kept at a time: what another operator has left in the worker goes.
    """
    kept = sys.modules.setdefault("riskflow_kept", types.ModuleType("riskflow_kept")).__dict__
    if key not in kept:
        release()
        kept[key] = make()
    return kept[key]


def release() -> None:
    """Let go of what `per_worker` keeps: for tasks that need the memory."""
    kept = sys.modules.setdefault("riskflow_kept", types.ModuleType("riskflow_kept")).__dict__
    for key in [key for key in kept if isinstance(key, tuple)]:
        del kept[key]
