"""An index of the ids of a stored table: which of a batch's ids are stored, without reading the table.

Ids are dealt to buckets by a hash. Each batch adds, per bucket, one folder with its ids and one with a Bloom filter over them
(`BITS` bits an id). A look-up opens only the buckets its ids fall into, tests the ids against the filters there, and reads the ids of those
folders that may hold one; what it says is exact, a filter only saves reading. `compact` puts the folders of a bucket together and doubles the
number of buckets until one holds `FULL` ids at most, so what a batch reads is bounded by its own ids, not by the history.

Layout: `gen=G-B` for B buckets, with `ids/bucket=b/part=P` and `filters/bucket=b/part=P`; the generation with the highest G that has a
`ready` folder counts. A batch written again replaces its own parts. A reader leaves out its own writer's batches from its own on, also
where they are in a compacted part, since every id keeps its writer and batch.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import settled
from . import tables
from .tables import Batch

BUCKETS = 16
#: Ids of one bucket after compaction, at most; bits a filter has for each; tests of one id.
FULL, BITS, TESTS = 1 << 16, 24, 8
#: Folders opened one by one; with more of them, whole buckets are read.
FOLDERS = 4096
IDS = "id string, by_writer string, by_batch long, bucket int, part string"
FILTERS = "bits array<long>, bucket int, part string"


def _bit(id_: Column, test: int, size: Column) -> Column:
    """Which of the `size` bits of a filter a test of an id looks at."""
    return F.pmod(F.xxhash64(id_, F.lit(test)), size)


def _held(id_: Column, bits: Column) -> Column:
    """Whether a filter may hold an id."""
    size = F.size(bits).cast("long") * 64
    tests = None
    for test in range(TESTS):
        at = _bit(id_, test, size)
        word = F.element_at(bits, F.shiftright(at, 6).cast("int") + 1)
        one = word.bitwiseAND(F.call_function("shiftleft", F.lit(1).cast("long"), (at % 64).cast("int"))) != 0
        tests = one if tests is None else tests & one
    return tests


def _filled(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The words of each filter, set in place: a task holds `BITS` bits for each of its ids and sends no word anywhere."""
    held: dict[tuple, np.ndarray] = {}
    for frame in frames:
        for (bucket, part, words), rows in frame.groupby(["bucket", "part", "words"], sort=False):
            bits = held.setdefault((bucket, part), np.zeros(words, np.uint64))
            at = rows[[f"at{t}" for t in range(TESTS)]].to_numpy(np.uint64).reshape(-1)
            np.bitwise_or.at(bits, (at >> np.uint64(6)).astype(np.int64), np.uint64(1) << (at & np.uint64(63)))
    for (bucket, part), bits in held.items():
        yield pd.DataFrame({"bits": [bits.view(np.int64)], "bucket": [bucket], "part": [part]})


def filters(ids: DataFrame) -> DataFrame:
    """(bits, bucket, part): a Bloom filter per bucket and part of (id, bucket, part). To be dealt by bucket and part before; ids of one
    part in several tasks make several filters of it, which find the same."""
    sizes = ids.groupBy("bucket", "part").agg(F.greatest(F.lit(1), F.ceil(F.count(F.lit(1)) * BITS / 64)).cast("long").alias("words"))
    tested = ids.join(F.broadcast(sizes), ["bucket", "part"])
    return tested.select("bucket", "part", "words", *(_bit(F.col("id"), t, F.col("words") * 64).alias(f"at{t}") for t in range(TESTS))).mapInPandas(_filled, FILTERS)


@dataclass(frozen=True)
class IdIndex:
    """The index at a path."""

    spark: SparkSession
    path: str

    def _fs(self, path: str):
        return tables._hadoop(self.spark, path)

    def _generation(self) -> tuple[int, int]:
        """(number, buckets) of the generation that counts; (0, BUCKETS) if there is none yet."""
        fs, root = self._fs(self.path)
        found = [(0, BUCKETS)]
        if fs.exists(root):
            for status in fs.listStatus(root):
                name = status.getPath().getName()
                if name.startswith("gen=") and fs.exists(status.getPath().suffix("/ready")):
                    number, buckets = name[4:].split("-")
                    found.append((int(number), int(buckets)))
        return max(found)

    def exists(self) -> bool:
        return self._generation()[0] > 0

    def _folder(self, generation: tuple[int, int]) -> str:
        return f"{self.path}/gen={generation[0]}-{generation[1]}"

    def _read(self, folder: str, kind: str, schema: str) -> DataFrame:
        fs, place = self._fs(f"{folder}/{kind}")
        if not fs.exists(place):
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(f"{folder}/{kind}")

    def _write(self, ids: DataFrame, folder: str) -> None:
        """Write (id, by_writer, by_batch, bucket, part) with filters, replacing the parts it has rows for."""
        with tables.staged(ids) as held:
            dealt = held.repartition("bucket", "part")
            for kind, rows in (("ids", dealt.sortWithinPartitions("bucket", "part", "id")), ("filters", filters(dealt))):
                rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket", "part").parquet(f"{folder}/{kind}")

    def _start(self) -> tuple[int, int]:
        if self.exists():
            return self._generation()
        fs, place = self._fs(f"{self._folder((1, BUCKETS))}/ready")
        fs.mkdirs(place)
        return 1, BUCKETS

    def put(self, ids: DataFrame, batch: Batch) -> None:
        """Add the ids of a batch (column `id`), replacing what an earlier attempt at it added."""
        generation = self._start()
        folder, part = self._folder(generation), f"{batch.writer}-{batch.number}"
        for kind in ("filters", "ids"):
            fs, pattern = self._fs(f"{folder}/{kind}/bucket=*/part={part}")
            for status in fs.globStatus(pattern) or []:
                fs.delete(status.getPath(), True)
        named = ids.select("id", F.lit(batch.writer).alias("by_writer"), F.lit(batch.number).cast("long").alias("by_batch")).where("id is not null")
        self._write(named.withColumns({"bucket": _bucket(F.col("id"), generation[1]), "part": F.lit(part)}), folder)

    def load(self, ids: DataFrame) -> None:
        """Begin the index with (id, by_writer, by_batch) of a table that has none."""
        part = F.concat_ws("-", "by_writer", "by_batch")
        self._write(ids.select("id", "by_writer", "by_batch", _bucket(F.col("id"), BUCKETS).alias("bucket"), part.alias("part")), self._folder((1, BUCKETS)))
        self._start()

    def candidates(self, ids: DataFrame, before: Batch | None = None) -> DataFrame:
        """(id, bucket, part) where a filter says that the part may hold the id. Parts of the reader's own batches from its own on are left out."""
        generation = self._generation()
        folder = self._folder(generation)
        if not generation[0]:
            return self.spark.createDataFrame([], "id string, bucket int, part string")
        wanted = ids.select("id").where("id is not null").distinct().withColumn("bucket", _bucket(F.col("id"), generation[1]))
        # buckets are few, and a batch of few ids needs few of them
        buckets = [r.bucket for r in wanted.select("bucket").distinct().limit(FOLDERS + 1).collect()]
        known = self._read(folder, "filters", FILTERS)
        if len(buckets) <= FOLDERS:
            known = known.where(F.col("bucket").isin(buckets))
        if before is not None:
            own = F.col("part").startswith(f"{before.writer}-")
            number = F.substring("part", len(before.writer) + 2, 20).try_cast("long")
            known = known.where(~(own & F.coalesce(number >= before.number, F.lit(False))))
        known = known.withColumnRenamed("bucket", "_bucket")
        return wanted.join(known, (F.col("bucket") == F.col("_bucket")) & _held(F.col("id"), F.col("bits"))).select("id", "bucket", "part")

    def stored(self, ids: DataFrame, before: Batch | None = None) -> DataFrame:
        """Those ids of `ids` (column `id`) that are stored, each once; without those that the reader's own batches from its own on have added."""
        folder = self._folder(self._generation())
        with tables.staged(self.candidates(ids, before)) as near:
            parts = near.select("bucket", "part").distinct().limit(FOLDERS + 1).collect()
            if not parts:
                return self.spark.createDataFrame([], "id string")
            if len(parts) <= FOLDERS:
                paths = [f"{folder}/ids/bucket={r.bucket}/part={r.part}" for r in parts]
                held = self.spark.read.schema(IDS).option("basePath", f"{folder}/ids").parquet(*paths)
            else:
                held = self._read(folder, "ids", IDS)
            if before is not None:
                held = held.where((F.col("by_writer") != before.writer) | (F.col("by_batch") < before.number))
            found = held.join(near.select("id", "bucket").distinct(), ["id", "bucket"], "left_semi").select("id").distinct()
            return settled(found)

    def compact(self) -> None:
        """Put the parts of each bucket together, in as many buckets as keep each within `FULL` ids; for times without writers."""
        number, buckets = self._generation()
        if not number:
            return
        held = self._read(self._folder((number, buckets)), "ids", IDS)
        total = held.count()
        while total > buckets * FULL:
            buckets *= 2
        folder = self._folder((number + 1, buckets))
        # a writer may still repeat its newest batch, which stays a part of its own
        newest = held.groupBy(F.col("by_writer").alias("_writer")).agg(F.max("by_batch").alias("_newest"))
        marked = held.drop("bucket", "part").join(F.broadcast(newest), F.col("by_writer") == F.col("_writer"))
        own = F.col("by_batch") == F.col("_newest")
        part = F.when(own, F.concat_ws("-", "by_writer", "by_batch")).otherwise(F.lit(tables.COMPACTED))
        self._write(marked.select("id", "by_writer", "by_batch", _bucket(F.col("id"), buckets).alias("bucket"), part.alias("part")), folder)
        fs, place = self._fs(f"{folder}/ready")
        fs.mkdirs(place)
        # readers that began with the generation before may still finish; the one before that goes
        for status in fs.listStatus(self._fs(self.path)[1]):
            name = status.getPath().getName()
            if name.startswith("gen=") and int(name[4:].split("-")[0]) < number:
                fs.delete(status.getPath(), True)


def _bucket(id_: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(id_), F.lit(buckets).cast("long")).cast("int")
