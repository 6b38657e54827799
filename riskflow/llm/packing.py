"""
Documents packed into as few sequences of bounded length as best-fit decreasing gives, over the whole corpus.

Documents become token ids and an end id; only what is longer than a sequence is cut, into pieces of its length and a rest. Best-fit
decreasing takes pieces from the longest to the shortest and puts each into the open sequence with the least room that still
takes it. A segment tree over remaining capacities finds that one in logarithmic time. Lengths are whole numbers, so all
pieces of a length are placed together: while the tightest sequences take more of them, those are filled in runs, just as one by one.
The plan of the placing (`Plan`) thus depends on how many pieces have each length only; it has a few runs per length, however
many documents there are, and is made on the driver from one row per length.

A piece's place follows from the plan by its rank among the pieces of its length. Ranks come from the pieces as they are stored: their
number within the part that wrote them, and the sums of the parts before.

Null texts are empty: they are an end id alone. Rows are taken one by one, so null ids and equal rows change nothing; an empty table gives
no row. Only the columns doc_id and text are read.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from riskflow.llm import common, tiles

SIZE = 2048


class Capacities:
    """A segment tree over remaining capacities 0 to `size`: which of them open sequences have."""

    def __init__(self, size: int):
        self.leaves = 1 << size.bit_length()
        self.any = bytearray(2 * self.leaves)

    def put(self, capacity: int, present: bool) -> None:
        node = self.leaves + capacity
        self.any[node] = present
        while node > 1:
            node //= 2
            self.any[node] = self.any[2 * node] | self.any[2 * node + 1]

    def tightest(self, least: int) -> int | None:
        """The smallest capacity present that is `least` or more."""
        node = self.leaves + least
        while not self.any[node]:
            # up to where a right neighbour is left to look at
            while node & 1:
                node //= 2
            if not node:
                return None
            node += 1
        while node < self.leaves:
            node = 2 * node if self.any[2 * node] else 2 * node + 1
        return node - self.leaves


@dataclass
class Plan:
    """
    Where pieces go: run k takes the pieces of length `length[k]` from rank `rank[k]` on, `each[k]` to a sequence, from sequence
    `first[k]` on, at offset `base[k]`. Runs are in order of length and rank. `sequences` is how many sequences there are.
    """

    length: np.ndarray
    rank: np.ndarray
    first: np.ndarray
    each: np.ndarray
    base: np.ndarray
    sequences: int

    def place(self, length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Sequences and offsets of pieces."""
        run = np.searchsorted((self.length << 46) | self.rank, (length << 46) | rank, "right") - 1
        behind = rank - self.rank[run]
        return self.first[run] + behind // self.each[run], self.base[run] + behind % self.each[run] * length


def plan(counts: dict[int, int], size: int) -> Plan:
    """Best-fit decreasing of `counts[length]` pieces of each length into sequences of `size`."""
    tree, opened, runs = Capacities(size), 0, []
    #: Open sequences by remaining capacity, as (first, how many).
    room: list[deque] = [deque() for _ in range(size + 1)]

    def leave(capacity: int, first: int, number: int) -> None:
        if capacity and number:
            room[capacity].append((first, number))
            tree.put(capacity, True)

    for length in sorted(counts, reverse=True):
        left, rank = counts[length], 0
        while left:
            capacity = tree.tightest(length)
            each = (size if capacity is None else capacity) // length
            wanted = -(-left // each)
            if capacity is None:
                capacity, first, number = size, opened, wanted
                opened += wanted
            else:
                first, number = room[capacity].popleft()
                if number > wanted:
                    room[capacity].appendleft((first + wanted, number - wanted))
                    number = wanted
                if not room[capacity]:
                    tree.put(capacity, False)
            runs.append((length, rank, first, each, size - capacity))
            placed = min(left, number * each)
            full, over = divmod(placed, each)
            leave(capacity - each * length, first, full)
            leave(capacity - over * length, first + full, 1 if over else 0)
            left, rank = left - placed, rank + placed
    table = np.array(sorted(runs), np.int64).reshape(-1, 5)
    return Plan(*table.T, opened)


PIECES = "doc_id long, piece int, start long, length int, ids binary, part int, seat long"


def pieces(docs: DataFrame, tokenizer: str, end_id: int, size: int = SIZE) -> DataFrame:
    """Token ids (little-endian u32) of (doc_id, text) with an end id, cut where longer than `size`; numbered by part and length."""
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.encode(F.coalesce("text", F.lit("")), "UTF-8").alias("text"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = common.per_worker(("tiles", tokenizer), lambda: tiles.Encoder(tokenizer))
        part, seats = TaskContext.get().partitionId(), np.zeros(size + 1, np.int64)
        for chunk in tiles.chunks(batches, 1):
            ids, lengths = encoder(chunk.column(1))
            n = len(lengths)
            out = np.full(len(ids) + n, end_id, "<u4")
            out[np.arange(len(ids)) + np.repeat(np.arange(n), lengths)] = ids
            lengths = lengths + 1
            number = -(-lengths // size)
            doc = np.repeat(np.arange(n), number)
            piece = np.arange(len(doc)) - np.repeat(np.cumsum(number) - number, number)
            start = piece * size
            long = np.minimum(size, lengths[doc] - start)
            # how many pieces of the same length came before
            order = np.argsort(long, kind="stable")
            run = np.concatenate([[True], np.diff(long[order]) > 0])
            within = np.arange(len(order)) - np.maximum.accumulate(np.where(run, np.arange(len(order)), 0))
            seat = np.empty(len(order), np.int64)
            seat[order] = within + seats[long[order]]
            seats += np.bincount(long, minlength=size + 1)
            offsets = np.concatenate([[0], np.cumsum(long * 4)]).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [chunk.column(0).take(pa.array(doc)), pa.array(piece.astype(np.int32)), pa.array(start), pa.array(long.astype(np.int32)),
                 pa.Array.from_buffers(pa.binary(), len(doc), [None, pa.py_buffer(offsets), pa.py_buffer(out)]),
                 pa.array(np.full(len(doc), part, np.int32)), pa.array(seat)],
                names=[c.split()[0] for c in PIECES.split(", ")],
            )

    return common.written(texts.mapInArrow(cut, PIECES), "pieces")


def packed(docs: DataFrame, tokenizer: str, end_id: int, size: int = SIZE) -> DataFrame:
    """(doc_id, piece, start, length, ids, sequence_id, offset) of every piece of (doc_id, text); ids are little-endian u32."""
    cut = pieces(docs, tokenizer, end_id, size)
    # one row per part and length
    counts = common.written(cut.groupBy("part", "length").count(), "piece-counts")
    totals = {row.length: row.n for row in counts.groupBy("length").agg(F.sum("count").alias("n")).collect()}
    places = plan(totals, size)

    @F.pandas_udf("sequence_id long, offset long")
    def place(length: pd.Series, rank: pd.Series) -> pd.DataFrame:
        sequence, offset = places.place(length.to_numpy(np.int64), rank.to_numpy(np.int64))
        return pd.DataFrame({"sequence_id": sequence, "offset": offset})

    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = counts.withColumn("base", F.coalesce(F.sum("count").over(before), F.lit(0))).select("part", "length", "base")
    ranked = cut.join(bases, ["part", "length"])
    spot = place(F.col("length"), F.col("base") + F.col("seat"))
    return ranked.withColumn("spot", spot).select("doc_id", "piece", "start", "length", "ids", "spot.sequence_id", "spot.offset")


def sequences(placed: DataFrame) -> DataFrame:
    """(sequence_id, ids, length, members): each sequence of what `packed` gives, put together; members are (doc_id, piece, offset)."""
    own = F.sort_array(F.collect_list(F.struct("offset", "ids", "doc_id", "piece")))
    whole = placed.groupBy("sequence_id").agg(own.alias("own"))
    joined = F.aggregate("own", F.lit(b"").cast("binary"), lambda ids, x: F.concat(ids, x["ids"]))
    members = F.transform("own", lambda x: F.struct(x["doc_id"].alias("doc_id"), x["piece"].alias("piece"), x["offset"].alias("offset")))
    return whole.select("sequence_id", joined.alias("ids"), members.alias("members")).withColumn("length", (F.octet_length("ids") / 4).cast("int"))


def op12_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents (49k word vocabulary, end id 0) in sequences of 2048 ids."""
    import public_tokenizers

    placed = packed(common.read(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), 0)
    return placed.select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32"), "sequence_id", "offset")
