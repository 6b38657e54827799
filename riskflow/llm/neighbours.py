"""
Nearest neighbours by multi-index hashing of learned binary codes.

A vector's code has `BITS` bits: the signs of its coordinates after rotations that are learned, on a bounded sample, to bring
the coordinates near the corners of a cube. The code is cut into `PARTS` substrings and each is indexed by value. Codes within
Hamming distance `PARTS * (t + 1) - 1` of a query agree with it in some substring up to t bits, so probing all substring
values at t = 0, 1, 2, ... bits yields every code within a growing radius. What is within the radius is ranked by its cosine, on the
original vectors in double precision. A query stops when the radius covers the distance that its last neighbour's angle
leads one to expect, and `SPREAD` standard deviations more; with fewer neighbours than asked for, it goes on to the end.

Equal vectors are one class, which carries the few smallest ids that a result can need, so copies are searched once.
The classes are cut into shards, each with an index of its own, and the distinct query vectors into blocks; every block meets
every shard in a task, and the best of all shards are merged.

Vectors that are null, zero, of another length than most, or hold null or non-finite numbers take no part, nor do rows
without id. If an id is repeated, the least of its vectors stands for it. Equal cosines go to the smaller id. An empty table gives no row.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from riskflow.llm import common

BITS, PARTS = 128, 16
#: Vectors that the rotations are learned from.
SAMPLE = 10_000
SPREAD = 3.0
#: Vectors of one shard and queries of one block at most.
SHARD, BLOCK = 1 << 15, 1 << 11
_ONES = np.array([bin(x).count("1") for x in range(256)], np.uint8)
#: Bytes by the number of their bits.
_BY_ONES = [np.flatnonzero(_ONES == t).astype(np.uint8) for t in range(9)]


def scaled(vectors: np.ndarray) -> np.ndarray:
    """Rows times powers of two, so that squares neither overflow nor vanish; angles stay as they are to the last bit."""
    vectors = vectors.astype(np.float64)
    return np.ldexp(vectors, -np.frexp(np.abs(vectors).max(1, initial=0))[1][:, None])


def learn(vectors: np.ndarray, seed: int = 0, rounds: int = 20) -> np.ndarray:
    """Rotations [dimension, BITS] that leave little between coordinates and their signs."""
    rng, d = np.random.default_rng(seed), vectors.shape[1]
    unit = scaled(vectors)
    unit /= np.linalg.norm(unit, axis=1, keepdims=True)
    turns = []
    for _ in range(-(-BITS // d)):
        turn = np.linalg.qr(rng.normal(size=(d, d)))[0]
        for _ in range(rounds if len(unit) > d else 0):
            u, _, v = np.linalg.svd(unit.T @ np.where(unit @ turn > 0, 1.0, -1.0))
            turn = u @ v
        turns.append(turn)
    return np.concatenate(turns, axis=1)[:, :BITS]


def codes(vectors: np.ndarray, turns: np.ndarray) -> np.ndarray:
    """[row, PARTS] bytes."""
    return np.packbits(scaled(vectors) @ turns > 0, axis=1)


@dataclass
class Index:
    """The index of one shard."""

    vectors: np.ndarray
    turns: np.ndarray

    def __post_init__(self):
        self.codes = codes(self.vectors, self.turns)
        self.scaled = scaled(self.vectors)
        self.norms = np.sqrt((self.scaled**2).sum(1))
        self.order = [np.argsort(self.codes[:, j], kind="stable") for j in range(PARTS)]
        self.starts = [np.searchsorted(self.codes[o, j], np.arange(257)) for j, o in enumerate(self.order)]

    def search(self, query: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Rows and cosines of the k nearest found, best first; ties at the end all stay."""
        own = scaled(query[None])[0]
        code, norm = codes(query[None], self.turns)[0], np.sqrt((own**2).sum())
        waiting, known = np.zeros(len(self.vectors), bool), np.zeros(len(self.vectors), bool)
        rows, scores = np.zeros(0, int), np.zeros(0)
        for t in range(9):
            for j in range(PARTS):
                at = self.starts[j]
                for value in (_BY_ONES[t] ^ code[j]).tolist():
                    waiting[self.order[j][at[value] : at[value + 1]]] = True
            waiting &= ~known
            found = np.flatnonzero(waiting)
            distance = _ONES[self.codes[found] ^ code].sum(1, dtype=np.int64)
            radius = PARTS * (t + 1) - 1
            found = found[distance <= radius]
            known[found], waiting[found] = True, False
            fresh = (self.scaled[found] * own).sum(1) / (self.norms[found] * norm)
            rows, scores = np.append(rows, found), np.append(scores, fresh)
            if len(rows) > k:
                last = np.partition(scores, -k)[-k]
                rows, scores = rows[scores >= last], scores[scores >= last]
            if len(rows) >= k:
                part = np.arccos(np.clip(scores.min(), -1, 1)) / np.pi
                if BITS * part + SPREAD * np.sqrt(BITS * part * (1 - part)) <= radius:
                    break
        best = np.argsort(-scores, kind="stable")
        return rows[best], scores[best]


def nearest(embeddings: DataFrame, every: int, k: int) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest of each vector whose id is divisible by `every`."""
    spark = embeddings.sparkSession
    usable = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding")).where(
        "vec_id is not null and embedding is not null and size(embedding) > 0 and forall(embedding, x -> x is not null and not isnan(x) and abs(x) < double('inf')) and exists(embedding, x -> x <> 0)"
    )
    usage = usable.groupBy(F.size("embedding").alias("n")).count().orderBy(F.desc("count"), "n").first()
    schema = "query_id long, rank int, vec_id long, score double"
    if usage is None:
        return spark.createDataFrame([], schema)
    vectors = common.written(usable.where(F.size("embedding") == usage.n).groupBy("vec_id").agg(F.min("embedding").alias("embedding")), "ann-vectors")
    # of equal vectors, the k + 1 smallest ids are all that a query's results can name; the limit is applied before the shuffle too
    least = Window.partitionBy("embedding").orderBy("vec_id")
    classes = vectors.withColumn("n", F.row_number().over(least)).where(F.col("n") <= k + 1)
    classes = classes.groupBy("embedding").agg(F.sort_array(F.collect_list("vec_id")).alias("ids"))
    queries = vectors.where(F.col("vec_id") % every == 0)
    asked = common.written(queries.groupBy("embedding").agg(F.min("vec_id").alias("query")), "ann-asked")
    classes = common.written(classes, "ann-classes")

    learned = np.array(classes.orderBy(F.xxhash64("ids")).limit(SAMPLE).select("embedding").toPandas()["embedding"].tolist())
    turns = learn(learned)
    shards = common.tasks_for(spark, classes.count(), SHARD)
    shards = max(shards, 2 * spark.sparkContext.defaultParallelism)
    blocks = max(1, -(-asked.count() // BLOCK))

    def task(index: pd.DataFrame, wanted: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(index) and len(wanted):
            shard = Index(np.array(index["embedding"].tolist()), turns)
            ids = index["ids"].tolist()
            for query, vector in zip(wanted["query"].tolist(), wanted["embedding"], strict=True):
                rows, scores = shard.search(np.asarray(vector), k + 1)
                out += [(query, i, s) for row, s in zip(rows.tolist(), scores.tolist(), strict=True) for i in ids[row]]
        return pd.DataFrame(out, columns=["query", "vec_id", "score"])

    grid = ["shard", "block"]
    left = classes.select("embedding", "ids", F.pmod(F.xxhash64("ids"), F.lit(shards).cast("long")).alias("shard"), F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"))
    right = asked.select("query", "embedding", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(shards - 1).cast("long"))).alias("shard"), F.pmod(F.xxhash64("query"), F.lit(blocks)).cast("int").alias("block"))
    found = left.groupBy(*grid).cogroup(right.groupBy(*grid)).applyInPandas(task, "query long, vec_id long, score double")
    best = Window.partitionBy("query").orderBy(F.desc("score"), "vec_id")
    # one more than asked for, since each query leaves itself out
    found = found.withColumn("n", F.row_number().over(best)).where(F.col("n") <= k + 1).drop("n")
    named = queries.join(asked, "embedding").select(F.col("vec_id").alias("query_id"), "query")
    found = named.join(found, "query").where("vec_id <> query_id")
    rank = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(rank)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op5_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 5 nearest of every 50th vector."""
    embeddings = common.read(spark, sf_dir, "embeddings")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "10000")
    return nearest(embeddings, 50, 5)
