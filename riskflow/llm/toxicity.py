"""
Toxicity of documents by a factorization machine over hashed terms.

A document is the set of its lower-cased words, hashed to `BUCKETS` buckets. The machine scores a set as

    bias + sum of weights + sum over pairs of terms of the inner product of their factors

so two terms can say together what neither says alone, which a sum of weights can't. It learns with numpy from at most
`SAMPLE` labelled documents, on the up to `TERMS` buckets that tell the labels apart best (by the G statistic), alone or, among the
`PAIRED` most frequent ones, as a pair. Every document is scored over all its words.

Null and empty texts are the empty set, scored by the bias. Rows are scored one by one, so null ids and equal rows change nothing.
Without any labelled row every score is 0.5; an empty table gives no row.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from riskflow.llm import common, labelled

#: The most labelled documents that a model learns from.
SAMPLE = 10_000
BUCKETS, TERMS, FACTORS = 1 << 20, 4096, 8
STEPS, BATCH, RATE, PULL = 1000, 256, 0.05, 1e-5
#: The least G statistic of a term that is learned: one in ten thousand unrelated terms reaches it.
EVIDENCE = 15.1
#: Buckets whose pairs are looked at, and the least evidence (a squared normal deviate) by which both of a pair are learned: one in
#: ten thousand sets of unrelated terms has such a pair.
PAIRED, PAIR_EVIDENCE = 2048, 43.0
TOXIC_FROM = 0.5
#: Words whose bucket a task remembers.
REMEMBERED = 500_000
WORD = re.compile(r"\w+")


def bucket(word: str) -> int:
    return zlib.crc32(word.encode("utf-8", "replace")) & BUCKETS - 1


def terms(text: str | None) -> list[int]:
    return sorted({bucket(w) for w in set(WORD.findall((text or "").lower()))})


class _Known(dict):
    """The model's number for each word, -1 if it has none."""

    def __init__(self, numbers: dict[int, int]):
        self.numbers = numbers

    def __missing__(self, word: str) -> int:
        if len(self) >= REMEMBERED:
            self.clear()
        self[word] = found = self.numbers.get(bucket(word), -1)
        return found


@dataclass
class Machine:
    """Weights and factors of the buckets in `kept`."""

    kept: np.ndarray
    bias: float
    weights: np.ndarray
    factors: np.ndarray

    def raw(self, found: np.ndarray, starts: np.ndarray, n: int) -> np.ndarray:
        """Scores of n sets: term numbers laid end to end, and the set each belongs to."""
        total = np.zeros((n, self.factors.shape[1]))
        np.add.at(total, starts, self.factors[found])
        squares = np.bincount(starts, (self.factors[found] ** 2).sum(1), n)
        return self.bias + np.bincount(starts, self.weights[found], n) + 0.5 * ((total**2).sum(1) - squares)

    def scores(self, texts: list[str]) -> np.ndarray:
        known = _Known({int(b): k for k, b in enumerate(self.kept)}) if not hasattr(self, "known") else self.known
        self.known = known
        sets = [{known[w] for w in set(WORD.findall((t or "").lower()))} - {-1} for t in texts]
        of = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
        return _squash(self.raw(np.array([x for s in sets for x in sorted(s)], int), of, len(sets)))


def _squash(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -500, 500)))


def fit(sets: list[np.ndarray], labels: np.ndarray, seed: int = 0) -> Machine:
    """A machine learned from sets of buckets and their labels (1 toxic)."""
    if not sets or labels.min() == labels.max():
        return Machine(np.zeros(0, int), 0.0, np.zeros(0), np.zeros((0, FACTORS)))
    sizes = np.array([len(s) for s in sets])
    flat, of = np.concatenate([np.asarray(s, np.int32) for s in sets]), np.repeat(np.arange(len(sets), dtype=np.int32), sizes)
    ones, zeros = np.bincount(flat[labels[of] == 1], minlength=BUCKETS), np.bincount(flat[labels[of] == 0], minlength=BUCKETS)
    alone = informative(ones, zeros, int(labels.sum()), int((1 - labels).sum()))
    beside = in_company(flat, of, ones + zeros, labels)
    kept = np.sort(np.concatenate([alone, beside[~np.isin(beside, alone)]])[:TERMS])
    number = np.full(BUCKETS, -1, np.int32)
    number[kept] = np.arange(len(kept), dtype=np.int32)
    flat = number[flat]
    of, flat = of[flat >= 0], flat[flat >= 0]
    cuts = np.searchsorted(of, np.arange(len(sets) + 1))

    rng = np.random.default_rng(seed)
    share = np.clip(labels.mean(), 1e-3, 1 - 1e-3)
    machine = Machine(kept, 0.0, np.zeros(len(kept)), rng.normal(0, 0.01, (len(kept), FACTORS)))
    balance = np.array([0.5 / (1 - share), 0.5 / share])
    w_power, v_power, b_power = np.full(len(kept), 1e-8), np.full((len(kept), FACTORS), 1e-8), 1e-8
    for _ in range(-(-STEPS * BATCH // max(BATCH, len(sets)))):
        order = rng.permutation(len(sets))
        for k in range(0, len(order), BATCH):
            rows = order[k : k + BATCH]
            spans = [np.arange(cuts[r], cuts[r + 1]) for r in rows]
            found, own = flat[np.concatenate(spans)], np.repeat(np.arange(len(rows)), [len(s) for s in spans])
            total = np.zeros((len(rows), FACTORS))
            np.add.at(total, own, machine.factors[found])
            off = (labels[rows] - _squash(machine.raw(found, own, len(rows)))) * balance[labels[rows]]
            w_slope, v_slope = np.zeros(len(kept)), np.zeros((len(kept), FACTORS))
            np.add.at(w_slope, found, off[own])
            np.add.at(v_slope, found, off[own, None] * (total[own] - machine.factors[found]))
            used = np.unique(found)
            w_slope[used] -= PULL * len(rows) * machine.weights[used]
            v_slope[used] -= 10 * PULL * len(rows) * machine.factors[used]
            w_power[used] += w_slope[used] ** 2
            v_power[used] += v_slope[used] ** 2
            b_power += off.sum() ** 2
            machine.weights[used] += 10 * RATE * w_slope[used] / np.sqrt(w_power[used])
            machine.factors[used] += RATE * v_slope[used] / np.sqrt(v_power[used])
            machine.bias += RATE * off.sum() / np.sqrt(b_power)
    return machine


def informative(ones: np.ndarray, zeros: np.ndarray, n_ones: int, n_zeros: int) -> np.ndarray:
    """Up to TERMS buckets with the largest G statistics against the labels, of those in three documents or more."""
    seen = np.flatnonzero(ones + zeros >= 3)
    table = np.array([ones[seen], n_ones - ones[seen], zeros[seen], n_zeros - zeros[seen]], float)
    n = table.sum(0)
    rows, columns = np.array([n_ones, n_ones, n_zeros, n_zeros])[:, None], np.array([table[0] + table[2], table[1] + table[3]])[[0, 1, 0, 1]]
    with np.errstate(divide="ignore", invalid="ignore"):
        g = 2 * np.nansum(table * np.log(table * n / (rows * columns)), axis=0)
    best = np.argsort(-g, kind="stable")[:TERMS]
    return seen[best[g[best] >= EVIDENCE]]


def in_company(flat: np.ndarray, of: np.ndarray, counts: np.ndarray, labels: np.ndarray) -> np.ndarray:
    """
    Of the PAIRED most frequent buckets those that tell the labels apart together with another one, best first.

    The evidence of a pair is how far the log odds ratio of its two buckets differs between the labels, squared and over its variance
    (with half a document added to each of the eight counts): what a sum of weights can't tell.
    """
    frequent = np.argsort(-counts, kind="stable")[:PAIRED]
    frequent = frequent[counts[frequent] >= 3]
    number = np.full(BUCKETS, -1, np.int32)
    number[frequent] = np.arange(len(frequent), dtype=np.int32)
    there = number[flat] >= 0
    held = np.zeros((len(labels), len(frequent)), np.float32)
    held[of[there], number[flat[there]]] = 1
    sides = [(side, side.sum(0, dtype=float)) for side in (held[labels == 1], held[labels == 0])]
    best = np.zeros(len(frequent))
    for start in range(0, len(frequent), 128):
        ratios, variance = [], 0.0
        for side, total in sides:
            both, one = (side[:, start : start + 128].T @ side).astype(float), total[start : start + 128, None]
            cells = [n + 0.5 for n in (both, one - both, total - both, len(side) - one - total + both)]
            ratios.append(np.log(cells[0] * cells[3] / (cells[1] * cells[2])))
            variance = variance + sum(1 / n for n in cells)
        evidence = (ratios[0] - ratios[1]) ** 2 / variance
        evidence[np.arange(len(evidence)), np.arange(start, start + len(evidence))] = 0  # a bucket beside itself
        best = np.maximum(best, evidence.max(0))
    order = np.argsort(-best, kind="stable")
    return frequent[order[best[order] >= PAIR_EVIDENCE]]


def trained(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE) -> Machine:
    def hashed(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            yield pd.DataFrame({"terms": [terms(t) for t in frame["text"]], "label": frame["label"]})

    learned = labelled.sample(docs, labels, "toxic", rows).mapInPandas(hashed, "terms array<int>, label int").toPandas()
    return fit(learned["terms"].tolist(), learned["label"].to_numpy(dtype=int))


def score(machine: Machine) -> Column:
    """The score of column `text`."""
    sent = SparkSession.active().sparkContext.broadcast(machine)

    @F.pandas_udf("double")
    def run(texts: pd.Series) -> pd.Series:
        return pd.Series(sent.value.scores(texts.tolist()), dtype=float)

    return run("text")


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every document."""
    docs = common.read(spark, sf_dir, "documents").select("doc_id", "text")
    machine = trained(docs, common.read(spark, sf_dir, "labels"))
    scored = docs.select("doc_id", common.held_out(F.col("doc_id")).alias("held_out"), score(machine).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= TOXIC_FROM).cast("int"))
