"""
Document quality from a linear-chain conditional random field over lines.

Each line is good or bad. A line's features are its own counts (length, capitals, digits, signs, bars, repetition, ...), each in
one of `BINS` ranges, and those of the lines before and after it; the chain adds how states follow one another.
Forward-backward gives each line's probability of being good, and the mean over the lines, weighted by length, turned into
a probability by a logistic curve, is the document's score.

Labels are known for documents only. The field first learns from lines that all bear their document's label; then lines of bad
documents that look good by themselves are taken as good, and it learns again. It is fitted with numpy on at most `SAMPLE`
labelled documents and sent to the tasks; every document is scored whole.

Null and empty texts are one empty line. Rows are scored one by one, so null ids and equal rows change nothing. Without any labelled
row every score is 0.5; an empty table gives no row.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from riskflow.llm import common, labelled

#: The most labelled documents that a model learns from.
SAMPLE = 4000
BINS, STEPS, RATE, PULL = 8, 150, 0.1, 1e-3
GOOD_FROM = 0.3
_KIND = np.zeros(256, np.uint8)  # 0 letters, 1 capitals, 2 digits, 3 white space, 4 beyond ASCII, 5 bars, 6 exclamation marks, 7 stops, 8 other signs
_KIND[33:127] = 8
_KIND[97:123], _KIND[65:91], _KIND[48:58], _KIND[[32, *range(9, 14)]], _KIND[128:], _KIND[ord("|")], _KIND[ord("!")], _KIND[[44, 46]] = 0, 1, 2, 3, 4, 5, 6, 7
KINDS, STATS = 9, 14


def line_stats(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of every line of every text, [line, STATS], and how many lines each text has."""
    lines = [t.split("\n") for t in texts]
    counts = np.array([len(x) for x in lines])
    raw = np.frombuffer(("\n".join(texts) + "\n").encode(), np.uint8)
    # every line, also the last of a text, ends with a newline here
    ends = np.flatnonzero(raw == 10)
    starts = np.append(0, ends[:-1] + 1)
    kinds = np.empty((len(ends), KINDS))
    which = _KIND[raw]
    for k in range(KINDS):
        kinds[:, k] = np.add.reduceat((which == k).astype(np.int32), starts)
    kinds[:, 3] -= 1
    size = np.maximum(1, ends - starts)
    words, distinct, again, longest = (np.empty(len(ends)) for _ in range(4))
    n = 0
    for own in lines:
        seen: set[str] = set()
        for line in own:
            found = line.split()
            words[n], distinct[n] = len(found), len(set(found))
            longest[n] = len(max(found, key=len)) if found else 0
            again[n] = line in seen
            seen.add(line)
            n += 1
    shares = kinds / size[:, None]
    return np.column_stack([shares, np.log1p(ends - starts), words / size, distinct / np.maximum(1, words), again, np.log1p(longest)]), counts


@dataclass
class Field:
    """A fitted field: bin edges [STATS, BINS - 1], weights by neighbour, number and bin, chain scores, and the logistic curve."""

    edges: np.ndarray
    weights: np.ndarray  # [3, STATS, BINS]: the line before, itself, the line after
    outside: np.ndarray  # [2]: no line before, none after
    bias: float
    chain: np.ndarray  # [2, 2]
    curve: tuple[float, float]

    @classmethod
    def blank(cls, edges: np.ndarray) -> Field:
        return cls(edges, np.zeros((3, STATS, BINS)), np.zeros(2), 0.0, np.zeros((2, 2)), (0.0, 0.0))

    def bins(self, stats: np.ndarray) -> np.ndarray:
        return np.column_stack([np.searchsorted(self.edges[k], stats[:, k], side="left") for k in range(STATS)])

    def emission(self, bins: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """Log odds of good over bad by a line's features alone."""
        k = np.arange(STATS)
        own, before, after = (self.weights[j, k, bins].sum(1) for j in (1, 0, 2))
        ends = np.cumsum(counts)
        starts = ends - counts
        score = own + self.bias
        score[1:] += before[:-1]
        score[:-1] += after[1:]
        # what crossed from one text into the next is taken back
        inner = starts[1:]
        score[inner] -= before[inner - 1]
        score[inner - 1] -= after[inner]
        score[starts] += self.outside[0]
        score[ends - 1] += self.outside[1]
        return score

    def marginals(self, score: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Probability of good per line, and expected transitions [2, 2] summed; all texts step together, long ones first."""
        order = np.argsort(-counts, kind="stable")
        sizes, starts = counts[order], (np.cumsum(counts) - counts)[order]
        steps = int(sizes[0]) if len(sizes) else 0
        active = np.searchsorted(-sizes, -np.arange(steps), side="left")
        emit = np.stack([np.zeros(len(score)), score], 1)
        ahead, behind = np.zeros((len(score), 2)), np.zeros((len(score), 2))
        add = lambda x: np.logaddexp(x[..., 0], x[..., 1])
        for t in range(steps):
            at = starts[: active[t]] + t
            ahead[at] = emit[at] + (add(np.swapaxes(ahead[at - 1][:, :, None] + self.chain, 1, 2)) if t else 0)
        for t in range(steps - 2, -1, -1):
            at = starts[: active[t + 1]] + t
            behind[at] = add(self.chain + (emit[at + 1] + behind[at + 1])[:, None, :])
        total = ahead + behind
        good = 1 / (1 + np.exp(np.clip(total[:, 0] - total[:, 1], -700, 700)))
        follows = np.ones(len(score), bool)
        follows[starts] = False
        at = np.flatnonzero(follows)
        pair = ahead[at - 1][:, :, None] + self.chain + (emit[at] + behind[at])[:, None, :]
        pair = np.exp(pair - np.logaddexp.reduce(pair.reshape(-1, 4), axis=1)[:, None, None]) if len(at) else np.zeros((0, 2, 2))
        return good, pair.sum(0)

    def learn(self, bins: np.ndarray, counts: np.ndarray, label: np.ndarray) -> None:
        """Raise the likelihood of the lines' labels (1 good), by Adam on the exact gradient."""
        ends = np.cumsum(counts)
        starts = ends - counts
        follows = np.ones(len(bins), bool)
        follows[starts] = False
        at = np.flatnonzero(follows)
        seen = np.zeros((2, 2))
        np.add.at(seen, (label[at - 1], label[at]), 1)
        columns = bins + np.arange(STATS) * BINS
        n = len(bins)
        sizes = [3 * STATS * BINS, 2, 1, 4]
        moment, power = np.zeros(sum(sizes)), np.zeros(sum(sizes))
        cuts = np.cumsum(sizes)[:-1]
        for step in range(1, STEPS + 1):
            good, pairs = self.marginals(self.emission(bins, counts), counts)
            off = label - good
            before, after = np.zeros(n), np.zeros(n)
            before[at - 1], after[at] = off[at], off[at - 1]
            by = [np.bincount(columns.ravel(), np.repeat(o, STATS), STATS * BINS) for o in (before, off, after)]
            slope = np.concatenate([np.concatenate(by), [off[starts].sum(), off[ends - 1].sum()], [off.sum()], (seen - pairs).ravel()]) / n
            now = np.concatenate([self.weights.ravel(), self.outside, [self.bias], self.chain.ravel()])
            slope -= PULL * now
            moment, power = 0.9 * moment + 0.1 * slope, 0.99 * power + 0.01 * slope**2
            now += RATE * moment / (1 - 0.9**step) / (np.sqrt(power / (1 - 0.99**step)) + 1e-8)
            weights, self.outside, bias, chain = np.split(now, cuts)
            self.weights, self.bias, self.chain = weights.reshape(3, STATS, BINS), float(bias[0]), chain.reshape(2, 2)

    def shares(self, texts: list[str]) -> np.ndarray:
        """The length-weighted mean probability of good lines, per text."""
        stats, counts = line_stats(texts)
        good, _ = self.marginals(self.emission(self.bins(stats), counts), counts)
        weight = np.expm1(stats[:, KINDS]) + 1
        starts = np.cumsum(counts) - counts
        return np.add.reduceat(good * weight, starts) / np.add.reduceat(weight, starts)

    def scores(self, texts: list[str]) -> np.ndarray:
        slope, shift = self.curve
        return 1 / (1 + np.exp(-(slope * self.shares(texts) + shift)))


def fit(texts: list[str], labels: np.ndarray) -> Field:
    """A field learned from whole texts and their labels (1 good, 0 bad)."""
    if not len(texts):
        return Field.blank(np.zeros((STATS, BINS - 1)))
    stats, counts = line_stats(texts)
    quantiles = np.linspace(0, 1, BINS + 1)[1:-1]
    bad = np.repeat(labels, counts) == 0
    # bins of both kinds of lines, so that rare junk is told apart
    pools = [p for p in (stats[bad], stats[~bad]) if len(p)]
    edges = np.sort(np.concatenate([np.quantile(p, quantiles[k :: len(pools)], axis=0) for k, p in enumerate(pools)]), axis=0).T
    field = Field.blank(edges)
    bins, label = field.bins(stats), 1 - bad.astype(int)
    field.learn(bins, counts, label)
    again = np.where(bad & (field.emission(bins, counts) > 0), 1, label)
    whole = np.add.reduceat(again, np.cumsum(counts) - counts) == counts
    # a bad document has a bad line somewhere
    again = np.where(np.repeat(whole & (labels == 0), counts), 0, again)
    field.learn(bins, counts, again)
    share, slope, shift = field.shares(texts), 0.0, 0.0
    for _ in range(200):  # Newton steps on a penalised logistic curve
        p = 1 / (1 + np.exp(-np.clip(slope * share + shift, -50, 50)))
        x = np.column_stack([share, np.ones(len(share))])
        grad = x.T @ (labels - p) - np.array([1e-2 * slope, 0])
        hess = (x * (p * (1 - p))[:, None]).T @ x + np.diag([1e-2, 1e-6])
        move = np.clip(np.linalg.solve(hess, grad), -5, 5)
        slope, shift = slope + move[0], shift + move[1]
        if np.abs(move).max() < 1e-6:
            break
    field.curve = (float(slope), float(shift))
    return field


def trained(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE) -> Field:
    learned = labelled.sample(docs, labels, "quality", rows).toPandas()
    return fit(learned["text"].tolist(), learned["label"].to_numpy(dtype=int))


def score(field: Field) -> Column:
    """The score of column `text`."""
    return scorer(field)("text")


def scorer(field: Field):
    sent = SparkSession.active().sparkContext.broadcast(field)

    @F.pandas_udf("double")
    def run(texts: pd.Series) -> pd.Series:
        return pd.Series(sent.value.scores([t or "" for t in texts]) if len(texts) else [], dtype=float)

    return run


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of every document."""
    docs = common.read(spark, sf_dir, "documents").select("doc_id", "text")
    field = trained(docs, common.read(spark, sf_dir, "labels"))
    scored = docs.select("doc_id", common.held_out(F.col("doc_id")).alias("held_out"), score(field).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= GOOD_FROM).cast("int"))
