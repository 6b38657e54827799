"""The bounded sample of labelled documents that the classifiers learn from."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskflow.llm import common

#: Texts above this size teach nothing; they are scored like any other.
SAMPLE_BYTES = 100_000


def sample(docs: DataFrame, labels: DataFrame, label: str, rows: int) -> DataFrame:
    """
    At most `rows` rows (text, label) of labelled documents that are not held out, drawn by a hash of the id.

    Ids are drawn first, so documents meet a broadcast of `rows` ids at most and aren't shuffled. Null ids and labels
    teach nothing; of repeated labels of an id, any two that differ both count.
    """
    known = labels.select(F.col("doc_id"), F.col(label).cast("int").alias("label")).where(F.col("label").isin(0, 1) & ~common.held_out(F.col("doc_id")))
    drawn = known.distinct().orderBy(F.xxhash64("doc_id"), "doc_id", "label").limit(rows)
    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).where(F.octet_length("text") <= SAMPLE_BYTES)
    return texts.join(F.broadcast(drawn), "doc_id").orderBy(F.xxhash64("doc_id"), "doc_id", "text").limit(rows).select("text", "label")
