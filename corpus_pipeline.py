"""
A training corpus from raw documents, stage by stage.

Each stage takes (spark, docs, sf_dir) and works on all that the one before it kept. Documents of poor quality go; of near
duplicates one stays; byte strings that still occur elsewhere are cut out of the texts; documents with benchmark passages
go; what is left is segmented into pieces and decoded from them. All but the last return the columns of `documents`.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskflow.llm import common, decontamination, quality, segmentation, simhash, suffixes


def good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose quality score reaches the threshold of good ones."""
    field = quality.trained(docs.select("doc_id", "text"), common.read(spark, sf_dir, "labels"))
    return docs.where(quality.score(field) >= quality.GOOD_FROM)


def distinct(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the smallest id, of each group of near duplicates."""
    common.small_batches(spark)
    return simhash.deduplicated(docs)


def unrepeated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the byte strings that occur elsewhere."""
    common.small_batches(spark)
    return suffixes.without_repeats(docs)


def uncontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without benchmark passages."""
    return decontamination.clean(docs, common.read(spark, sf_dir, "benchmark"))


def pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids of each text's best segmentation, the scores of the best three, and the text decoded from the ids."""
    import public_tokenizers

    common.small_batches(spark)
    found = segmentation.segmented(F.col("text"), public_tokenizers.path("piece_bpe_32k.model"), full=True)
    return docs.select("doc_id", "lang", "source", found.alias("found")).select("doc_id", "lang", "source", "found.ids", "found.score", "found.nbest_scores", F.col("found.decoded").alias("text"))


STAGES = [("quality", good), ("near_duplicates", distinct), ("suffixes", unrepeated), ("decontamination", uncontaminated), ("pieces", pieces)]
#: SQL can't express a fitted field, fingerprints or a segmentation; tests/llm/test_pipeline.py compares with a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in turn over `documents`; each result is written to the shared folder and read again."""
    docs = common.read(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = common.written(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
