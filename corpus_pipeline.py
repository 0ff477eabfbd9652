"""From raw documents to packed sequences: quality, near-duplicates, benchmark passages, personal data, packing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewarden.llm import decontaminate, packing, pii, quality, simhash
from tracewarden.llm.common import table, write_shared
from tracewarden.llm.queries import tokenizer_path


def good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents that the quality classifier rejects."""
    judged = quality.judged(docs, table(spark, sf_dir, "labels"))
    return judged.where(judged.columns[-1]).select(*docs.columns)


def distinct(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: fingerprints of 4 words that differ in 4 bits at most, or shingles of 5 words with a Jaccard similarity of 0.8 or more."""
    return simhash.deduplicated(docs, shingle=4, seed=42, tau=4, alike=5)


def uncontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents that hold a benchmark item."""
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def redacted(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """With personal data replaced by [KIND], and n_chars as it is then."""
    return pii.redacted(docs).withColumn("n_chars", F.length("text").cast("long"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in sequences of 2048 tokens."""
    return packing.packed(docs, tokenizer_path(), size=2048, end_id=1)


STAGES = [("quality", good), ("near-duplicates", distinct), ("decontamination", uncontaminated), ("personal data", redacted), ("packing", packed)]
#: The stages are not expressible in SQL; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = write_shared(docs, name.replace(" ", "-"))
    return docs
