"""From raw documents to packed training sequences; each stage works on all rows its predecessor kept.

Defined results.  A null or empty text fails the base rules and goes.  Rows with a null id take part like any other and
end as pieces with a null id.  Of repeated rows one stays.  Null lang is a stratum of its own.  Extra columns are carried
to the last stage, whatever their names, and ignored.  An empty table gives no pieces; without labels only the base rules
reject.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from facetlake.llm import common, neardup, packing, pii, quality


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules or a risk-controlled cutoff reject go."""
    return quality.keep(docs, common.read(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near copies stays: that of the smallest id."""
    return neardup.survivors(docs)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data in the texts is replaced by the name of its kind."""
    return pii.redacted(docs)


def packed_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in windows of 2048 tokens."""
    import public_tokenizers

    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [
    ("quality rules", quality_rules),
    ("near-duplicates", near_duplicates),
    ("personal data", personal_data),
    ("packing", packed_sequences),
]

#: Consistent sampling, boosted trees and tokenizers have no SQL form; a test compares the whole run with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages; what a stage wrote is deleted when the next one has read it."""
    docs = common.read(spark, sf_dir, "documents")
    with common.Scratch(spark) as scratch:
        for name, stage in STAGES[:-1]:
            docs = scratch.table(stage(spark, docs, sf_dir), "pipeline-" + name.replace(" ", "-"))
            scratch.drop(but=1)
        return STAGES[-1][1](spark, docs, sf_dir)  # reads its own table of ids from here on
