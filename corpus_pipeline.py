"""A training-data pipeline of five stages over ``documents``.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again as the next stage's docs. All but the
last return the columns of documents, and further columns of any name that the table has.

Defined cases: a null text counts as empty; of several empty or null texts one stays; null ids are the smallest in the exact stage and come last in the near one; of
repeated rows one stays; empty tables give empty results; without labels of both kinds, or without benchmark items, a stage drops nothing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from orrery.llm.best_fit_packing import pack_documents
from orrery.llm.common import durable
from orrery.llm.decontaminate import clean_documents
from orrery.llm.exact_dedup import exact_dedup
from orrery.llm.quality_bayes import quality_filter
from orrery.llm.simhash_anchors import similar_dedup
from orrery.session import read_table


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects go."""
    return quality_filter(docs, read_table(spark, sf_dir, "labels"))


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the one with the largest id stays."""
    return exact_dedup(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates (Jaccard similarity of 5-word shingles 0.8 or more) the one with the smallest id stays."""
    return similar_dedup(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a window of a benchmark item go."""
    return clean_documents(docs, read_table(spark, sf_dir, "benchmark"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The remaining documents as pieces in packed token sequences."""
    return pack_documents(docs)


STAGES = [("quality classifier", quality), ("exact dedup", exact), ("near dedup", near), ("decontamination", decontaminate), ("packing", pack)]

#: SQL can't express the classifier, the fingerprints or the tokenizer; tests hold the result against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``."""
    docs = read_table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = durable(docs, f"stage-{k}")
    return docs
