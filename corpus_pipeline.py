"""From raw documents to packed training sequences: five stages, each an operator of `cohortflow.llm`.

quality rules -> n-gram Jaccard join -> secret scans -> mixing to target weights -> packing

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of `docs`.
Between stages the rows are written to the shared folder as Parquet and read again, so a lost executor costs one
stage's tasks at most.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from cohortflow.llm import jaccard_join, mixing, packing, quality, secret_scan
from cohortflow.llm.common import stored, table

#: Sources by code point weigh these in turn.
MIX_WEIGHTS = (3.0, 1.0, 2.0)


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and the learned decision list."""
    return quality.keep_good(docs, table(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates (five-word shingles, similarity 0.8 or more): the smallest id."""
    return jaccard_join.first_of_each(docs, n_words=5, percent=80)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, live-looking credentials replaced in their texts."""
    return secret_scan.without_live(docs)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeated or left out so that sources meet their target weights."""
    return mixing.repeat_documents(docs, mixing.mix(docs, MIX_WEIGHTS))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces placed in sequences of 1024 ids."""
    return packing.pack_public(docs)


STAGES = [("quality rules", quality_rules), ("n-gram Jaccard join", near_duplicates), ("secret scans", secrets),
          ("mixing sources to target weights", mixture), ("packing", packed)]

#: SQL cannot express learned rules, similarity components or token ids; tests/llm compares with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages, applied to `documents`."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"stage-{name.split()[0]}")
    return STAGES[-1][1](spark, docs, sf_dir)
