"""Corpus pipeline over ``documents``: quality rules, language identification, exact and near deduplication, packing.

Every stage calls one operator of ``tidemark.llm`` on all that the stage before
it kept; its result is written as Parquet and read again as the next one's
input.  A stage's own scratch tables and its input (but for the given table)
are deleted as soon as its result is written.  Nulls, empty and long texts, ties, repeated rows, empty tables and
extra columns are handled as the operators say.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tidemark.llm import exact_dedup, langid, packing, quality_rules, simhash
from tidemark.llm.common import free, scratch, table, temporary

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that fail a rule leave the text; documents that the rules reject go."""
    return quality_rules.clean(docs)


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents go whose language the identifier, trained on these documents' own labels, cannot tell."""
    return langid.accepted(docs)


def exact_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the one with the largest id stays; rows without an id lose, and repeated rows stay once."""
    return exact_dedup.keep_one(docs, null_ids=True)


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of near-duplicates the row with the smallest id stays; rows without an id lose."""
    return simhash.keep_one(docs, null_ids=True)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in sequences of 1024 tokens."""
    return packing.pack(docs)


STAGES: list[tuple[str, Stage]] = [
    ("quality_rules", quality_stage),
    ("language_id", language_stage),
    ("exact_dedup", exact_stage),
    ("simhash_near_dedup", near_stage),
    ("packing", packing_stage),
]

#: Language identification learns a model, which SQL does not express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, one after another, over the whole ``documents`` table."""
    docs, last = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        path = scratch(spark, f"pipeline-{name}", lasting=True)
        with temporary(spark):
            out = stage(spark, docs, sf_dir)
            out.write.parquet(path)
        if last:
            free(spark, last)
        docs, last = spark.read.schema(out.schema).parquet(path), path
    return docs
