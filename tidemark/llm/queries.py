"""Registered queries of the training-data operators and, where SQL can express them, their DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import (
    bpe_trie, conversation, exact_dedup, langid, lbl, lexical, packing, quality_knn, quality_rules, simhash, sql, token_counts, url_filter, warc)
from tidemark.llm.common import scratch, table

Query = Callable[[SparkSession, str], DataFrame]


def op1_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge(table(spark, sf_dir, "pages"))


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op3_quality_knn(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_knn.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(table(spark, sf_dir, "documents"))


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_edited(table(spark, sf_dir, "documents"), token_counts.revision())


def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_duplicates(table(spark, sf_dir, "documents"))


def op8_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_trie.digests(table(spark, sf_dir, "documents"))


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    segments = warc.write_archives(table(spark, sf_dir, "pages"), scratch(spark, "warc"))
    return warc.read_pages(segments)


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.judge(table(spark, sf_dir, "documents"))


def op11_lbl_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lbl.score(table(spark, sf_dir, "documents"))


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = conversation.damaged(table(spark, sf_dir, "conversations"))
    return conversation.digests(conversation.repair(rows, gone=F.col("gone")))


def op13_lexical(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def registry() -> dict[str, Query]:
    return {f.__name__: f for f in (
        op1_url_filter, op2_simhash, op3_quality_knn, op4_language_id, op5_packing, op6_token_counts, op7_exact_dedup,
        op8_bpe, op9_warc, op10_quality_rules,
        op11_lbl_scoring, op12_conversation_repair, op13_lexical)}


def oracle_sql() -> dict[str, str]:
    return {"op7_exact_dedup": sql.EXACT_DEDUP, "op9_warc": sql.WARC, "op10_quality_rules": sql.QUALITY_RULES,
            "op13_lexical": sql.LEXICAL}
