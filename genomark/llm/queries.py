"""The registered queries of this subpackage: each applies an operator to its whole table with production parameters."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from genomark.session import table


def op1_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from genomark.llm.near_duplicates import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents"))


def op2_best_two_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from genomark.llm.packing import pack

    return pack(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), capacity=4096, end_id=1)


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from genomark.llm.token_counts import token_counts

    return token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), limit=1024)


#: Verdict, host and path of the rules of op4.
URL_RULES = [("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", "net", "/fr/")]


def op4_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    from genomark.llm.url_filters import url_verdicts

    return url_verdicts(table(spark, sf_dir, "pages"), URL_RULES)


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from genomark.llm.substring_dedup import remove_repeats

    return remove_repeats(table(spark, sf_dir, "documents"))


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from genomark.llm import quality_rules as q

    return q.apply_policy(q.ledger(table(spark, sf_dir, "documents")), "v1")


def op7_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    from genomark.llm.fingerprints import document_fingerprints

    return document_fingerprints(table(spark, sf_dir, "documents"))


def op8_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    from genomark.llm.sharding import shards

    return shards(table(spark, sf_dir, "documents"), n_shards=24)


def op9_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    from genomark.llm.secret_scans import scan

    return scan(table(spark, sf_dir, "documents"))


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from genomark.llm.mixing import mix

    return mix(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), {"clean": 0.9, "low": 0.08, "toxic": 0.02})


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    from genomark.llm.conversations import digests

    return digests(table(spark, sf_dir, "conversations"))


def op12_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from genomark.llm.line_dedup import digests

    return digests(table(spark, sf_dir, "documents"), min_documents=10, min_chars=1)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    own = (
        op1_ngram_jaccard_join,
        op2_best_two_fit_packing,
        op3_token_counts,
        op4_url_filters,
        op5_substring_dedup,
        op6_quality_rules,
        op7_fingerprints,
        op8_sharding,
        op9_secret_scans,
        op10_mixing,
        op11_conversation_repair,
        op12_line_dedup,
    )
    return {f.__name__: f for f in own}


def oracle_sql() -> dict[str, str]:
    from genomark.llm import line_dedup, quality_rules, substring_dedup

    return {"op5_substring_dedup": substring_dedup.ORACLE_SQL, "op6_quality_rules": quality_rules.ORACLE_SQL, "op12_line_dedup": line_dedup.ORACLE_SQL}
