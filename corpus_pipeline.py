"""From raw documents to packed sequences: quality rules, near duplicates, secrets, mixing, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written and read again as the next one's
docs; all but the last return the columns of documents.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from genomark.llm import mixing, near_duplicates, packing, quality_rules, secret_scans
from genomark.llm.common import written
from genomark.session import table

#: Weights of the mix, as shares of expected tokens. Documents that are surely clean still have posteriors of about 0.02 for the other
#: domains, so shares below that would cut clean text.
TARGETS = {"clean": 0.95, "low": 0.025, "toxic": 0.025}


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that policy v1 keeps."""
    return quality_rules.keep_good(docs, "v1")


def near_duplicate_removal(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates, that with the smallest doc_id."""
    return near_duplicates.one_of_each(docs)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with secrets replaced by [SECRET]."""
    return secret_scans.redact(docs)


def mixing_to_targets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that stay in the largest mix with these weights."""
    return mixing.keep_share(docs, table(spark, sf_dir, "labels"), TARGETS)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces and their places in sequences of at most 4096 tokens."""
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"), capacity=4096, end_id=1)


STAGES = [
    ("quality rules", quality),
    ("n-gram Jaccard join", near_duplicate_removal),
    ("secret scans", secrets),
    ("mixing sources to target weights", mixing_to_targets),
    ("best-fit packing", best_fit_packing),
]

#: SQL expresses neither the field's training nor the classifier's.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages applied to documents."""
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = written(docs, f"stage{k}")
    return docs
