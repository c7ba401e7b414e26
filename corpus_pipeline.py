"""The corpus pipeline: quality rules, near-duplicates, secrets, mixing, BPE.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, written as Parquet and reread as the next one's docs.
All but the last return the columns of documents.

Every stage takes null texts, ids and sources, empty and very long texts, repeated rows, empty tables and extra columns
(which pass through). What each does with them is stated in its operator's docstring and, in short, at the stage.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from sheafspark.llm import bpe, mixing, near, quality_rules, secrets
from sheafspark.llm.common import stored, table


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Failing lines go, and documents that are rejected: those without a word (null and empty texts too), that repeat
    themselves, or that lose over half their word characters. Repeated rows are judged each by themselves."""
    return quality_rules.clean(docs)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates (5-word Jaccard 0.8 or more) stays, that of the smallest doc_id.

    Rows of one doc_id are told apart by their texts, and equal rows come back once; a null doc_id gives way to others.
    """
    return near.deduplicated(docs)


def secret_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are replaced by a mark; rows without any, null texts too, stay as they are."""
    return secrets.redacted(docs)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents are repeated or left out so that sources reach their target weights; null is a source of its own.

    Documents without words go. Rows of one doc_id are documents of their own.
    """
    return mixing.mixed(docs)


def encoding_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, source, n_tokens, the ids and the digests of the ids and of the text decoded from them, a row a document."""
    return bpe.encoded(docs.select("doc_id", "source", "text")).drop("text")


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_rules", quality_stage),
    ("near_duplicates", near_duplicate_stage),
    ("secrets", secret_stage),
    ("mixing", mixing_stage),
    ("bpe", encoding_stage),
]

#: No SQL states near-duplicate components or BPE. Tests in tests/llm: test_quality_lines, test_near, test_secret_values,
#: test_mixing_order and test_llm_operators (BPE against the tokenizers library), each against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {"pipeline": run}


def oracle_sql() -> dict[str, str]:
    return {"pipeline": ORACLE_SQL} if ORACLE_SQL else {}
