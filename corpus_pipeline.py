"""The corpus pipeline: quality rules, near-duplicate removal, substring dedup, sanitisation and packing.

Every stage works on all that the one before it kept; what it decides is in the rows it returns. All of them give an empty
result for an empty table, read only doc_id, text and lang, and pass other columns of the documents on as they are.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from argusframe.llm.common import documents, store
from argusframe.llm.ngram_join import one_of_each_group
from argusframe.llm.packing import best_fit_packing
from argusframe.llm.quality_rules import good_documents
from argusframe.llm.sanitize import sanitize
from argusframe.llm.substring_dedup import substring_dedup


def _counted(docs: DataFrame) -> DataFrame:
    """``docs`` with n_chars as the texts are now."""
    return docs.withColumn("n_chars", F.char_length("text").cast("long")) if "n_chars" in docs.columns else docs


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules reject go: with them null, blank and very short texts. Repeated rows are judged one by one and alike."""
    return good_documents(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of linked documents the one with the smallest doc_id stays. Texts without words are linked with nothing and stay, as do rows
    without doc_id; of rows that repeat a doc_id those of the document that stays are kept."""
    return one_of_each_group(docs)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages that occur earlier go from the texts, and n_chars is counted anew. Null texts and texts of fewer than 20 words stay as they are; a text that is
    all repeats becomes empty and its row stays; rows alike in doc_id and text are one document, different texts of one doc_id are two."""
    return _counted(substring_dedup(docs))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data and terms that give it away are generalised in the texts, and n_chars is counted anew. Null and empty texts stay; copies and
    repeated rows come out alike and are no evidence for each other."""
    return _counted(sanitize(docs))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts are tokenized and packed into sequences. A null or empty text is a piece of its end id alone; repeated rows are packed each."""
    return best_fit_packing(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_rules", quality_rules),
    ("near_duplicates", near_duplicates),
    ("repeated_passages", repeated_passages),
    ("personal_data", personal_data),
    ("packing", packing),
]

#: Near duplicates are connected components and sequences come from a greedy algorithm, which SQL can't express.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole table of documents, each written and read again."""
    docs = documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = store(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
