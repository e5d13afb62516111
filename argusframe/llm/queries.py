"""One query for each corpus operator, over the whole table, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

import corpus_pipeline
import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from argusframe.llm import byte_cnn, lexical_search, ngram_join, oracles, packing, piece_codec, sanitize, sharding, sketches, source_mix, spelling, substring_dedup, text_cnn
from argusframe.llm import quality_rules as rules
from argusframe.llm.common import benchmark, documents, labels


def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.best_fit_packing(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"))


def op2_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.ngram_jaccard_join(documents(spark, sf_dir))


def op3_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.vector_sharding(documents(spark, sf_dir))


def op4_sanitize(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sanitize.sanitize_digests(documents(spark, sf_dir))


def op5_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return byte_cnn.quality_classifier(documents(spark, sf_dir), labels(spark, sf_dir))


def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.substring_dedup_digests(documents(spark, sf_dir))


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.quality_rules(documents(spark, sf_dir))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return text_cnn.toxicity_classifier(documents(spark, sf_dir), labels(spark, sf_dir))


def op8_sketches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sketches.document_fingerprints(documents(spark, sf_dir))


def op10_piece_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    return piece_codec.codec_digests(documents(spark, sf_dir), public_tokenizers.path("piece_bpe_32k.model"))


def op11_spelling_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.spelling_groups(documents(spark, sf_dir))


def op12_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source_mix.mix_counts(documents(spark, sf_dir))


def op13_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical_search.lexical_search(documents(spark, sf_dir), benchmark(spark, sf_dir))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_best_fit_packing": op1_best_fit_packing,
    "op2_ngram_join": op2_ngram_join,
    "op3_sharding": op3_sharding,
    "op4_sanitize": op4_sanitize,
    "op5_quality_classifier": op5_quality_classifier,
    "op6_substring_dedup": op6_substring_dedup,
    "op7_toxicity": op7_toxicity,
    "op8_sketches": op8_sketches,
    "op9_quality_rules": op9_quality_rules,
    "op10_piece_codec": op10_piece_codec,
    "op11_spelling_groups": op11_spelling_groups,
    "op12_source_mix": op12_source_mix,
    "op13_lexical_search": op13_lexical_search,
    "pipeline": corpus_pipeline.run,
}
ORACLES: dict[str, str] = {**oracles.ORACLES, **({"pipeline": corpus_pipeline.ORACLE_SQL} if corpus_pipeline.ORACLE_SQL else {})}
