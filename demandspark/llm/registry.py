"""Queries of the training-data operators with production parameters, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import corpus_pipeline
from demandspark.llm import (
    decontamination, exact_dedup, language, mixing, quality, quotations, secrets, simhash, spelling, token_counts, token_files,
    warc, whitening,
)
from demandspark.llm.tables import table

Query = Callable[[SparkSession, str], DataFrame]


def op1_quality(spark: SparkSession, sf: str) -> DataFrame:
    return quality.judged(table(spark, sf, "documents"), table(spark, sf, "labels"))


def op2_secrets(spark: SparkSession, sf: str) -> DataFrame:
    return secrets.secrets(table(spark, sf, "documents"))


def op3_quotations(spark: SparkSession, sf: str) -> DataFrame:
    return quotations.linked(table(spark, sf, "conversations"))


def op4_exact_dedup(spark: SparkSession, sf: str) -> DataFrame:
    return exact_dedup.exact_duplicates(table(spark, sf, "documents"))


def op5_language(spark: SparkSession, sf: str) -> DataFrame:
    return language.languages(table(spark, sf, "documents"))


def op6_token_files(spark: SparkSession, sf: str) -> DataFrame:
    path = public_tokenizers.path("word_bpe_49k.json")
    return token_files.with_crc32(token_files.token_table(table(spark, sf, "documents"), path, end_id=2))


def op7_token_counts(spark: SparkSession, sf: str) -> DataFrame:
    return token_counts.token_counts(table(spark, sf, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op8_mixing(spark: SparkSession, sf: str) -> DataFrame:
    return mixing.mix(table(spark, sf, "documents"))


def op9_simhash(spark: SparkSession, sf: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("simhash")), 16, "0").alias("fingerprint"), "component_id")


def op10_decontamination(spark: SparkSession, sf: str) -> DataFrame:
    found = decontamination.contamination(table(spark, sf, "documents"), table(spark, sf, "benchmark"))
    return found.drop("spans")


def op11_whitening(spark: SparkSession, sf: str) -> DataFrame:
    return whitening.whitened(table(spark, sf, "embeddings"))


def op12_spelling(spark: SparkSession, sf: str) -> DataFrame:
    return spelling.variants(table(spark, sf, "documents"))


def op13_warc(spark: SparkSession, sf: str) -> DataFrame:
    return warc.archived(table(spark, sf, "pages"))


def registered() -> dict[str, Query]:
    return {
        "op1_quality": op1_quality,
        "op2_secrets": op2_secrets,
        "op3_quotations": op3_quotations,
        "op4_exact_dedup": op4_exact_dedup,
        "op5_language": op5_language,
        "op6_token_files": op6_token_files,
        "op7_token_counts": op7_token_counts,
        "op8_mixing": op8_mixing,
        "op9_simhash": op9_simhash,
        "op10_decontamination": op10_decontamination,
        "op11_whitening": op11_whitening,
        "op12_spelling": op12_spelling,
        "op13_warc": op13_warc,
        "pipeline": corpus_pipeline.run,
    }


def statements() -> dict[str, str]:
    return {
        "op2_secrets": secrets.SECRETS_SQL,
        "op3_quotations": quotations.LINKED_SQL,
        "op4_exact_dedup": exact_dedup.EXACT_SQL,
        "op10_decontamination": decontamination.CONTAMINATION_SQL,
        "op12_spelling": spelling.VARIANTS_SQL,
        "op13_warc": warc.ARCHIVED_SQL,
    }
