"""From raw documents to token files: quality, near-duplicates, decontamination, mixing, token ids.

Every stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame. All but the last return the columns
of ``documents``. Decisions are those of rows, not of ids: quality and contamination follow from a row's
text alone, near-duplicates are told apart by a hash of all columns. No stage copies its input.

* quality: documents scored below 0.3 go.
* near_dedup: of each component of linked fingerprints one row stays, that with the smallest id (rows
  without an id come last); of several such rows the one with the smallest hash of all columns.
* decontaminate: documents with words inside a benchmark window go.
* mix: every document appears once for each pass of its source that takes some of it.
* tokens: ids of every row in ascending order of ``doc_id``, as read back from the written files.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from demandspark.llm import decontamination, mixing, quality, simhash, token_files
from demandspark.llm.tables import join_spread, stored, table

TOKENIZER = public_tokenizers.path("word_bpe_49k.json")
END_ID = 2


LEAST_SCORE = 0.3


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = quality.fit(docs, table(spark, sf_dir, "labels"), quality.HELD_OUT)
    return quality.passing(docs, model, LEAST_SCORE)


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    mark = F.xxhash64(*docs.columns)  # rows with one mark are equal; one of these stays below
    number = F.col("doc_id").cast("long")
    marks = simhash.fingerprints(docs.select(mark.alias("doc_id"), "text"))
    found = simhash.linked_classes(marks)
    rows = docs.select(mark.alias("mark"), number.alias("number")).groupBy("mark").agg(F.min("number").alias("number"), F.count(F.lit(1)).alias("n"))
    distinct = stored(marks.select(F.col("doc_id").alias("mark"), "simhash").distinct().join(rows, "mark"), "marks")
    ranked = stored(join_spread(distinct, found, "simhash"), "ranked")
    rank = F.struct(F.col("number").isNull().alias("last"), "number", "mark")
    best = ranked.groupBy("component_id").agg(F.min(rank).alias("best"))
    best = stored(best.select(F.col("best.mark").alias("mark")), "kept")
    gone = stored(ranked.select("mark").join(best, "mark", "left_anti").select(F.col("mark").alias("_gone")), "gone")
    again = stored(ranked.where("n > 1").select("mark").join(best, "mark", "left_semi").select(F.col("mark").alias("_again")), "again")
    kept = docs.join(gone, mark == F.col("_gone"), "left_anti")
    once = kept.join(again, mark == F.col("_again"), "left_anti")
    return once.unionByName(kept.join(again, mark == F.col("_again"), "left_semi").dropDuplicates())


def decontaminate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    text = F.xxhash64("text")
    found = decontamination.contamination(docs.select(text.alias("doc_id"), "text"), table(spark, sf_dir, "benchmark"))
    gone = stored(found.where("contaminated").select(F.col("doc_id").alias("_gone")).distinct(), "contaminated")
    return docs.join(gone, text == F.col("_gone"), "left_anti")


def mix_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    rows = mixing.mixed(docs)
    return rows.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else rows


def token_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return token_files.token_table(docs, TOKENIZER, END_ID)


STAGES = [
    ("quality", quality_stage),
    ("near_dedup", near_dedup_stage),
    ("decontaminate", decontaminate_stage),
    ("mix", mix_stage),
    ("tokens", token_stage),
]

#: Compression, XXH64 fingerprints, hashed draws and tokenizers are beyond SQL; see tests/llm.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result is stored before the next stage reads it."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
