"""From raw documents to packed sequences: each stage works on what the one before kept.

1. ``language_id``: documents without a recognisable language go.
2. ``line_dedup``: lines that equal, or nearly equal, an earlier line are cut out, and
   exact copies of an earlier document, which would be left without a line, go.
3. ``ngram_jaccard``: of near-duplicate documents the first stays.
4. ``decontamination``: documents that hold benchmark text go.
5. ``packing``: the rest becomes sequences of 4096 tokens.

Stages one to four return the columns of ``documents``; ``n_chars`` follows the text.
Empty tables pass through every stage.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from plumbline.llm import decontamination, jaccard_join, language_id, line_dedup, packing
from plumbline.llm.common import table
from plumbline.plans.cutting import stage

#: SQL cannot train a classifier or a packing plan; a brute-force version is in tests/llm.
ORACLE_SQL: str | None = None


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    learned = docs.where(~language_id.held_out(F.col("doc_id")))
    return language_id.keep_identified(docs, language_id.train(learned, "text", "lang", "doc_id"))


def cut_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    left = line_dedup.dedup_lines(line_dedup.without_copies(docs))
    return left.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)).select(*docs.columns)


def keep_one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return jaccard_join.keep_first_of_groups(docs)


def drop_benchmark_text(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontamination.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", identify_language),
    ("line_dedup", cut_repeated_lines),
    ("ngram_jaccard", keep_one_of_each),
    ("decontamination", drop_benchmark_text),
    ("packing", pack_sequences),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The packed pieces of ``documents``; every stage is written as Parquet and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, step in STAGES[:-1]:
        docs = stage(step(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
