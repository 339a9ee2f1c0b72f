"""One query per operator, over whole tables, and SQL twins where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from plumbline.llm import filter_audit, hard_negatives, jaccard_join, language_model, line_dedup, quality, secret_scan, suffix_dedup
from plumbline.llm.common import table
from plumbline.llm.decontamination import contamination
from plumbline.llm.html_text import extract
from plumbline.llm.language_id import identify
from plumbline.llm.packing import pack
from plumbline.llm.token_counts import count_tokens

CATALOG: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(f):
    CATALOG[f.__name__] = f
    return f


@query
def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.line_report(table(spark, sf_dir, "documents"))


SQL["op1_line_dedup"] = line_dedup.oracle()


@query
def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality(table(spark, sf_dir, "documents"))


SQL["op2_quality_rules"] = quality.oracle()


@query
def op3_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


@query
def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query
def op5_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"))


@query
def op6_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.removal_report(table(spark, sf_dir, "documents"), keep_first=False)


@query
def op7_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.scan(table(spark, sf_dir, "documents"))


@query
def op8_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.near_duplicates(table(spark, sf_dir, "documents")).drop("key")


SQL["op8_ngram_jaccard_join"] = jaccard_join.oracle()


@query
def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


@query
def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify(table(spark, sf_dir, "documents"))


@query
def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


SQL["op11_filter_audit"] = filter_audit.oracle()


@query
def op12_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    scores = language_model.score_all(table(spark, sf_dir, "documents"))
    rounded = {c: F.round(c, 6) for c in ("base_score", "score")}  # sums differ in the last places by their order
    return scores.withColumns(rounded).drop("perplexity")


SQL["op12_lm_scoring"] = language_model.oracle()


@query
def op13_hard_negative_mining(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hard_negatives.of_embeddings(table(spark, sf_dir, "embeddings"))


SQL["op13_hard_negative_mining"] = hard_negatives.oracle()
