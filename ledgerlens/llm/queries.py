"""The registered queries of this package: one per operator, on its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlens.llm.chat import render
from ledgerlens.llm.common import table
from ledgerlens.llm.decontaminate import contamination
from ledgerlens.llm.hard_negatives import hard_negatives
from ledgerlens.llm.html_wrapper import main_text
from ledgerlens.llm.lm_score import lm_scores
from ledgerlens.llm.lsh_forest import near_copies
from ledgerlens.llm.merkle import verified_manifest
from ledgerlens.llm.packing import pack
from ledgerlens.llm.quality_model import quality_scores
from ledgerlens.llm.quality_rules import judge
from ledgerlens.llm.simhash import near_duplicates
from ledgerlens.llm.sql import OP6_SQL, OP7_SQL, OP8_SQL, OP11_SQL, OP12_SQL, OP13_SQL
from ledgerlens.llm.substring_dedup import removal_report
from ledgerlens.llm.url_filter import judge_urls


def op1_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_urls(table(spark, sf_dir, "pages"))


def op2_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_scores(table(spark, sf_dir, "documents"))


def op3_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op4_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


def op5_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return main_text(table(spark, sf_dir, "pages"))


def op6_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    return render(table(spark, sf_dir, "conversations"))


def op7_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "documents"))


def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return removal_report(table(spark, sf_dir, "documents"))


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))


def op11_lsh_forest_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_copies(table(spark, sf_dir, "documents"))


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return verified_manifest(table(spark, sf_dir, "documents"))


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives(table(spark, sf_dir, "embeddings"), F.col("id") % 100 == 0, label=moved)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (
        op1_url_filter, op2_lm_scoring, op3_quality_classifier, op4_simhash_near_dedup,
        op5_html_extraction, op6_chat_formatting, op7_benchmark_decontamination, op8_quality_rules,
        op9_substring_dedup, op10_packing, op11_lsh_forest_near_dedup,
        op12_merkle_manifest, op13_hard_negatives)}

#: SQL checks; the others are tested against brute force in tests/llm.
ORACLES: dict[str, str] = {
    "op6_chat_formatting": OP6_SQL, "op7_benchmark_decontamination": OP7_SQL, "op8_quality_rules": OP8_SQL,
    "op11_lsh_forest_near_dedup": OP11_SQL, "op12_merkle_manifest": OP12_SQL,
    "op13_hard_negatives": OP13_SQL}
