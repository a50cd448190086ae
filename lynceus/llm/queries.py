"""Registered queries of the training-data operators: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from lynceus.llm import (
    alignment, decontaminate, html_text, katz, line_dedup, mixing, near_dup, prefix_trie, repetition, secrets, suffix_dedup,
    toxicity, warc)
from lynceus.llm.common import table
from lynceus.llm.oracles import ORACLES

__all__ = ["ORACLES", "REGISTRY"]


def op1_katz_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return katz.op1(table(spark, sf_dir, "documents"))


def op2_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.op2(table(spark, sf_dir, "documents"))


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.op3(table(spark, sf_dir, "documents"))


def op4_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dup.op4(table(spark, sf_dir, "documents"))


def op5_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.op5(table(spark, sf_dir, "pages"))


def op6_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.op6(table(spark, sf_dir, "documents"))


def op7_repetition_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repetition.op7(table(spark, sf_dir, "documents"))


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.op8(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op9_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.op9(table(spark, sf_dir, "documents"))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.op10(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.op11(table(spark, sf_dir, "conversations"))


def op12_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.op12(table(spark, sf_dir, "pages"))


def op13_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.op13(table(spark, sf_dir, "documents"))


REGISTRY: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (
        op1_katz_scores, op2_secret_scan, op3_line_dedup, op4_near_duplicates, op5_html_extraction, op6_source_mix, op7_repetition_rules, op8_decontamination,
        op9_suffix_dedup, op10_toxicity, op11_prefix_trie, op12_warc, op13_token_alignment)}
