"""The operators as named queries over a folder of tables, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from costurero.llm import (
    bytes_dedup, contamination, fill_middle, html_main, lines, packing, passages, pii, quality, simhash, toxicity, turns, url_filter,
)
from costurero.llm.common import prepare, table
from costurero.llm.oracle import ORACLE_SQL as ORACLE_SQL


def op1_main_text(spark: SparkSession, folder: str) -> DataFrame:
    """Main text of every page."""
    return html_main.extract(table(spark, folder, "pages"))


def op2_packing(spark: SparkSession, folder: str) -> DataFrame:
    """Every document's tokens packed into sequences."""
    return packing.pack(table(spark, folder, "documents"))


def op3_simhash(spark: SparkSession, folder: str) -> DataFrame:
    """Fingerprint and near-duplicate component of every document."""
    return simhash.near_duplicates(table(spark, folder, "documents"))


def op4_quality(spark: SparkSession, folder: str) -> DataFrame:
    """Surface counts and the verdict of the n-gram ratio for every document."""
    return quality.report(table(spark, folder, "documents"), table(spark, folder, "labels"))


def op5_lines(spark: SparkSession, folder: str) -> DataFrame:
    """Recurring lines dropped from every document."""
    return lines.report(table(spark, folder, "documents"))


def op6_suffix_array(spark: SparkSession, folder: str) -> DataFrame:
    """Bytes of strings of 400 that occur again anywhere, removed from every document."""
    return bytes_dedup.report(table(spark, folder, "documents"))


def op7_passages(spark: SparkSession, folder: str) -> DataFrame:
    """Windows of fifty words that a document with a smaller doc_id has too, removed from every document."""
    return passages.report(table(spark, folder, "documents"))


def op8_contamination(spark: SparkSession, folder: str) -> DataFrame:
    """Benchmark windows found in every document."""
    return contamination.report(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


def op9_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    """Score of every document, learned from the labelled ones."""
    prepare(spark)
    return toxicity.detect(table(spark, folder, "documents"), table(spark, folder, "labels"))


def op10_surrogates(spark: SparkSession, folder: str) -> DataFrame:
    """Every document with surrogates for the personal data in it; a deployment passes a secret key of its own."""
    return pii.surrogates(table(spark, folder, "documents"), b"costurero")


def op11_url_filter(spark: SparkSession, folder: str) -> DataFrame:
    """Rule and verdict of every page's URL."""
    return url_filter.report(table(spark, folder, "pages"))


def op12_fill_middle(spark: SparkSession, folder: str) -> DataFrame:
    """Every document cut for fill-in-the-middle training, as digests."""
    return fill_middle.report(table(spark, folder, "documents"))


def op13_turn_repair(spark: SparkSession, folder: str) -> DataFrame:
    """Faults and cheapest repair of every conversation, after damage."""
    return turns.damage_report(table(spark, folder, "conversations"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_main_text": op1_main_text,
    "op2_packing": op2_packing,
    "op3_simhash": op3_simhash,
    "op4_quality": op4_quality,
    "op5_lines": op5_lines,
    "op6_suffix_array": op6_suffix_array,
    "op7_passages": op7_passages,
    "op8_contamination": op8_contamination,
    "op9_toxicity": op9_toxicity,
    "op10_surrogates": op10_surrogates,
    "op11_url_filter": op11_url_filter,
    "op12_fill_middle": op12_fill_middle,
    "op13_turn_repair": op13_turn_repair,
}
