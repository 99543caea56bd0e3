"""The registered queries of this subpackage: one per operator, over whole tables, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from arbora.llm import oracle
from arbora.llm.decontaminate import leaks
from arbora.llm.html_extract import extract_pages
from arbora.llm.jaccard_join import Spec, jaccard_classes
from arbora.llm.license_scan import license_scan
from arbora.llm.line_dedup import line_dedup
from arbora.llm.quality_classifier import quality_classifier
from arbora.llm.quality_rules import quality_rules
from arbora.llm.sentencepiece_codec import encode_documents
from arbora.llm.source_divergence import source_divergence
from arbora.llm.spelling import spelling_variants
from arbora.llm.suffix_dedup import suffix_dedup
from arbora.llm.toxicity import toxicity
from arbora.llm.warc_store import warc_round_trip


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_pages(table(spark, sf_dir, "pages"))


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"
    )


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("text_hash")


def op4_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_classifier(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op5_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup(table(spark, sf_dir, "documents")).drop("kept")


def op6_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_documents(table(spark, sf_dir, "documents"))


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup(table(spark, sf_dir, "documents"))


def op8_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = jaccard_classes(table(spark, sf_dir, "documents"), Spec(words=3, num=90, den=100))
    return found.select("doc_id", "n_shingles", "component_id")


def op9_license_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan(table(spark, sf_dir, "documents")).drop("spans")


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc_round_trip(table(spark, sf_dir, "pages"))


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling_variants(table(spark, sf_dir, "documents"))


def op12_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source_divergence(table(spark, sf_dir, "documents"))


def op13_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_html_extraction,
        op2_quality_rules,
        op3_decontamination,
        op4_quality_classifier,
        op5_suffix_dedup,
        op6_sentencepiece,
        op7_line_dedup,
        op8_jaccard_join,
        op9_license_scans,
        op10_warc,
        op11_spelling_variants,
        op12_source_divergence,
        op13_toxicity,
    )
}

ORACLE_SQL: dict[str, str] = dict(oracle.SQL)
