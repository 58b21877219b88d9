"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from . import decontam, html, jaccard, licenses, lines, mixing, quality, sql, substrings, tokens, urls
from .spark import table


def model_path(name: str = "piece_bpe_32k.model") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = licenses.scans(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_sentences", F.array_join("sentences", ",").alias("sentences"), "licence")


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.removed(table(spark, sf_dir, "documents"))


def op3_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = lines.judge(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_lines", (F.col("n_lines") - F.size("kept")).alias("n_removed"), F.array_join(F.transform("kept", lambda x: x.cast("string")), ",").alias("kept_lines"))


def op5_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    found = urls.judge(urls.captured(pages), urls.example_entries(pages))
    return found.select("page_id", "url", "fetched_at", "host", "lists", "blocked")


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("key")


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = quality.judge(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "removed_words", "kept")


def op8_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = html.extract(table(spark, sf_dir, "pages"))
    return found.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


def op9_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.classes(table(spark, sf_dir, "documents")).select("doc_id", "n_words", "class_id", "n_links", "stays")


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.counts(table(spark, sf_dir, "documents"), model_path())


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_license_scan, op2_substring_dedup, op3_source_mix, op4_line_dedup, op5_url_filter, op6_decontamination, op7_quality_rules, op8_html_extraction, op9_ngram_jaccard, op10_token_counts)}


def oracle_sql() -> dict[str, str]:
    return {
        "op2_substring_dedup": sql.SUBSTRINGS, "op3_source_mix": mixing.SQL, "op4_line_dedup": sql.LINES, "op5_url_filter": urls.SQL,
        "op6_decontamination": sql.LEAKS, "op7_quality_rules": sql.QUALITY, "op9_ngram_jaccard": sql.NEAR,
    }
