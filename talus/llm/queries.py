"""The driver's queries over the operators of this subpackage: thin digests over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from talus.llm import decontam, html, langid, lmscore, quality, seed_extend, simhash, spm, suffix_dedup, tokencount


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontam.decontaminate(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"), with_text=False)
    return decontam.digest(found)


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(_table(spark, sf_dir, "documents"))


def op3_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.extract(_table(spark, sf_dir, "pages"))


def op4_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lmscore.score(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op5_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = suffix_dedup.repeats(_table(spark, sf_dir, "documents"), with_bytes=False)
    return found.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(_table(spark, sf_dir, "documents"))


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    pieces = tokencount.unigram_pieces(public_tokenizers.path("piece_bpe_32k.model"))
    return tokencount.token_counts(_table(spark, sf_dir, "documents"), pieces)


def op9_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = seed_extend.repeats(_table(spark, sf_dir, "documents"), with_text=False)
    return found.select("doc_id", "n_words", "n_removed", "kept_sha256")


def op10_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    coded = spm.encode(_table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"), with_ids=False)
    return coded.select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_decontamination, op2_language_id, op3_html_extraction, op4_lm_scoring, op5_suffix_dedup, op6_quality_rules, op7_simhash, op8_token_counts, op9_substrings, op10_sentencepiece)}


def oracle_sql() -> dict[str, str]:
    from talus.llm import oracles

    return oracles.SQL
