"""The queries of this subpackage for the driver entry: name -> (spark, sf_dir) -> DataFrame, and their DuckDB SQL where there is any."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontam, jaccard_join, line_dedup, lm, mixing, quality, secrets, suffix_dedup, token_output, toxicity
from .common import documents, load, public_vocabulary

#: Target weights of the sources in op9 and the pipeline; any other source shares weight 1.
MIX_WEIGHTS = {f"src{i}": 1 + i % 4 for i in range(20)}

#: Edits by which near lines differ at most in op4: a swapped word is two or three.
LINE_EDITS = 3


def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.digest(secrets.find_secrets(documents(spark, sf_dir)))


def op2_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.suffix_dedup(documents(spark, sf_dir))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(documents(spark, sf_dir), load(spark, sf_dir, "labels"))


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_lines, n_exact, n_near and n_kept of each document."""
    return line_dedup.line_dedup(documents(spark, sf_dir), LINE_EDITS)


def op5_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.jaccard_components(documents(spark, sf_dir))


def op6_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_output.token_output(documents(spark, sf_dir), public_vocabulary("byte_bpe_50k.json"))


def op7_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All n-grams are kept, those seen once too."""
    return lm.lm_scores(documents(spark, sf_dir), least=1)


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents that hold a benchmark item: doc_id, item_ids, max_similarity."""
    links = decontam.find_contamination(documents(spark, sf_dir), load(spark, sf_dir, "benchmark"))
    return links.groupBy("doc_id").agg(F.array_sort(F.collect_set("item_id")).alias("item_ids"), F.max("similarity").alias("max_similarity"))


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "source")
    return mixing.mix_sources(docs, MIX_WEIGHTS).select("doc_id", "source", F.col("_mix_source").alias("mix_source"), F.col("_mix_block").alias("mix_block"), F.col("_mix_slot").alias("mix_slot"), F.col("_mix_position").alias("mix_position"))


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_rules(documents(spark, sf_dir)).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "n_lines", "host_rejected")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_secret_scan": op1_secret_scan,
    "op2_suffix_dedup": op2_suffix_dedup,
    "op3_toxicity": op3_toxicity,
    "op4_line_dedup": op4_line_dedup,
    "op5_jaccard_join": op5_jaccard_join,
    "op6_token_output": op6_token_output,
    "op7_lm_scoring": op7_lm_scoring,
    "op8_decontamination": op8_decontamination,
    "op9_mixing": op9_mixing,
    "op10_quality_rules": op10_quality_rules,
}

ORACLE_SQL: dict[str, str] = {
    "op9_mixing": mixing.oracle(MIX_WEIGHTS),
    "op10_quality_rules": quality.oracle(),
}
