"""One registered query per operator of this subpackage, and the checking SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from rolefit.llm.bpe import digests
from rolefit.llm.common import table
from rolefit.llm.langid import languages
from rolefit.llm.lines import LINES_SQL, line_report
from rolefit.llm.merkle import MANIFEST_SQL, manifest_report
from rolefit.llm.mixing import MIXTURE_SQL, mixture
from rolefit.llm.near import NEAR_SQL, classes
from rolefit.llm.passages import PASSAGES_SQL, passage_report
from rolefit.llm.quality import QUALITY_SQL, quality_report
from rolefit.llm.repeats import repeat_report
from rolefit.llm.runs import RUNS_SQL, run_report
from rolefit.llm.token_counts import masked_counts
from rolefit.llm.token_files import token_report
from rolefit.llm.topk import NEAREST_SQL, nearest


def op1_line_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return line_report(table(spark, folder, "documents"))


def op2_byte_bpe(spark: SparkSession, folder: str) -> DataFrame:
    return digests(table(spark, folder, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def op3_token_counts(spark: SparkSession, folder: str) -> DataFrame:
    return masked_counts(table(spark, folder, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def op4_token_files(spark: SparkSession, folder: str) -> DataFrame:
    return token_report(table(spark, folder, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op5_language_id(spark: SparkSession, folder: str) -> DataFrame:
    return languages(table(spark, folder, "documents"))


def op6_source_mix(spark: SparkSession, folder: str) -> DataFrame:
    return mixture(table(spark, folder, "documents"))


def op7_top_k(spark: SparkSession, folder: str) -> DataFrame:
    return nearest(table(spark, folder, "embeddings"))


def op8_near_duplicates(spark: SparkSession, folder: str) -> DataFrame:
    return classes(table(spark, folder, "documents"))


def op9_quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    return quality_report(table(spark, folder, "documents"))


def op10_repeated_passages(spark: SparkSession, folder: str) -> DataFrame:
    return repeat_report(table(spark, folder, "documents"))


def op11_periodic_runs(spark: SparkSession, folder: str) -> DataFrame:
    return run_report(table(spark, folder, "documents"))


def op12_merkle_manifest(spark: SparkSession, folder: str) -> DataFrame:
    return manifest_report(table(spark, folder, "documents"))


def op13_substring_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return passage_report(table(spark, folder, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (
    op1_line_dedup, op2_byte_bpe, op3_token_counts, op4_token_files, op5_language_id, op6_source_mix, op7_top_k,
    op8_near_duplicates, op9_quality_rules, op10_repeated_passages, op11_periodic_runs, op12_merkle_manifest,
    op13_substring_dedup)}
ORACLES: dict[str, str] = {
    "op1_line_dedup": LINES_SQL,
    "op6_source_mix": MIXTURE_SQL,
    "op7_top_k": NEAREST_SQL,
    "op8_near_duplicates": NEAR_SQL,
    "op9_quality_rules": QUALITY_SQL,
    "op11_periodic_runs": RUNS_SQL,
    "op12_merkle_manifest": MANIFEST_SQL,
    "op13_substring_dedup": PASSAGES_SQL,
}
