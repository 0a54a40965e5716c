"""From raw documents to token ids: five stages, each written as Parquet and read again by the next."""

from __future__ import annotations

from decimal import Decimal

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rolefit.llm.bpe import encode_and_decode
from rolefit.llm.common import table, words_of
from rolefit.llm.langid import UNKNOWN, learned_from, predict
from rolefit.llm.lines import dedup_lines
from rolefit.llm.mixing import mix
from rolefit.llm.near import near_duplicates
from rolefit.session import write_stage

#: Documents whose language is less certain than this are rejected.
LEAST_SCORE = 0.4
#: Column that tells rows apart.
ROW = "__row"


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a recognised language; texts that are null or without a letter and uncertain ones go.

    Each row is judged by its text alone: ids may be null or repeat, repeated rows get the same verdict, all columns pass.
    """
    found = predict(docs.select(F.struct(*docs.columns).alias("doc"), "text"), learned_from(docs), ("doc",))
    return found.where((F.col("lang_pred") != UNKNOWN) & (F.col("lang_score") >= LEAST_SCORE)).select("doc.*")


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without repeated lines; one that has no word left (null and empty texts too) has nothing to give and goes.

    Lines are ordered by doc_id, null first, then by place; rows equal in id and text are one document and get one verdict.
    """
    left = dedup_lines(docs).where(F.col("kept").rlike(r"[^\x20\x09-\x0D]"))
    return _with_text(left, docs, F.col("kept"))


def near_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: the one of the smallest id, a null id last, then by digest of the row.

    Rows are told apart by id and content, so nulls, repeated ids and clashing names do no harm; equal rows are one document.
    """
    keyed = docs.withColumn(ROW, _row_key(docs))
    leads = near_duplicates(keyed, key=ROW).where(F.col("id") == F.col("class_id")).groupBy("id").agg(F.count(F.lit(1)).alias("n"))
    leads = write_stage(leads, "leads")
    kept = keyed.join(leads.select(F.col("id").alias(ROW)), ROW, "left_semi")
    repeated = leads.where("n > 1").limit(1).count() > 0  # equal rows
    return (kept.dropDuplicates([ROW]) if repeated else kept).select(docs.columns)


def _row_key(docs: DataFrame) -> Column:
    """A text that sorts like doc_id, nulls last, and differs between different rows."""
    digest = F.sha2(F.to_json(F.struct(*[F.col(f"`{c}`") for c in docs.columns])), 256)
    number = F.lpad((F.col("doc_id").cast("decimal(20,0)") + F.lit(Decimal(2**63))).cast("string"), 21, "0")
    return F.concat(F.coalesce(number, F.lit("~")), F.lit("-"), digest)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix: a row per taken copy, shard by shard and shuffled inside; a copy taken in part has its first words.

    A null source is a source; ids may be null or repeat; a text without words takes no place in the mix.
    """
    copies = mix(docs).select("doc", "size", F.explode("copies").alias("copy"))
    part = F.array_join(F.slice(words_of(F.col("doc.text")), 1, F.col("copy.words").cast("int")), " ")
    text = F.when(F.col("copy.words") == F.col("size"), F.col("doc.text")).otherwise(part)
    shards = int(spark.conf.get("spark.sql.shuffle.partitions"))
    placed = copies.withColumn("kept", text).repartition(shards, "copy.shard").sortWithinPartitions("copy.shard", "copy.place")
    return _with_text(placed, docs, F.col("kept"))


def byte_bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every copy, and whether they decode to its text; a null text has none, one row per row."""
    path, pattern = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
    marked = docs.withColumn("digest", F.sha2("text", 256))
    both = encode_and_decode(marked, path, pattern, keep=("doc_id", "lang", "source", "digest"))
    return both.select("doc_id", "lang", "source", F.expr("length(ids) div 4").cast("long").alias("n_tokens"), "ids",
                       (F.sha2("decoded", 256) == F.col("digest")).alias("round_trip"))


def _with_text(df: DataFrame, docs: DataFrame, text) -> DataFrame:
    """The columns of ``docs`` out of the struct ``doc``, with another text and its number of characters."""
    new = {"text": text, "n_chars": F.length(text).cast("long")}
    return df.select(*[new[c].alias(c) if c in new else F.col("doc")[c].alias(c) for c in docs.columns])


STAGES = [
    ("language_id", language_id),
    ("line_dedup", line_dedup),
    ("near_join", near_join),
    ("source_mix", source_mix),
    ("byte_bpe", byte_bpe),
]
#: The language model has no SQL form; tests/llm holds the stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents; the table between two stages is Parquet in the shared folder."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = write_stage(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
