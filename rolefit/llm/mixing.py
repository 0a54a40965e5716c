"""Mixing sources to target weights.

Every source is put in one random order (by a digest of the document ids) and cut into blocks of documents that are
neighbours in that order. A source's target is met by whole passes over its blocks and one partial pass; the passes
give each source an exact number of block slots. A multivariate-hypergeometric splitting tree deals the slots to
output shards: a node that stands for a range of shards draws, without replacement and for all sources at once, how
many slots of each source its left half gets, down to single shards. A shard's slots of a source are a run of the
permuted blocks, so no two shards share a block of the same pass; inside a shard documents are ordered by a digest
of their own. The draws depend on the seed and the node alone, so any task can walk to its shards and reruns agree.

Scale: blocks and documents in a block both number about the square root of a source's documents, so neither window
is large, whatever share of the rows a source has. One row per source is collected (at most ``MAX_SOURCES``,
checked) and broadcast.

Defined results: a null text has no words and is never taken; a null source is a source, ordered last; the document
at the end of a partial pass gives its first words only, so a source's taken words are its target rounded down;
rows that are equal in all columns share the passes between them; an empty table gives an empty mix.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rolefit.llm.common import WORD
from rolefit.session import write_stage

MAX_SOURCES = 100_000


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: DataFrame, most: int = 3) -> DataFrame:
    """From (source, source_size): rank, weight and target of each source.

    Weights are 1, 2, 3 and again in the order of the sources. Sources that would exceed ``most`` times their size stop
    there and the rest is shared anew; in order of limit per weight these are a first stretch of the sources.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    rising = Window.orderBy("__ratio", "rank")
    everything = Window.partitionBy(F.lit(0))
    ranked = (
        sizes.withColumn("rank", F.row_number().over(order))
        .withColumn("weight", ((F.col("rank") - 1) % 3 + 1).cast("long"))
        .withColumn("__limit", F.col("source_size") * most)
        .withColumn("__ratio", F.col("__limit") / F.col("weight"))
        .withColumn("__total", F.sum("source_size").over(everything))
        .withColumn("__below", F.coalesce(F.sum("__limit").over(rising.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
        .withColumn("__weights", F.sum("weight").over(rising.rowsBetween(0, Window.unboundedFollowing)))
        .withColumn("__full", F.col("__limit").cast("decimal(19,0)") * F.col("__weights").cast("decimal(18,0)")
                    <= F.col("weight").cast("decimal(18,0)") * (F.col("__total") - F.col("__below")).cast("decimal(19,0)"))
        .withColumn("__rest", F.col("__total") - F.coalesce(F.sum(F.when(F.col("__full"), F.col("__limit"))).over(everything), F.lit(0)))
        .withColumn("__open", F.sum(F.when(~F.col("__full"), F.col("weight"))).over(everything))
    )
    target = F.when(F.col("__full"), F.col("__limit").cast("double")).otherwise(
        (F.col("weight") * F.col("__rest")).cast("double") / F.col("__open"))
    return ranked.select("source", "source_size", "rank", "weight", target.alias("target"))


def shard_slots(counts: np.ndarray, shards: int, seed: int, wanted: range) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For the wanted shards: (shard, first slot of each source, number of slots of each source)."""
    total = int(counts.sum())

    def walk(low: int, high: int, first: np.ndarray, have: np.ndarray):
        if high <= wanted.start or low >= wanted.stop:
            return
        if high - low == 1:
            yield low, first, have
            return
        middle = (low + high) // 2
        # slots are dealt evenly: shard j ends at (j + 1) * total // shards
        left = middle * total // shards - low * total // shards
        drawn = np.random.default_rng([seed, low, high]).multivariate_hypergeometric(have, left, method="marginals")
        yield from walk(low, middle, first, drawn)
        yield from walk(middle, high, first + drawn, have - drawn)

    if total:
        yield from walk(0, shards, np.zeros_like(counts), counts)


def mix(docs: DataFrame, carry: list[str] | None = None, seed: int = 7, most: int = 3, words_per_shard: int = 5_000_000,
        source: str = "source", text: str = "text", key: str = "doc_id") -> DataFrame:
    """One row per document: ``doc`` (struct of the carried columns, all by default), ``size``, ``source_size``, ``target`` and
    ``copies``, an array of (pass, shard, words, place): the times the mix takes it, each with its output shard, the
    words taken, and its place in the shuffled shard. A document the mix leaves out has an empty array.
    """
    spark = docs.sparkSession
    base = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in carry or docs.columns]).alias("doc"),
        F.col(source).alias("source"),
        word_count(F.col(text)).alias("size"),
        F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(key).cast("string"), F.lit("")))), 1, 16).alias("turn"),
    )
    largest = docs.groupBy(F.col(source)).count().agg(F.max("count")).first()[0] or 1
    digits = max(1, round(math.log(math.sqrt(largest), 16)))
    base = base.withColumn("block", F.substring("turn", 1, digits))
    blocks = write_stage(base.groupBy("source", "block").agg(F.sum("size").alias("words")), "mix-blocks")

    sources = targets(blocks.groupBy("source").agg(F.sum("words").alias("source_size")), most).limit(MAX_SOURCES + 1).collect()
    if len(sources) > MAX_SOURCES:
        raise ValueError(f"more than {MAX_SOURCES} sources: mix by a coarser column")
    known = F.broadcast(spark.createDataFrame(
        [(r["source"], r["source_size"], r["rank"], r["target"], *_passes(r["target"], r["source_size"])) for r in sources],
        "source string, source_size long, rank int, target double, passes long, rest long"))

    within = Window.partitionBy("rank").orderBy("block")
    placed = (
        _with_source(blocks, known)
        .withColumn("before", F.coalesce(F.sum("words").over(within.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
        .withColumn("turn", F.row_number().over(within) - 1)
    )
    placed = write_stage(placed.select("rank", "block", "words", "before", "turn", "passes", "rest"), "mix-order")
    per_source = placed.groupBy("rank").agg(
        (F.count(F.lit(1)) * F.max("passes") + F.sum((F.col("before") < F.col("rest")).cast("long"))).alias("slots"),
        F.count(F.lit(1)).alias("blocks"), F.sum("words").alias("words"))
    rows = {r["rank"]: (r["slots"] if r["words"] else 0, r["blocks"]) for r in per_source.collect()}
    ranks = sorted(rows)
    counts = np.array([rows[r][0] for r in ranks], np.int64)
    shards = max(1, -(-sum(r["source_size"] for r in sources) // words_per_shard))
    slots = _slots(spark, ranks, counts, [rows[r][1] for r in ranks], shards, seed)

    dealt = (
        slots.join(placed.select("rank", "turn", "block", "before", "passes", "rest"), ["rank", "turn"])
        .groupBy("rank", "block", "before", "passes", "rest")
        .agg(F.sort_array(F.collect_list(F.struct("pass", "shard"))).alias("slots"))  # at most ``most`` + 1
    )
    inside = Window.partitionBy("rank", "block").orderBy("turn", F.xxhash64("doc"), "size").rowsBetween(Window.unboundedPreceding, -1)
    located = _with_source(base, known).withColumn("ahead", F.coalesce(F.sum("size").over(inside), F.lit(0)))
    joined = located.select("doc", "size", "source_size", "target", "rank", "block", "turn", "ahead").join(
        dealt, ["rank", "block"], "left")
    part = F.greatest(F.lit(0), F.least(F.col("size"), F.col("rest") - F.col("before") - F.col("ahead")))
    copies = F.transform(F.coalesce("slots", F.array().cast("array<struct<pass:long,shard:long>>")), lambda s: F.struct(
        s["pass"].alias("pass"), s["shard"].alias("shard"),
        F.when(s["pass"] < F.col("passes"), F.col("size")).otherwise(part).cast("long").alias("words"),
        F.xxhash64("turn", s["pass"], F.lit(seed)).alias("place")))
    return joined.select("doc", "size", "source_size", "target", F.filter(copies, lambda c: c["words"] > 0).alias("copies"))


def _passes(target: float, size: int) -> tuple[int, int]:
    """Whole passes over a source, and the words of the partial one."""
    return divmod(int(target), size) if size else (0, 0)


def _with_source(df: DataFrame, known: DataFrame) -> DataFrame:
    named = known.withColumnRenamed("source", "__source")
    return df.join(named, F.col("source").cast("string").eqNullSafe(F.col("__source"))).drop("__source")


def _slots(spark, ranks: list[int], counts: np.ndarray, blocks: list[int], shards: int, seed: int) -> DataFrame:
    """(rank, turn, pass, shard): which block of a source, in permuted order, goes to which shard in which pass."""
    def draw(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for start, stop in zip(part["start"], part["stop"]):
                for shard, first, have in shard_slots(counts, shards, seed, range(start, stop)):
                    some = np.flatnonzero(have)
                    yield pd.DataFrame({"rank": [ranks[i] for i in some], "shard": shard, "first": first[some],
                                        "n": have[some], "blocks": [blocks[i] for i in some]})

    step = 64  # shards that one walk serves
    ranges = spark.range(0, -(-shards // step)).select(
        (F.col("id") * step).alias("start"), F.least(F.lit(shards), F.col("id") * step + step).alias("stop"))
    drawn = ranges.mapInPandas(draw, "rank int, shard long, first long, n long, blocks long")
    slot = drawn.select("rank", "shard", "blocks", F.explode(F.expr("sequence(first, first + n - 1)")).alias("slot"))
    return slot.select("rank", (F.col("slot") % F.col("blocks")).cast("int").alias("turn"),
                       F.expr("slot div blocks").alias("pass"), "shard")


def mixed_rows(placed: DataFrame) -> DataFrame:
    """The mix itself from ``mix``: one row per taken copy with the document's columns, shard, place and words."""
    return placed.select("doc.*", F.explode("copies").alias("__copy"))


def mixture(docs: DataFrame) -> DataFrame:
    """Per document: its size, its source's size and target, and the words that the mix takes of it."""
    placed = mix(docs, carry=["doc_id"])
    taken = F.aggregate("copies", F.lit(0).cast("long"), lambda total, c: total + c["words"])
    return placed.select(F.col("doc.doc_id").alias("doc_id"), "size", "source_size", "target", taken.alias("taken"),
                         F.size("copies").cast("long").alias("n_copies"))


MIXTURE_SQL = r"""
WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size,
    substring(md5('7:' || doc_id), 1, 16) AS turn FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
r AS (SELECT *, row_number() OVER (ORDER BY source NULLS LAST) AS rank FROM s),
w AS (SELECT *, (rank - 1) % 3 + 1 AS weight, 3 * source_size AS most FROM r),
f AS (SELECT *, sum(source_size) OVER () AS total,
    coalesce(sum(most) OVER (ORDER BY most / weight, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below,
    sum(weight) OVER (ORDER BY most / weight, rank ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS open FROM w),
g AS (SELECT *, most::HUGEINT * open <= weight::HUGEINT * (total - below) AS capped FROM f),
h AS (SELECT *, total - coalesce(sum(most) FILTER (WHERE capped) OVER (), 0) AS rest, sum(weight) FILTER (WHERE NOT capped) OVER () AS shared FROM g),
t AS (SELECT source, source_size, CASE WHEN capped THEN most::DOUBLE ELSE (weight * rest)::DOUBLE / shared END AS target FROM h),
q AS (SELECT d.doc_id, d.size, t.source_size, t.target, floor(t.target)::BIGINT AS quota,
    coalesce(sum(size) OVER (PARTITION BY d.source ORDER BY turn, d.doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS ahead
    FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target, taken,
    CASE WHEN size = 0 THEN 0 ELSE (taken + size - 1) // size END AS n_copies
FROM (SELECT *, CASE WHEN source_size = 0 THEN 0 ELSE quota // source_size * size
    + greatest(0, least(size, quota % source_size - ahead)) END AS taken FROM q)
"""
