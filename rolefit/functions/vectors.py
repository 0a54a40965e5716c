"""Vector scoring: stored or TF-IDF vectors, cosine of every candidate against a vacancy block.

Candidates stay where they are and only stream through; the vacancies, which are few, travel to
them as a matrix whose size is checked first. Several vacancy sets are scored in several passes.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.broadcast import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rolefit.session import write_stage

MATRIX_BYTES = 64 << 20     # largest vacancy matrix sent to the executors at once
FEW_TERMS = 200_000         # weighted terms of all vacancies up to which they are sent to every task
VACANCIES_PER_ARRAY = 1024  # scores per output array, bounds one Arrow batch


class VacancyBlock(NamedTuple):
    """A size-checked set of vacancies: ids in order, their matrix, and what pairs need to know."""

    ids: DataFrame          # _slot, job_description_id
    shared: Broadcast       # (matrix of unit columns, minimum experience per column)
    size: int


def unit_rows(vectors: pa.Array, dim: int) -> np.ndarray:
    """List column to a float64 matrix of unit rows; missing and zero vectors become zero rows."""
    out = np.zeros((len(vectors), dim))
    present = vectors.is_valid().to_numpy(zero_copy_only=False)
    if present.any():
        flat = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
        out[present] = np.nan_to_num(flat).reshape(int(present.sum()), dim)
    norms = np.sqrt((out * out).sum(axis=1, keepdims=True))
    return np.divide(out, norms, out=np.zeros_like(out), where=norms > 0)


def percent(cosine: np.ndarray) -> np.ndarray:
    """Cosine to 0-100 with six decimals, so that summation order cannot change an ordering."""
    return np.floor(cosine * 1e8 + 0.5) / 1e6


def vacancy_blocks(jds: DataFrame, vector: str = "jd_embedding", spare_bytes: int = MATRIX_BYTES) -> Iterator[VacancyBlock]:
    """Split vacancies into blocks whose matrices fit ``spare_bytes`` and make each available to tasks.

    ``jds`` needs ``id``, the vector and ``required_experience_min``. The counts are checked before
    anything is fetched, so the driver never holds more than one block.
    """
    spark: SparkSession = jds.sparkSession
    narrow = jds.select("id", F.col(vector).alias("v"), "required_experience_min")
    facts = narrow.agg(F.count("*").alias("n"), F.max(F.size("v")).alias("dim")).first()
    dim = max(facts["dim"] or 1, 1)
    limit = max(1, spare_bytes // (8 * dim))
    passes = -(-facts["n"] // limit)
    while passes > 1:
        slot = F.pmod(F.xxhash64("id"), F.lit(passes))
        biggest = narrow.groupBy(slot).count().agg(F.max("count")).first()[0]
        if biggest <= limit:
            break
        passes += 1
    for number in range(passes):
        part = narrow if passes == 1 else narrow.where(F.pmod(F.xxhash64("id"), F.lit(passes)) == number)
        rows = part.orderBy("id").collect()
        if not rows:
            continue
        vectors = pa.array([r["v"] for r in rows], type=pa.list_(pa.float64()))
        matrix = unit_rows(vectors, dim).T.copy()
        low = np.array([r["required_experience_min"] or 0 for r in rows], dtype=np.int64)
        ids = spark.createDataFrame([(i, r["id"]) for i, r in enumerate(rows)], "_slot int, job_description_id long")
        yield VacancyBlock(ids, spark.sparkContext.broadcast((matrix, low)), len(rows))


def score_all(candidates: DataFrame, block: VacancyBlock, vector: str = "profile_embedding") -> DataFrame:
    """Every candidate with every vacancy of the block: the other columns, job id, ``semantic_score``.

    Python sees whole Arrow batches and returns one array of scores per candidate; the fan-out to
    pairs happens in the JVM.
    """
    keep = [c for c in candidates.columns if c != vector]
    schema = T.StructType([candidates.schema[c] for c in keep])
    schema = schema.add("_from", T.IntegerType()).add("_scores", T.ArrayType(T.DoubleType(), False))
    shared, where = block.shared, candidates.columns.index(vector)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matrix, _ = shared.value
        for batch in batches:
            rows = unit_rows(batch.column(where), matrix.shape[0])
            rest = [batch.column(c) for c in keep]
            for start in range(0, matrix.shape[1], VACANCIES_PER_ARRAY):
                scores = percent(rows @ matrix[:, start:start + VACANCIES_PER_ARRAY])
                ends = np.arange(len(rows) + 1, dtype=np.int32) * scores.shape[1]
                lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(scores.ravel()))
                first = pa.array(np.full(len(rows), start, dtype=np.int32))
                yield pa.RecordBatch.from_arrays([*rest, first, lists], [*keep, "_from", "_scores"])

    wide = candidates.mapInArrow(run, schema)
    pairs = wide.select(*keep, "_from", F.posexplode("_scores").alias("_at", "semantic_score"))
    return (
        pairs.withColumn("_slot", F.col("_from") + F.col("_at"))
        .join(F.broadcast(block.ids), "_slot")  # at most MATRIX_BYTES / 8 ids, checked above
        .drop("_from", "_at", "_slot")
    )


def score_best(
    candidates: DataFrame, block: VacancyBlock, top_n: int, min_score: float, vector: str = "profile_embedding"
) -> DataFrame:
    """Pairs that may be among a vacancy's best ``top_n``: eligible, at or over ``min_score``.

    ``candidates`` has ``candidate_id``, ``created_at``, ``experience_years`` and the vector. Each
    Arrow batch gives up all but its own best ``top_n`` per vacancy under the full sort key (score
    descending, newest first, smallest id), which loses nothing as a top-n of tops is the top-n.
    """
    cols = candidates.select("candidate_id", "created_at", "experience_years", F.col(vector).alias("_v"))
    schema = "candidate_id long, created_at timestamp_ntz, experience_years int, _slot int, score double"
    shared = block.shared

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matrix, low = shared.value
        for batch in batches:
            ids = batch.column("candidate_id").to_numpy()
            age = batch.column("created_at").cast(pa.int64()).fill_null(-(1 << 62)).to_numpy(zero_copy_only=False)
            order = np.lexsort((ids, -age))
            batch = batch.take(pa.array(order))
            years = batch.column("experience_years").fill_null(-1).to_numpy(zero_copy_only=False)
            rows = unit_rows(batch.column("_v"), matrix.shape[0])
            for start in range(0, matrix.shape[1], VACANCIES_PER_ARRAY):
                part = slice(start, start + VACANCIES_PER_ARRAY)
                scores = percent(rows @ matrix[:, part])
                asked = low[None, part]
                fits = (scores >= min_score) & ((asked <= 0) | (years[:, None] >= asked))
                scores = np.where(fits, scores, -np.inf)
                keep = fits
                if len(scores) > top_n:
                    nth = -np.partition(-scores, top_n - 1, axis=0)[top_n - 1]
                    above, level = scores > nth, fits & (scores == nth)
                    keep = above | (level & (np.cumsum(level, axis=0) <= top_n - above.sum(axis=0)))
                at, job = np.nonzero(keep)
                picked = batch.take(pa.array(at))
                yield pa.RecordBatch.from_arrays(
                    [picked.column("candidate_id"), picked.column("created_at"), picked.column("experience_years"),
                     pa.array((job + start).astype(np.int32)), pa.array(scores[at, job])],
                    ["candidate_id", "created_at", "experience_years", "_slot", "score"],
                )

    return cols.mapInArrow(run, schema).join(F.broadcast(block.ids), "_slot").drop("_slot")


def term_counts(texts: DataFrame) -> DataFrame:
    """(id, word, tf) of the words of whole texts, in lower case."""
    # whole texts are dealt by id once; their words, which take twice the room, are counted where they are
    texts = texts.repartition(int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions")), "id")
    words = F.explode(F.split(F.lower("text"), r"[^\p{L}\p{N}]+"))
    return texts.select("id", words.alias("word")).where("word <> ''").groupBy("id", "word").agg(F.count("*").alias("tf"))


def tfidf_cosines(people: DataFrame, jobs: DataFrame) -> DataFrame:
    """TF-IDF cosine of every candidate and vacancy (id, text) with a weighty word in common, as 0-100.

    The vocabulary is exact: words are rows, weights come from the candidates' document counts, and a product is a
    join on the word summed per pair. Pairs that share no word, or only words that every candidate has, score 0
    and are not listed.
    """
    left, right = write_stage(term_counts(people), "terms"), write_stage(term_counts(jobs), "terms")
    total = people.agg(F.count("*").alias("n"))
    seen = left.groupBy("word").agg(F.count("*").alias("df"))
    idf = F.log((F.col("n") + 1) / (F.coalesce("df", F.lit(0)) + 1))

    def weighted(terms: DataFrame) -> DataFrame:
        known = terms.join(seen, "word", "left").join(F.broadcast(total), F.lit(True))  # one row, a global count
        # what the joins below would leave out is left out here, else norms and products would each make a shuffle of their own
        return known.where("id IS NOT NULL AND word IS NOT NULL").select("id", "word", (F.col("tf") * idf).alias("w")).where("w <> 0")

    def norms(rows: DataFrame) -> DataFrame:
        # no word is empty; a norm that looks at it reads the shuffle that the products read
        return rows.groupBy("id").agg(F.sqrt(F.sum(F.when(F.col("word") != "", F.col("w") * F.col("w")))).alias("norm"))

    a, b = weighted(left), write_stage(weighted(right), "weighted-terms")
    asked = b.select(F.col("id").alias("job_description_id"), "word", F.col("w").alias("wb"))
    if b.count() <= FEW_TERMS:
        # candidates' terms are dealt by candidate and meet the vacancies' where they are: their products, which are many
        # times as many, are summed without a shuffle
        a = a.repartition(int(people.sparkSession.conf.get("spark.sql.shuffle.partitions")), "id")
        asked = F.broadcast(asked)
    pairs = a.select(F.col("id").alias("candidate_id"), "word", F.col("w").alias("wa")).join(asked, "word")
    dots = pairs.groupBy("candidate_id", "job_description_id").agg(F.sum(F.col("wa") * F.col("wb")).alias("dot"))
    named = dots.join(norms(a).select(F.col("id").alias("candidate_id"), F.col("norm").alias("na")), "candidate_id").join(
        norms(b).select(F.col("id").alias("job_description_id"), F.col("norm").alias("nb")), "job_description_id")
    return named.select("job_description_id", "candidate_id", (
        F.floor(F.col("dot") / (F.col("na") * F.col("nb")) * 1e8 + 0.5) / 1e6).alias("semantic_score"))
