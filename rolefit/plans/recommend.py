"""Recommendation: the best known candidates for each vacancy, with a readable reason."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rolefit.functions import scoring, text
from rolefit.functions.vectors import score_best, vacancy_blocks


def recommendation_pool(
    candidates: DataFrame, results: DataFrame | None, exclude_rejected: bool = True
) -> DataFrame:
    """Canonical candidates with any profile text who were never rejected.

    An empty profile is left out whatever its stored vector scores; a stored ``has_profile`` spares reading the
    texts. The exclusion is an explicit anti join: ``NOT IN`` would plan a broadcast-only null-aware join.
    """
    pool = text.with_text_flags(candidates).where(~F.col("is_duplicate") & F.col("has_profile"))
    if exclude_rejected and results is not None:
        rejected = results.where(F.col("status") == "rejected").select(F.col("candidate_id").alias("id"))
        pool = pool.join(rejected.distinct(), "id", "left_anti")
    return pool


def recommend(
    candidates: DataFrame, jds: DataFrame, results: DataFrame | None = None,
    top_n: int = 10, min_score: float = 50.0, exclude_rejected: bool = True,
) -> DataFrame:
    """Best ``top_n`` candidates per vacancy at or over ``min_score``.

    Order is score, then newest, then smallest id. Every task first keeps its own best, so the
    ranking shuffle carries at most ``top_n`` rows per vacancy and batch.
    """
    described = jds.where(F.col("description") != "")
    pool = recommendation_pool(candidates, results, exclude_rejected).select(
        F.col("id").alias("candidate_id"), "created_at", "experience_years", "profile_embedding")
    blocks = [score_best(pool, block, top_n, min_score) for block in vacancy_blocks(described)]
    if not blocks:
        raise ValueError("no vacancy has a description")
    best_first = Window.partitionBy("job_description_id").orderBy(
        F.desc("score"), F.desc("created_at"), F.asc("candidate_id"))
    top = (
        reduce(DataFrame.unionByName, blocks)
        .withColumn("rank_position", F.row_number().over(best_first))
        .where(F.col("rank_position") <= top_n)
    )
    wanted = described.select(
        F.col("id").alias("job_description_id"), F.col("required_experience_min").alias("low"),
        text.skill_set(F.col("required_skills")).alias("wanted"))
    offered = candidates.select(F.col("id").alias("candidate_id"), text.skill_set(F.col("skills")).alias("offered"))
    reason = scoring.match_reason(F.col("score"), F.col("low"), F.col("experience_years"), F.col("wanted"), F.col("offered"))
    return (
        top.join(wanted, "job_description_id").join(offered, "candidate_id")
        .select("job_description_id", "candidate_id", "rank_position",
                F.col("score").alias("recommendation_score"),
                scoring.round2(F.col("score")).alias("score"),
                reason.alias("match_reasoning"))
    )


def recommendation_summary(
    candidates: DataFrame, jds: DataFrame, recommended: DataFrame, results: DataFrame | None = None, exclude_rejected: bool = True
) -> DataFrame:
    """One row per vacancy: candidates evaluated, recommendations kept, and why there are none."""
    pool = recommendation_pool(candidates, results, exclude_rejected).agg(F.count("*").alias("evaluated"))
    kept = recommended.groupBy(F.col("job_description_id").alias("id")).agg(F.count("*").alias("kept"))
    described = F.coalesce("description", F.lit("")) != ""
    n = F.when(described, F.col("evaluated")).otherwise(0)
    # ``pool`` is one row, the result of a global count
    rows = jds.select("id", "description").join(kept, "id", "left").join(F.broadcast(pool), F.lit(True))
    return rows.select(
        F.col("id").alias("job_description_id"), n.cast("long").alias("evaluated"), F.coalesce("kept", F.lit(0)).alias("kept"),
        F.when(~described, "vacancy has no description").when(n == 0, "no candidates to evaluate")
        .when(F.col("kept").isNull(), "no candidate reaches the minimum").alias("reason"))
