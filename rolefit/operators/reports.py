"""Counts, rates, funnels, summaries and feeds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rolefit.functions import scoring
from rolefit.operators.filters import canonical, last_days, list_rows

REVIEWED = ("reviewed", "rejected", "hired")


def total_candidates(candidates: DataFrame, exclude_duplicates: bool = True) -> DataFrame:
    return (canonical(candidates) if exclude_duplicates else candidates).agg(F.count("*").alias("total_candidates"))


def sidebar_counts(candidates: DataFrame, jds: DataFrame) -> DataFrame:
    """Canonical candidates and active vacancies; both sides of the join are one row."""
    active = jds.agg(F.count_if(F.col("status") == "active").alias("active_jobs"))
    return total_candidates(candidates).join(F.broadcast(active), F.lit(True))


def candidates_in_period(candidates: DataFrame, days: int, as_of: Column, exclude_duplicates: bool = True) -> DataFrame:
    rows = canonical(candidates) if exclude_duplicates else candidates
    return rows.where(last_days("created_at", days, as_of)).agg(F.count("*").alias("candidates"))


def candidates_by_source(candidates: DataFrame) -> DataFrame:
    return (
        canonical(candidates).groupBy("source_type").agg(F.count("*").alias("candidates"))
        .orderBy(F.desc("candidates"), "source_type")
    )


def _duplicate_rate() -> Column:
    """Percent of duplicates, 0 without rows."""
    share = F.count_if("is_duplicate").cast("double") / F.nullif(F.count("*"), F.lit(0)) * F.lit(100.0)
    return F.coalesce(share, F.lit(0.0))


def duplicate_rate(candidates: DataFrame) -> DataFrame:
    return candidates.agg(_duplicate_rate().alias("duplicate_rate"))


def _mean_or_zero(c: str) -> Column:
    return F.coalesce(scoring.round2(scoring.mean_of_hundredths(F.col(c))), F.lit(0.0))


def distinct_pairs_first(results: DataFrame, *keys: str) -> DataFrame:
    """Results folded to one row per (keys, candidate): everything else in a funnel adds up from it.

    Spark would otherwise expand each row once per distinct aggregate; this is one shuffle on a
    well-spread key. Narrow rows are dealt before they are folded: nearly every row is a pair of its own, so that folding where
    the rows lie saves nothing and needs memory for all pairs of an input split, whose rows take few bytes in its file.
    """
    cents = F.floor(F.col("final_score") * 100.0 + 0.5).cast("long")
    rows = results.select(*keys, "candidate_id", cents.alias("cents"), "in_longlist", "in_shortlist",
                          F.col("status").isin(*REVIEWED).alias("reviewed"), (F.col("status") == "hired").alias("hired"))
    dealt = rows.repartition(int(results.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys, "candidate_id")
    return dealt.groupBy(*keys, "candidate_id").agg(
        F.count("*").alias("n"),
        F.sum("cents").alias("cents"),
        F.count_if("in_longlist").alias("longlisted"),
        F.count_if("in_shortlist").alias("shortlisted"),
        F.count_if("reviewed").alias("reviewed"),
        F.count_if("hired").alias("hired"),
    )


def screening_stats(results: DataFrame, history: DataFrame) -> DataFrame:
    """Runs, distinct candidates screened, mean score, shortlisted rows: one row."""
    mean = F.sum("cents").cast("double") / F.nullif(F.sum("n"), F.lit(0)) / F.lit(100.0)
    folded = distinct_pairs_first(results).agg(
        F.count("*").alias("candidates_screened"),
        F.coalesce(scoring.round2(mean), F.lit(0.0)).alias("avg_score"),
        F.coalesce(F.sum("shortlisted"), F.lit(0)).alias("shortlisted"),
    )
    runs = history.agg(F.count("*").alias("screening_runs"))
    return runs.join(F.broadcast(folded), F.lit(True))


_STAGES = ("longlisted", "shortlisted", "reviewed", "hired")


def _stage_sums() -> list[Column]:
    return [F.count("*").alias("screened"), *[F.coalesce(F.sum(s), F.lit(0)).alias(s) for s in _STAGES]]


def funnel(results: DataFrame, candidates: DataFrame, job_id: int | None = None) -> DataFrame:
    """The six funnel stages in one pass: distinct candidates screened, the rest as row counts."""
    if job_id is not None:
        results = results.where(F.col("job_description_id") == job_id)
    stages = distinct_pairs_first(results).agg(*_stage_sums())
    total = total_candidates(candidates).withColumnRenamed("total_candidates", "total_cvs")
    return total.join(F.broadcast(stages), F.lit(True))


def funnel_by_job(results: DataFrame, candidates: DataFrame) -> DataFrame:
    """The funnel of every vacancy that has results, at once."""
    stages = distinct_pairs_first(results, "job_description_id").groupBy("job_description_id").agg(*_stage_sums())
    total = total_candidates(candidates).withColumnRenamed("total_candidates", "total_cvs")
    return stages.join(F.broadcast(total), F.lit(True))


def vacancy_summary(jds: DataFrame, results: DataFrame) -> DataFrame:
    """Per active vacancy: rows screened, listed, mean score, last run; vacancies without rows stay."""
    per_job = results.groupBy("job_description_id").agg(
        F.count("*").alias("total_screened"),
        F.count_if("in_shortlist").alias("shortlisted"),
        F.count_if("in_longlist").alias("longlisted"),
        scoring.mean_of_hundredths(F.col("final_score")).alias("avg_score"),
        F.max("screened_at").alias("last_screened"),
    )
    active = jds.where(F.col("status") == "active").select(
        F.col("title").alias("job_title"), F.col("id").alias("job_id"))
    joined = active.join(per_job, active.job_id == per_job.job_description_id, "left")
    counts = ("total_screened", "shortlisted", "longlisted")
    return joined.select("job_title", "job_id", *[F.coalesce(c, F.lit(0)).alias(c) for c in counts], "avg_score", "last_screened")


def daily_candidates(candidates: DataFrame, days: int, as_of: Column) -> DataFrame:
    return (
        canonical(candidates).where(last_days("created_at", days, as_of))
        .groupBy(F.to_date("created_at").alias("day")).agg(F.count("*").alias("candidates")).orderBy("day")
    )


def daily_screenings(history: DataFrame, days: int, as_of: Column) -> DataFrame:
    return (
        history.where(last_days("executed_at", days, as_of))
        .groupBy(F.to_date("executed_at").alias("day"))
        .agg(F.count("*").alias("screenings"), scoring.mean_of_hundredths(F.col("avg_score")).alias("avg_score"))
        .orderBy("day")
    )


def score_histogram(results: DataFrame, job_id: int | None = None, bins: int = 20, low: float = 0.0, high: float = 100.0) -> DataFrame:
    """Rows per equal-width score bin and vacancy; scores outside the range fall in the end bins."""
    if job_id is not None:
        results = results.where(F.col("job_description_id") == job_id)
    raw = F.floor((F.col("final_score") - F.lit(low)) / F.lit((high - low) / bins)).cast("int")
    number = F.greatest(F.lit(0), F.least(F.lit(bins - 1), raw))
    width = (high - low) / bins
    return (
        results.groupBy("job_description_id", number.alias("bin")).agg(F.count("*").alias("candidates"))
        .withColumn("bin_start", F.lit(low) + F.col("bin") * F.lit(width))
    )


def recent_activity(candidates: DataFrame, history: DataFrame, jds: DataFrame, limit: int = 10) -> DataFrame:
    """Newest candidates and newest screening runs, merged and cut to ``limit``."""
    added = (
        canonical(candidates).orderBy(F.desc("created_at"), "id").limit(limit)
        .select(F.lit("candidate_added").alias("activity_type"), F.col("name").alias("title"),
                F.col("created_at").alias("happened_at"), F.col("source_type").alias("details"), F.col("id").alias("ref"))
    )
    # the top rows are cut before the join: the vacancy is needed for at most ``limit`` runs
    titles = jds.select(F.col("id").alias("job_description_id"), "title")
    runs = (
        history.join(titles.select("job_description_id"), "job_description_id", "left_semi")
        .orderBy(F.desc("executed_at"), "job_description_id").limit(limit)
        .join(titles, "job_description_id")
        .select(F.lit("screening_completed").alias("activity_type"), "title", F.col("executed_at").alias("happened_at"),
                F.concat(F.col("shortlist_count").cast("string"), F.lit(" shortlisted")).alias("details"),
                F.col("job_description_id").alias("ref"))
    )
    return added.unionByName(runs).orderBy(F.desc("happened_at"), "activity_type", "ref").limit(limit)


def dashboard_row(candidates: DataFrame, results: DataFrame, history: DataFrame, as_of: Column) -> DataFrame:
    """All single-number KPIs as one row from one scan of each table."""
    ours = ~F.col("is_duplicate")
    people = candidates.agg(
        F.count_if(ours).alias("total_candidates"),
        F.count_if(ours & last_days("created_at", 30, as_of)).alias("candidates_this_month"),
        F.count_if(ours & last_days("created_at", 7, as_of)).alias("candidates_this_week"),
        scoring.round2(_duplicate_rate()).alias("duplicate_rate"),
    )
    mean = F.sum("cents").cast("double") / F.nullif(F.sum("n"), F.lit(0)) / F.lit(100.0)
    stages = distinct_pairs_first(results).agg(
        *_stage_sums(), F.coalesce(scoring.round2(mean), F.lit(0.0)).alias("avg_score"))
    runs = history.agg(F.count("*").alias("screening_runs"))
    # three one-row frames
    return people.join(F.broadcast(stages), F.lit(True)).join(F.broadcast(runs), F.lit(True))


def results_with_candidates(results: DataFrame, candidates: DataFrame, list_type: str = "all", job_id: int | None = None) -> DataFrame:
    """Short list, long list or all results with the candidate's contact data, best first per vacancy."""
    rows = list_rows(results, list_type)
    if job_id is not None:
        rows = rows.where(F.col("job_description_id") == job_id)
    people = candidates.select(
        F.col("id").alias("candidate_id"), "name", "email", "phone", "experience_years", "source_file",
        F.col("created_at").alias("candidate_created_at"))
    return rows.join(people, "candidate_id")


def best_first(rows: DataFrame, score: str) -> DataFrame:
    return rows.orderBy("job_description_id", F.desc(score), "candidate_id")


def recommendations_with_candidates(recommendations: DataFrame, candidates: DataFrame, job_id: int | None = None) -> DataFrame:
    rows = recommendations if job_id is None else recommendations.where(F.col("job_description_id") == job_id)
    people = candidates.select(
        F.col("id").alias("candidate_id"), "name", "email", "phone", "experience_years", "skills", "source_file")
    return best_first(rows.join(people, "candidate_id"), "recommendation_score")


def runs_with_vacancies(history: DataFrame, jds: DataFrame) -> DataFrame:
    titles = jds.select(F.col("id").alias("job_description_id"), "title", "department")
    return history.join(titles, "job_description_id")


def duplicate_report(candidates: DataFrame) -> DataFrame:
    """Every duplicate next to its original. Only the narrow columns of both sides are shuffled."""
    narrow = candidates.select("id", "name", "email", "is_duplicate", "duplicate_of", "duplicate_confidence", "created_at")
    copies = narrow.where("is_duplicate").select(
        F.col("id").alias("duplicate_id"), F.col("name").alias("duplicate_name"),
        F.col("email").alias("duplicate_email"), F.col("duplicate_of").alias("original_id"),
        "duplicate_confidence", F.col("created_at").alias("duplicate_created_at"))
    originals = narrow.select(
        F.col("id").alias("original_id"), F.col("name").alias("original_name"), F.col("email").alias("original_email"))
    return copies.join(originals, "original_id").orderBy(F.desc("duplicate_created_at"), "duplicate_id")


def mail_summary(logs: DataFrame) -> DataFrame:
    """Mails checked, resumes found and saved, failed mails."""
    return logs.agg(
        F.count("*").alias("emails_checked"),
        F.coalesce(F.sum("attachments_count"), F.lit(0)).alias("resumes_found"),
        F.coalesce(F.sum("resumes_extracted"), F.lit(0)).alias("resumes_saved"),
        F.count_if(F.col("processing_status") == "failed").alias("failed"),
    )


def ingest_summary(decisions: DataFrame) -> DataFrame:
    """Stored, failed and duplicate counts of an ingest batch."""
    return decisions.agg(
        F.count_if(F.col("error_message").isNull()).alias("success"),
        F.count_if(F.col("error_message").isNotNull()).alias("failed"),
        F.count_if(F.coalesce("is_duplicate", F.lit(False))).alias("duplicates"),
    )
