"""Applicant tables seen through the given test tables.

The test data has documents, vectors, events and labels rather than applicants; these views map
one onto the other, each over whole tables.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rolefit.functions import text as tx
from rolefit.plans.recommend import recommend
from rolefit.plans.screen import run_history, screen
from rolefit.session import passing_stages, spread, write_stage

AS_OF = "TIMESTAMP_NTZ '2024-01-31 00:00:00'"
MIN_RECOMMENDATION = 10.0
_STORED: dict[tuple[str, str, str], DataFrame] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def as_of() -> Column:
    return F.expr(AS_OF)


def first_words(flat: Column) -> Column:
    """The adapters' person name: the first two words."""
    return F.concat(F.split_part(flat, F.lit(" "), F.lit(1)), F.lit(" "), F.split_part(flat, F.lit(" "), F.lit(2)))


def candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stored candidates table, derived once per session as every report reads it."""
    return _stored(spark, sf_dir, "candidates", lambda: spread(derive_candidates(spark, sf_dir), "id"))


def derive_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One candidate per document; exact copies are duplicates of the smallest id."""
    docs = table(spark, sf_dir, "documents")
    # copies are found on a narrow (id, digest) table, so texts are not shuffled for it
    digests = docs.select(F.col("doc_id").alias("id"), F.sha2("text", 256).alias("digest"))
    firsts = digests.groupBy("digest").agg(F.min("id").alias("first_id"), F.count("*").alias("n")).where("n > 1")
    copies = digests.join(firsts, "digest").where("id <> first_id").select("id", "first_id")

    flat = F.replace("text", F.lit("\n"), F.lit(" "))
    words = [("% the %", " the ", "The"), ("% of %", " of ", "of"), ("% la %", " la ", "LA"), ("% und %", " und ", "und")]
    people = docs.withColumn("flat", flat).select(
        F.col("doc_id").alias("id"),
        first_words(F.col("flat")).alias("name"),
        tx.first_email(F.col("text")).alias("email"),
        tx.first_phone(F.col("text")).alias("phone"),
        F.when(F.col("doc_id") % 29 == 0, "").otherwise(F.col("text")).alias("text_content"),  # some profiles are empty
        F.concat(F.lit("doc_"), F.col("doc_id").cast("string"), F.lit(".pdf")).alias("source_file"),
        F.when(F.col("doc_id") % 3 == 0, "email").when(F.col("doc_id") % 3 == 1, "upload").otherwise("manual").alias("source_type"),
        F.when(F.col("doc_id") % 58 == 0, "").otherwise(F.concat_ws(",", *[
            F.when(F.contains("flat", F.lit(needle)), F.lit(shown)) for _, needle, shown in words])).alias("skills"),
        F.when(F.col("n_chars") % 37 != 0, F.col("n_chars") % 16).cast("int").alias("experience_years"),
    )
    added = table(spark, sf_dir, "events").select((F.col("event_id") / 5).cast("long").alias("id"), F.col("event_id"), F.col("ts").alias("created_at"))
    added = added.where(F.col("event_id") == F.col("id") * 5).drop("event_id")
    vectors = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("profile_embedding"))
    joined = people.join(copies, "id", "left").join(added, "id", "left").join(vectors, "id", "left")
    flagged = F.col("first_id").isNotNull()
    joined = tx.with_text_flags(joined)
    return joined.select(
        *people.columns, "has_text", "has_profile",
        flagged.alias("is_duplicate"),
        F.col("first_id").alias("duplicate_of"),
        F.when(flagged, F.lit(1.0)).alias("duplicate_confidence"),
        "created_at", "profile_embedding",
    )


def job_descriptions(spark: SparkSession, sf_dir: str) -> DataFrame:
    item = F.col("item_id")
    of3 = lambda a, b, c: F.when(item % 3 == 0, a).when(item % 3 == 1, b).otherwise(c)
    vectors = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("item_id"), F.col("embedding").alias("jd_embedding"))
    jds = table(spark, sf_dir, "benchmark").join(vectors, "item_id", "left")
    return jds.select(
        item.alias("id"),
        F.concat(F.lit("Role "), item.cast("string")).alias("title"),
        F.when(item % 13 == 12, "").otherwise(F.col("text")).alias("description"),
        F.concat(F.lit("dept_"), (item % 5).cast("string")).alias("department"),
        of3("the, of", "La, und, of", "The, go").alias("required_skills"),
        (item % 8).cast("int").alias("required_experience_min"),
        F.when(item % 4 != 0, item % 8 + 5).cast("int").alias("required_experience_max"),
        of3("active", "closed", "on_hold").alias("status"),
        of3(
            '{"semantic_weight": 0.7, "skill_weight": 0.3, "experience_weight": 0.0, "min_score_threshold": 10}',
            '{"semantic_weight": 0.4, "skill_weight": 0.4, "experience_weight": 0.2, "min_score_threshold": 10, "longlist_percentage": 0.29}',
            "{}",
        ).alias("matching_config"),
        "jd_embedding",
    )


def email_logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").groupBy("conv_id").agg(
        F.max(F.when(F.col("turn") == 0, F.col("text"))).alias("subject"),
        F.count("*").cast("int").alias("attachments_count"),
        F.count_if(F.col("role") == "assistant").cast("int").alias("resumes_extracted"),
    ).select(
        F.col("conv_id").cast("string").alias("email_id"), "subject",
        (F.col("attachments_count") > 2).alias("has_attachment"), "attachments_count", "resumes_extracted",
        F.when(F.col("conv_id") % 11 == 0, "failed").otherwise("processed").alias("processing_status"),
    )


def arrivals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A batch of new applicants: every conversation turn read as one short application, and every document with an
    address or a number as one of somebody who comes again. The adapters' person name is the first two words."""
    flat = F.replace("text", F.lit("\n"), F.lit(" "))
    person = [first_words(flat).alias("name"), tx.first_email(F.col("text")).alias("email"), tx.first_phone(F.col("text")).alias("phone")]
    turns = table(spark, sf_dir, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"), *person)
    again = table(spark, sf_dir, "documents").select((F.col("doc_id") + 1_000_000_000).alias("id"), *person)
    return turns.unionByName(again.where("email IS NOT NULL OR phone IS NOT NULL"))


def with_review_status(results: DataFrame, labels: DataFrame) -> DataFrame:
    """Review outcome from the labels: toxic is rejected, good quality reviewed, every tenth hired."""
    marks = labels.groupBy(F.col("doc_id").alias("candidate_id")).agg(F.max("toxic").alias("toxic"), F.max("quality").alias("quality"))
    status = (
        F.when(F.col("toxic") == 1, "rejected")
        .when((F.col("quality") == 1) & (F.col("candidate_id") % 10 == 0), "hired")
        .when(F.col("quality") == 1, "reviewed")
        .otherwise("pending")
    )
    return results.join(marks, "candidate_id", "left").withColumn("status", status).drop("toxic", "quality")


def executed_at(job_id: Column) -> Column:
    """Run time of a vacancy's screening: noon of a day in January 2024."""
    day = F.lpad((1 + job_id % 28).cast("string"), 2, "0")
    return F.to_timestamp_ntz(F.concat(F.lit("2024-01-"), day, F.lit(" 12:00:00")), F.lit("yyyy-MM-dd HH:mm:ss"))


def _stored(spark: SparkSession, sf_dir: str, label: str, make) -> DataFrame:
    """A derived table written once per session and then read, as reports read stored results. What was written on the way
    is removed."""
    key = (spark.sparkContext.applicationId, sf_dir, label)
    if key not in _STORED:
        with passing_stages(spark):
            _STORED[key] = write_stage(make(), label, keep=True)
    return _STORED[key]


def screening_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    def make() -> DataFrame:
        found = screen(candidates(spark, sf_dir), job_descriptions(spark, sf_dir), as_of()).results
        found = with_review_status(found, table(spark, sf_dir, "labels"))
        return found.withColumn("screened_at", executed_at(F.col("job_description_id")))
    return _stored(spark, sf_dir, "screening_results", make)


def screening_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _stored(spark, sf_dir, "screening_history", lambda: run_history(
        screening_results(spark, sf_dir), candidates(spark, sf_dir), job_descriptions(spark, sf_dir),
        executed_at(F.col("job_description_id"))))


def vacancy_recommendations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _stored(spark, sf_dir, "vacancy_recommendations", lambda: recommend(
        candidates(spark, sf_dir), job_descriptions(spark, sf_dir), screening_results(spark, sf_dir),
        top_n=10, min_score=MIN_RECOMMENDATION))
