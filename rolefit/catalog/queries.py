"""Every registered query: (spark, data folder) to a DataFrame over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rolefit.catalog import sample_files
from rolefit.catalog import sample_tables as st
from rolefit.functions import scoring, text as tx
from rolefit.functions.encoder import HashedTerms, embed
from rolefit.functions.replies import with_reply_fields
from rolefit.functions.vectors import score_all, tfidf_cosines, vacancy_blocks
from rolefit.operators import filters, linkage, reports, rollups, upkeep
from rolefit.operators.canonical import deduplicate
from rolefit.plans.dashboard import summary_export
from rolefit.plans.ingest import admit, ingest_texts, parse_candidates
from rolefit.plans.recommend import recommend, recommendation_summary
from rolefit.plans.screen import candidates_for_screening, screen, screen_listed, screening_errors, vacancy_terms
from rolefit.schemas import TABLES
from rolefit.session import new_path, write_stage
from rolefit.sources import tables
from rolefit.streaming.ingest import STORED_SCHEMA, start_ingest
from rolefit.streaming.trends import closed_days, daily_counts, late_rows, start_closed_days, start_daily

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def register(fn: Query) -> Query:
    QUERIES[fn.__name__] = fn
    return fn


# Screening

SHOWN = ["job_description_id", "candidate_id", "rank_position", "final_score", "semantic_score", "skill_match_score",
         "experience_score", "experience_gap", "matched_skills", "missing_skills", "in_longlist", "in_shortlist"]


@register
def screen_all_scores(spark: SparkSession, sf: str) -> DataFrame:
    return screen(st.candidates(spark, sf), st.job_descriptions(spark, sf), st.as_of()).results.select(*SHOWN)


@register
def screen_shortlist(spark: SparkSession, sf: str) -> DataFrame:
    people = st.candidates(spark, sf)
    results = screen_listed(people, st.job_descriptions(spark, sf), "shortlist", st.as_of())
    listed = reports.results_with_candidates(results, people, "shortlist")
    return listed.select("job_description_id", "candidate_id", "rank_position", "name", "email", "experience_years",
                         "final_score", "semantic_score", "skill_match_score", "matched_skills", "missing_skills")


@register
def screen_longlist(spark: SparkSession, sf: str) -> DataFrame:
    listed = reports.results_with_candidates(st.screening_results(spark, sf), st.candidates(spark, sf), "longlist")
    return listed.select("job_description_id", "candidate_id", "rank_position", "name", "email", "experience_years",
                         "final_score", "matched_skills", "missing_skills", "status")


@register
def screen_run_history(spark: SparkSession, sf: str) -> DataFrame:
    return st.screening_history(spark, sf).select(
        "job_description_id", "total_candidates", "longlist_count", "shortlist_count", "avg_score", "max_score",
        "min_score", "executed_at")


@register
def results_by_status(spark: SparkSession, sf: str) -> DataFrame:
    rows = filters.list_rows(st.screening_results(spark, sf), "all")
    return rows.groupBy("job_description_id", "status").agg(F.count("*").alias("rows"), F.max("final_score").alias("best"))


@register
def score_histogram(spark: SparkSession, sf: str) -> DataFrame:
    return reports.score_histogram(st.screening_results(spark, sf))


@register
def jd_skills(spark: SparkSession, sf: str) -> DataFrame:
    terms = vacancy_terms(st.job_descriptions(spark, sf))
    return terms.select("job_description_id", F.array_join("wanted", "|").alias("skills"),
                        F.size("wanted_keys").alias("n_skills"))


@register
def config_weights(spark: SparkSession, sf: str) -> DataFrame:
    config = scoring.matching_config(F.col("matching_config"))
    return st.job_descriptions(spark, sf).select("id", *[config[k].alias(k) for k in scoring.CONFIG_DEFAULTS])


@register
def skill_match(spark: SparkSession, sf: str) -> DataFrame:
    rows = st.screening_results(spark, sf)
    return rows.select("job_description_id", "candidate_id", "skill_match_score", "matched_skills", "missing_skills")


@register
def experience_score(spark: SparkSession, sf: str) -> DataFrame:
    rows = st.screening_results(spark, sf)
    return rows.groupBy("job_description_id", "experience_gap", "experience_score").agg(F.count("*").alias("candidates"))


def _vector_scores(people: DataFrame, jds: DataFrame) -> DataFrame:
    people = people.select(F.col("id").alias("candidate_id"), "profile_embedding")
    frames = [score_all(people, b) for b in vacancy_blocks(jds)]
    out = frames[0]
    for more in frames[1:]:
        out = out.unionByName(more)
    return out.select("job_description_id", "candidate_id", "semantic_score")


@register
def semantic_scores(spark: SparkSession, sf: str) -> DataFrame:
    return _vector_scores(filters.canonical(st.candidates(spark, sf)), st.job_descriptions(spark, sf))


@register
def encoded_scores(spark: SparkSession, sf: str) -> DataFrame:
    """Candidates and vacancies by vectors made of their whole texts, the encoder fitted on the candidates."""
    people, jds, model = filters.canonical(st.candidates(spark, sf)), st.job_descriptions(spark, sf), new_path(spark, "encoder")
    HashedTerms.fit(people.select(F.col("text_content").alias("text")), model)
    encoder = HashedTerms(spark, model)
    stored = write_stage(embed(people.select("id", "text_content"), encoder, F.col("text_content"), "profile_embedding"), "encoded")
    return _vector_scores(stored, embed(jds, encoder, F.col("description"), "jd_embedding"))


@register
def tfidf_scores(spark: SparkSession, sf: str) -> DataFrame:
    """Whole text against whole text without stored vectors."""
    people = filters.canonical(st.candidates(spark, sf)).select("id", F.col("text_content").alias("text"))
    return tfidf_cosines(people, st.job_descriptions(spark, sf).select("id", F.col("description").alias("text")))


@register
def screen_errors(spark: SparkSession, sf: str) -> DataFrame:
    return screening_errors(st.candidates(spark, sf), st.job_descriptions(spark, sf))


@register
def screen_batches(spark: SparkSession, sf: str) -> DataFrame:
    return st.screening_history(spark, sf).select("job_description_id", "batch_id", "config_snapshot")


@register
def screening_candidates(spark: SparkSession, sf: str) -> DataFrame:
    rows = candidates_for_screening(st.candidates(spark, sf))
    return rows.select("id", "name", "skills", "experience_years", F.length("text_content").cast("long").alias("n_chars"))


# Recommendation


@register
def recommend_topn(spark: SparkSession, sf: str) -> DataFrame:
    found = recommend(st.candidates(spark, sf), st.job_descriptions(spark, sf), st.screening_results(spark, sf),
                      top_n=10, min_score=st.MIN_RECOMMENDATION)
    return found.select("job_description_id", "candidate_id", "rank_position", "recommendation_score", "match_reasoning")


@register
def recommendation_runs(spark: SparkSession, sf: str) -> DataFrame:
    return recommendation_summary(st.candidates(spark, sf), st.job_descriptions(spark, sf),
                                  st.vacancy_recommendations(spark, sf), st.screening_results(spark, sf))


@register
def recommendation_list(spark: SparkSession, sf: str) -> DataFrame:
    rows = reports.recommendations_with_candidates(st.vacancy_recommendations(spark, sf), st.candidates(spark, sf))
    return rows.select("job_description_id", "candidate_id", "score", "name", "email", "experience_years", "skills")


@register
def recommend_new_only(spark: SparkSession, sf: str) -> DataFrame:
    """A second, wider run stores only pairs the first has not stored."""
    wider = recommend(st.candidates(spark, sf), st.job_descriptions(spark, sf), st.screening_results(spark, sf),
                      top_n=20, min_score=st.MIN_RECOMMENDATION)
    keys = ["job_description_id", "candidate_id"]
    return upkeep.insert_if_absent(wider, st.vacancy_recommendations(spark, sf), keys).select(*keys, "score")


@register
def match_reasoning(spark: SparkSession, sf: str) -> DataFrame:
    """The reason text of every screened pair, from its vector score."""
    pairs = st.screening_results(spark, sf).select("job_description_id", "candidate_id", "semantic_score")
    people = st.candidates(spark, sf).select(F.col("id").alias("candidate_id"), "experience_years", tx.skill_set(F.col("skills")).alias("offered"))
    jobs = st.job_descriptions(spark, sf).select(
        F.col("id").alias("job_description_id"), "required_experience_min", tx.skill_set(F.col("required_skills")).alias("wanted"))
    reason = scoring.match_reason(F.col("semantic_score"), F.col("required_experience_min"), F.col("experience_years"),
                                  F.col("wanted"), F.col("offered"))
    return pairs.join(people, "candidate_id").join(jobs, "job_description_id").select(
        "job_description_id", "candidate_id", reason.alias("match_reasoning"))


# Reports


@register
def candidates_total(spark: SparkSession, sf: str) -> DataFrame:
    return reports.sidebar_counts(st.candidates(spark, sf), st.job_descriptions(spark, sf))


@register
def candidates_last_n_days(spark: SparkSession, sf: str) -> DataFrame:
    return reports.candidates_in_period(st.candidates(spark, sf), 14, st.as_of())


@register
def candidates_by_source(spark: SparkSession, sf: str) -> DataFrame:
    return reports.candidates_by_source(st.candidates(spark, sf))


@register
def duplicate_rate(spark: SparkSession, sf: str) -> DataFrame:
    return reports.duplicate_rate(st.candidates(spark, sf))


@register
def screening_stats(spark: SparkSession, sf: str) -> DataFrame:
    return reports.screening_stats(st.screening_results(spark, sf), st.screening_history(spark, sf))


@register
def funnel_overall(spark: SparkSession, sf: str) -> DataFrame:
    return reports.funnel(st.screening_results(spark, sf), st.candidates(spark, sf))


@register
def funnel_by_jd(spark: SparkSession, sf: str) -> DataFrame:
    return reports.funnel_by_job(st.screening_results(spark, sf), st.candidates(spark, sf))


@register
def jd_summary(spark: SparkSession, sf: str) -> DataFrame:
    return reports.vacancy_summary(st.job_descriptions(spark, sf), st.screening_results(spark, sf))


@register
def runs_with_titles(spark: SparkSession, sf: str) -> DataFrame:
    rows = reports.runs_with_vacancies(st.screening_history(spark, sf), st.job_descriptions(spark, sf))
    return rows.select("job_description_id", "title", "department", "shortlist_count", "executed_at")


@register
def daily_candidates(spark: SparkSession, sf: str) -> DataFrame:
    return reports.daily_candidates(st.candidates(spark, sf), 30, st.as_of())


@register
def daily_screenings(spark: SparkSession, sf: str) -> DataFrame:
    return reports.daily_screenings(st.screening_history(spark, sf), 30, st.as_of())


@register
def recent_activity(spark: SparkSession, sf: str) -> DataFrame:
    rows = reports.recent_activity(st.candidates(spark, sf), st.screening_history(spark, sf), st.job_descriptions(spark, sf))
    return rows.select("activity_type", "title", "happened_at", "details", "ref")


@register
def kpi_row(spark: SparkSession, sf: str) -> DataFrame:
    return reports.dashboard_row(
        st.candidates(spark, sf), st.screening_results(spark, sf), st.screening_history(spark, sf), st.as_of())


def _rollups(spark: SparkSession, sf: str) -> str:
    """A store made without the manual candidates and a third of the results, then refreshed for the days these touch."""
    store = new_path(spark, "rollups")
    sources = [("candidates", st.candidates(spark, sf), F.col("source_type") == "manual"),
               ("results", st.screening_results(spark, sf), F.col("job_description_id") % 3 == 0),
               ("history", st.screening_history(spark, sf), F.col("job_description_id") % 3 == 0)]
    for source, rows, later in sources:
        rollups.refresh(rows.where(~later), store, source)
        rollups.refresh(rows, store, source, rollups.changed_days(rows.where(later), source))
    return store


@register
def kpi_from_rollups(spark: SparkSession, sf: str) -> DataFrame:
    return rollups.dashboard_row(spark, _rollups(spark, sf), st.as_of())


@register
def trends_from_rollups(spark: SparkSession, sf: str) -> DataFrame:
    store = _rollups(spark, sf)
    runs = rollups.daily_screenings(spark, store, 30, st.as_of())
    return rollups.daily_candidates(spark, store, 30, st.as_of()).join(runs, "day", "full")


@register
def metric_log(spark: SparkSession, sf: str) -> DataFrame:
    return upkeep.metric_rows(kpi_row(spark, sf), "dashboard", st.as_of(), ["screened", "hired"])


@register
def candidate_search(spark: SparkSession, sf: str) -> DataFrame:
    page = filters.candidate_search(st.candidates(spark, sf), name="an", source="email", show_duplicates=True)
    return page.select("id", "name", "email", "source_type", "is_duplicate", "experience_years", "created_at")


@register
def search_summary(spark: SparkSession, sf: str) -> DataFrame:
    everyone = filters.candidate_search(st.candidates(spark, sf), name="e", show_duplicates=True, limit=None)
    return filters.search_summary(everyone)


@register
def jd_search(spark: SparkSession, sf: str) -> DataFrame:
    found = filters.vacancy_search(st.job_descriptions(spark, sf), title="ROLE 1", status="active", sort="title")
    return found.select("id", "title", "department", "status", "required_skills")


@register
def active_candidates(spark: SparkSession, sf: str) -> DataFrame:
    return filters.active_candidates(st.candidates(spark, sf))


@register
def duplicate_report(spark: SparkSession, sf: str) -> DataFrame:
    return reports.duplicate_report(st.candidates(spark, sf))


@register
def mail_log_summary(spark: SparkSession, sf: str) -> DataFrame:
    return reports.mail_summary(st.email_logs(spark, sf))


# Text extraction over whole documents


@register
def extract_email(spark: SparkSession, sf: str) -> DataFrame:
    return st.table(spark, sf, "documents").select("doc_id", tx.first_email(F.col("text")).alias("email"))


@register
def extract_phone(spark: SparkSession, sf: str) -> DataFrame:
    return st.table(spark, sf, "documents").select("doc_id", tx.first_phone(F.col("text")).alias("phone"))


@register
def extract_experience(spark: SparkSession, sf: str) -> DataFrame:
    said = F.concat(F.col("text"), F.lit(" "), (F.col("doc_id") % 30).cast("string"), F.lit("+ Years, 3 years"))
    return st.table(spark, sf, "documents").select("doc_id", tx.experience_years(said).alias("experience_years"))


@register
def keyword_skills(spark: SparkSession, sf: str) -> DataFrame:
    found = F.sort_array(tx.keyword_skills(F.col("text")))
    return st.table(spark, sf, "documents").select(
        "doc_id", F.array_join(found, "|").alias("skills"), F.size(found).alias("n_skills"))


@register
def keyword_skills_whole_words(spark: SparkSession, sf: str) -> DataFrame:
    found = F.sort_array(tx.keyword_skills(F.col("text"), word_boundary=True))
    return st.table(spark, sf, "documents").select("doc_id", F.array_join(found, "|").alias("skills"))


@register
def normalize_phone(spark: SparkSession, sf: str) -> DataFrame:
    people = st.candidates(spark, sf)
    return people.where("phone IS NOT NULL").select("id", "phone", tx.normalize_phone(F.col("phone")).alias("phone_key"))


@register
def stored_file_names(spark: SparkSession, sf: str) -> DataFrame:
    people = st.candidates(spark, sf)
    raw = F.concat(F.col("name"), F.lit(" cv!"), F.lit(".pdf"))
    return people.select("id", tx.stored_file_name(raw, st.as_of(), F.col("id")).alias("file_name"),
                         tx.name_from_file(F.col("source_file")).alias("fallback_name"))


# Table upkeep


@register
def upsert_overlay(spark: SparkSession, sf: str) -> DataFrame:
    """Recommendations to rejected-free, experienced candidates marked as contacted."""
    recs = st.vacancy_recommendations(spark, sf).withColumn("id", F.col("job_description_id") * 1000 + F.col("rank_position"))
    recs = recs.select("id", "job_description_id", "candidate_id", F.lit(False).alias("was_contacted"),
                       F.lit(None).cast("timestamp_ntz").alias("contacted_at"))
    strong = st.vacancy_recommendations(spark, sf).where("recommendation_score >= 30").select(
        (F.col("job_description_id") * 1000 + F.col("rank_position")).alias("id"))
    return upkeep.mark_contacted(recs, strong, st.as_of())


@register
def delete_cascade(spark: SparkSession, sf: str) -> DataFrame:
    """Results left after deleting closed vacancies."""
    gone = st.job_descriptions(spark, sf).where(F.col("status") == "closed").select("id")
    left = upkeep.delete_rows(st.screening_results(spark, sf), gone, "job_description_id")
    return left.groupBy("job_description_id").agg(F.count("*").alias("rows"), F.max("final_score").alias("best"))


@register
def unique_violations(spark: SparkSession, sf: str) -> DataFrame:
    return upkeep.unique_violations(st.candidates(spark, sf), "name")


@register
def fk_violations(spark: SparkSession, sf: str) -> DataFrame:
    """Results whose candidate is gone once the manual entries are deleted, and copies whose original is."""
    left = st.candidates(spark, sf).where("source_type <> 'manual'")
    lost = upkeep.orphans(st.screening_results(spark, sf), "candidate_id", left).select(F.lit("result").alias("row"), "candidate_id")
    copies = upkeep.orphans(left, "duplicate_of", left.select("id")).select(F.lit("copy").alias("row"), F.col("id").alias("candidate_id"))
    return lost.unionByName(copies).groupBy("row", "candidate_id").agg(F.count("*").alias("rows"))


@register
def table_scan(spark: SparkSession, sf: str) -> DataFrame:
    found = tables.scan(st.candidates(spark, sf), "experience_years >= 10 AND NOT is_duplicate", [F.desc("experience_years"), F.asc("id")])
    return found.select("id", "experience_years", "source_type")


@register
def row_by_id(spark: SparkSession, sf: str) -> DataFrame:
    return tables.by_id(st.candidates(spark, sf), 7).select("id", "name", "source_file")


@register
def bound_sql(spark: SparkSession, sf: str) -> DataFrame:
    text = "SELECT source_type, count(*) AS rows, max(id) AS last FROM {people} WHERE experience_years >= :low GROUP BY source_type"
    return tables.query(spark, text, {"low": 5}, people=st.candidates(spark, sf))


@register
def appended_rows(spark: SparkSession, sf: str) -> DataFrame:
    """The candidates table written in two appends and read back with its declared schema."""
    root, schema = new_path(spark, "append"), TABLES["candidates"]
    rows = st.candidates(spark, sf).select("id", "name", "email", "phone", "skills", "experience_years", "is_duplicate", "created_at")
    upkeep.append(rows.where("id % 2 = 0"), schema, f"{root}/candidates")
    upkeep.append(rows.where("id % 2 = 1"), schema, f"{root}/candidates")
    return tables.read_table(spark, root, "candidates").select("id", "name", "email", "experience_years", "summary")


@register
def replaced_results(spark: SparkSession, sf: str) -> DataFrame:
    """Results stored by vacancy, of which the even ones are then replaced by their short lists."""
    path = new_path(spark, "results")
    rows = st.screening_results(spark, sf).select("job_description_id", "candidate_id", "final_score", "in_shortlist")
    upkeep.replace_partitions(rows, path)
    upkeep.replace_partitions(rows.where("in_shortlist AND job_description_id % 2 = 0"), path)
    stored = spark.read.schema(rows.schema).parquet(path)
    return stored.groupBy("job_description_id").agg(F.count("*").alias("rows"), F.max("final_score").alias("best"))


@register
def cleared_table(spark: SparkSession, sf: str) -> DataFrame:
    """Row counts of a table before and after it is cleared."""
    path = new_path(spark, "clear")
    rows = st.vacancy_recommendations(spark, sf)
    rows.write.parquet(path)
    before = spark.read.schema(rows.schema).parquet(path).agg(F.count("*")).first()[0]
    upkeep.clear_table(rows, path)
    after = spark.read.schema(rows.schema).parquet(path)
    return after.agg(F.count("*").alias("after")).select(F.lit(before).cast("long").alias("before"), "after")


@register
def marked_duplicates(spark: SparkSession, sf: str) -> DataFrame:
    """Flags, originals and the time of change after rows with the address of an earlier row are marked."""
    people = st.candidates(spark, sf).withColumn("updated_at", F.lit(None).cast("timestamp_ntz"))
    keys = linkage.linkage_keys(people)
    hits = linkage.key_matches(keys, keys, "email_key", earlier_only=True)
    decisions = hits.select("id", F.lit(True).alias("is_duplicate"), F.col("original").alias("duplicate_of"), F.lit(0.5).alias("duplicate_confidence"))
    return upkeep.mark_duplicates(people, decisions, st.as_of()).select(
        "id", "is_duplicate", "duplicate_of", "duplicate_confidence", "updated_at")


@register
def exported_summary(spark: SparkSession, sf: str) -> DataFrame:
    """The one-row summary report as CSV under its printed headings, read back."""
    row = summary_export(st.candidates(spark, sf), st.screening_results(spark, sf), st.screening_history(spark, sf), st.as_of())
    path = new_path(spark, "csv")
    upkeep.export_csv(row, path)
    return spark.read.schema(row.schema).option("header", True).option("escape", '"').csv(path)


@register
def exported_csv(spark: SparkSession, sf: str) -> DataFrame:
    """The long list as CSV, read back as text."""
    path = new_path(spark, "csv")
    upkeep.export_csv(screen_longlist(spark, sf), path)
    return spark.read.option("header", True).option("escape", '"').csv(path).select(
        "job_description_id", "candidate_id", "name", "final_score", "matched_skills")


@register
def vacancies_from_forms(spark: SparkSession, sf: str) -> DataFrame:
    item = F.col("item_id")
    forms = st.table(spark, sf, "benchmark").select(
        F.when(item % 7 != 0, F.concat(F.lit("Role "), item.cast("string"))).alias("title"),
        F.col("text").alias("description"), F.lit("dept").alias("department"), F.lit(None).cast("string").alias("location"),
        F.lit("the, of").alias("required_skills"), (item % 8).cast("int").alias("required_experience_min"),
        (item % 3 * 4).cast("int").alias("required_experience_max"), F.lit(None).cast("string").alias("required_certifications"),
        F.lit("active").alias("status"), F.lit(0.5).alias("semantic_weight"), F.lit(0.25).alias("skill_weight"),
        F.lit(0.25).alias("experience_weight"), F.lit(10.0).alias("min_score_threshold"),
        F.lit(0.5).alias("longlist_percentage"), F.lit(0.25).alias("shortlist_percentage"))
    made = upkeep.vacancies_from_forms(forms, st.as_of())
    config = scoring.matching_config(F.col("matching_config"))
    return made.select("title", "required_experience_min", "required_experience_max",
                       config["semantic_weight"].alias("semantic_weight"),
                       config["shortlist_percentage"].alias("shortlist_percentage"), "created_at")


# Linkage


@register
def email_matches(spark: SparkSession, sf: str) -> DataFrame:
    stored = linkage.linkage_keys(filters.canonical(st.candidates(spark, sf)))
    return linkage.key_matches(linkage.linkage_keys(st.arrivals(spark, sf)), stored, "email_key")


@register
def phone_matches(spark: SparkSession, sf: str) -> DataFrame:
    stored = linkage.linkage_keys(filters.canonical(st.candidates(spark, sf)))
    return linkage.key_matches(linkage.linkage_keys(st.arrivals(spark, sf)), stored, "phone_key")


@register
def name_matches(spark: SparkSession, sf: str) -> DataFrame:
    stored = linkage.linkage_keys(filters.canonical(st.candidates(spark, sf)))
    return linkage.name_matches(linkage.linkage_keys(st.arrivals(spark, sf)), stored)


@register
def duplicate_decisions(spark: SparkSession, sf: str) -> DataFrame:
    return linkage.detect_duplicates(st.arrivals(spark, sf), filters.canonical(st.candidates(spark, sf)))


@register
def canonical_set(spark: SparkSession, sf: str) -> DataFrame:
    return deduplicate(st.candidates(spark, sf).select("id", "name", "email", "phone"))


# Files, mails, replies


@register
def parsed_candidates(spark: SparkSession, sf: str) -> DataFrame:
    texts = st.table(spark, sf, "documents").select(
        F.concat(F.lit("jane_van_doe_"), F.col("doc_id").cast("string"), F.lit(".docx")).alias("source_file"),
        F.col("text").alias("text_content"))
    return parse_candidates(texts).select("source_file", "name", "email", "phone", "experience_years")


@register
def reply_repair(spark: SparkSession, sf: str) -> DataFrame:
    rows = with_reply_fields(sample_files.raw_replies(spark, sf), "reply", "f")
    return rows.select("conv_id", "turn", "f.name", "f.email", "f.experience", "f.skills", "f.projects", "f.summary")


@register
def ingest_decisions(spark: SparkSession, sf: str) -> DataFrame:
    """Arrivals as a batch after the stored candidates: against those and against each other."""
    batch = st.arrivals(spark, sf)
    last = st.table(spark, sf, "documents").agg(F.max("doc_id").alias("last"))
    batch = batch.join(F.broadcast(last), F.lit(True)).withColumn("id", F.col("id") + F.col("last") + 1).drop("last")
    return admit(batch, filters.canonical(st.candidates(spark, sf)))


@register
def ingest_report(spark: SparkSession, sf: str) -> DataFrame:
    """Texts parsed, flagged against the stored candidates and each other, and counted; blank texts fail."""
    texts = st.table(spark, sf, "conversations").select(
        (F.col("conv_id") * 1000 + F.col("turn") + 1_000_000_000).alias("id"),
        F.concat(F.lit("cv_"), F.col("conv_id").cast("string"), F.lit(".txt")).alias("source_file"),
        F.when(F.col("turn") % 5 != 4, F.col("text")).otherwise(" ").alias("text_content"))
    made = ingest_texts(texts, filters.canonical(st.candidates(spark, sf)), "upload", st.as_of()).select("id", "is_duplicate")
    all_rows = texts.select("id").join(made, "id", "left")
    return reports.ingest_summary(all_rows.withColumn("error_message", F.when(F.col("is_duplicate").isNull(), "no text extracted")))


# Streams


@register
def stream_daily_counts(spark: SparkSession, sf: str) -> DataFrame:
    schema = st.table(spark, sf, "events").schema
    rows = spark.readStream.schema(schema).parquet(f"{sf}/events.parquet*")
    table = new_path(spark, "daily")
    start_daily(daily_counts(rows, "ts", "value"), table, new_path(spark, "daily-progress")).awaitTermination()
    return spark.read.schema("day date, rows long, hundredths long").parquet(table)


@register
def stream_closed_days(spark: SparkSession, sf: str) -> DataFrame:
    """All events in two deliveries, every tenth in the second, where many of them are too late for their day."""
    events = st.table(spark, sf, "events")
    source, table, progress = (new_path(spark, x) for x in ("source", "closed", "closed-progress"))
    for delivery in (F.col("event_id") % 10 != 0, F.col("event_id") % 10 == 0):
        events.where(delivery).write.mode("append").parquet(source)
        rows = spark.readStream.schema(events.schema).parquet(source)
        start_closed_days(daily_counts(rows, "ts", "value", "2 days"), table, progress).awaitTermination()
    closed = closed_days(spark, table).drop("batch_id")
    late = late_rows(spark.read.schema(events.schema).parquet(source), closed, "ts", "value")
    return closed.join(late, "day", "left").select(
        "day", "rows", "hundredths", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("late_rows", "late_hundredths")])


def _applications(rows: DataFrame) -> DataFrame:
    return rows.select(
        F.col("doc_id").alias("id"),
        F.concat(F.regexp_extract("text", "[A-Za-z]+", 0), F.lit("_"), (F.col("doc_id") % 97).cast("string"), F.lit(".docx")).alias("source_file"),
        F.col("text").alias("text_content"))


@register
def stream_ingest(spark: SparkSession, sf: str) -> DataFrame:
    schema = st.table(spark, sf, "documents").schema
    rows = _applications(spark.readStream.schema(schema).parquet(f"{sf}/documents.parquet*"))
    table = new_path(spark, "ingested")
    start_ingest(rows, table, new_path(spark, "index"), new_path(spark, "ingest-progress"), "upload", st.as_of()).awaitTermination()
    stored = spark.read.schema(STORED_SCHEMA).parquet(table)
    return stored.select("id", "is_duplicate", "duplicate_of", "duplicate_confidence")


@register
def stream_ingest_batches(spark: SparkSession, sf: str) -> DataFrame:
    """All documents in three deliveries, in id order; every one is linked through the kept index of those before."""
    docs = st.table(spark, sf, "documents")
    source, table, index, progress = (new_path(spark, x) for x in ("source", "ingested", "index", "ingest-progress"))
    first, second = docs.approxQuantile("doc_id", [0.4, 0.7], 0.01)
    doc = F.col("doc_id")
    for part in (doc <= first, (doc > first) & (doc <= second), doc > second):
        docs.where(part).write.mode("append").parquet(source)
        rows = _applications(spark.readStream.schema(docs.schema).parquet(source))
        start_ingest(rows, table, index, progress, "upload", st.as_of()).awaitTermination()
    stored = spark.read.schema(STORED_SCHEMA).parquet(table)
    return stored.select("id", "is_duplicate", "duplicate_of", "duplicate_confidence")
