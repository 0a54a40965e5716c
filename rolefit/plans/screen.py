"""Screening: score, rank and classify every candidate for every vacancy."""

from __future__ import annotations

from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rolefit.functions import scoring, text
from rolefit.functions.vectors import score_all, vacancy_blocks
from rolefit.operators.ranking import rank_rows
from rolefit.session import by_shuffle, spread, write_stage

#: Vacancies that a row of unscorable pairs is spread over at once.
BLOCK_VACANCIES = 5_000


class Screening(NamedTuple):
    results: DataFrame
    history: DataFrame
    errors: DataFrame


def candidates_for_screening(candidates: DataFrame) -> DataFrame:
    """The columns a screening reads, of canonical candidates."""
    wanted = ["id", "name", "email", "phone", "skills", "text_content", "experience_years", "summary",
              "education", "experience"]
    return candidates.where(~F.col("is_duplicate")).select(*[c for c in wanted if c in candidates.columns])


def vacancy_terms(jds: DataFrame) -> DataFrame:
    """What a pair needs to know of its vacancy: skills to match, experience range, settings."""
    return jds.select(
        F.col("id").alias("job_description_id"),
        text.vacancy_skills(F.col("required_skills"), F.col("description")).alias("wanted"),
        (F.coalesce("description", F.lit("")) != "").alias("described"),
        F.col("required_experience_min").alias("low"),
        F.col("required_experience_max").alias("high"),
        scoring.matching_config(F.col("matching_config")).alias("config"),
    ).withColumn("wanted_keys", F.array_distinct(F.transform("wanted", F.lower)))


def scored_pairs(candidates: DataFrame, jds: DataFrame) -> DataFrame:
    """Canonical candidates with every vacancy: the vector score next to both sides' attributes.

    Where either side has no text the score is 0, whatever its stored vector says.
    """
    people = text.with_text_flags(candidates).where(~F.col("is_duplicate")).select(
        F.col("id").alias("candidate_id"),
        "has_text",
        text.skill_set(F.col("skills")).alias("offered"),
        F.col("experience_years").alias("years"),
        "profile_embedding",
    )
    people = spread(people, "candidate_id")  # each row becomes one row per vacancy
    terms = write_stage(vacancy_terms(jds), "vacancy-terms")
    blocks = [
        # one short row per vacancy of a block, whose size is checked; all pairs would be shuffled by vacancy otherwise
        score_all(people, block).join(F.broadcast(terms.join(block.ids.select("job_description_id").distinct(), "job_description_id", "left_semi")), "job_description_id")
        for block in vacancy_blocks(jds)]
    if not blocks:
        raise ValueError("no vacancies to screen for")
    pairs = reduce(DataFrame.unionByName, blocks)
    written = F.col("has_text") & F.col("described")
    return pairs.withColumn("semantic_score", F.when(written, F.col("semantic_score")).otherwise(0.0)).drop("has_text", "described")


def _unscorable() -> Column:
    """Unknown experience cannot be held against a minimum: such pairs are reported, not scored."""
    return F.col("years").isNull() & F.col("low").isNotNull()


def display_columns() -> list[Column]:
    """What a result shows of a pair's experience and skills."""
    has = lambda s: F.array_contains(F.col("offered"), F.lower(s))
    return [
        scoring.experience_gap(F.col("low"), F.col("high"), F.col("years")).alias("experience_gap"),
        text.display_list(F.filter("wanted", has)).alias("matched_skills"),
        text.display_list(F.filter("wanted", lambda s: ~has(s))).alias("missing_skills"),
    ]


def score_columns(pairs: DataFrame) -> DataFrame:
    """All scores and display columns of each pair."""
    matched = F.size(F.array_intersect("wanted_keys", "offered"))
    skill = scoring.skill_score(matched, F.size("wanted_keys"))
    experience = scoring.experience_score(F.col("low"), F.col("high"), F.col("years"))
    return pairs.select(
        "job_description_id", "candidate_id", "semantic_score", "config",
        skill.alias("skill_match_score"),
        experience.alias("experience_score"),
        *display_columns(),
    ).withColumn(
        "final_score",
        scoring.round2(scoring.weighted_score(
            F.col("semantic_score"), F.col("skill_match_score"), F.col("experience_score"), F.col("config"))),
    )


def screen(candidates: DataFrame, jds: DataFrame, as_of: Column | None = None) -> Screening:
    """Screen all canonical candidates for all given vacancies in one run.

    Results replace earlier ones per vacancy (see ``upkeep.replace_partitions``). Not lazy: the ranking writes its
    sorted rows while the plan is made. Ranks and list
    flags come from one distributed ranking; the run history is an aggregate of the results.
    """
    as_of = F.current_timestamp().cast("timestamp_ntz") if as_of is None else as_of
    scored = score_columns(scored_pairs(candidates, jds).where(~_unscorable()))
    ranked = rank_rows(scored, "job_description_id", [F.desc("final_score"), F.asc("candidate_id")])
    results = listed_rows(ranked, as_of)
    return Screening(results, run_history(results, candidates, jds, as_of), screening_errors(candidates, jds))


def listed_rows(ranked: DataFrame, as_of: Column) -> DataFrame:
    """Result rows with their list flags, from ranked pairs with ``group_size`` and ``config``."""
    n, config = F.col("group_size"), F.col("config")
    good = F.col("final_score") >= config["min_score_threshold"]
    rank = F.col("rank_position")
    return ranked.select(
        "job_description_id", "candidate_id", "final_score", "semantic_score", "skill_match_score",
        "experience_score", "matched_skills", "missing_skills", "experience_gap",
        (good & (rank <= scoring.cut_off(n, config["longlist_percentage"]))).alias("in_longlist"),
        (good & (rank <= scoring.cut_off(n, config["shortlist_percentage"]))).alias("in_shortlist"),
        "rank_position",
        F.lit("pending").alias("status"),
        as_of.alias("screened_at"),
    )


def screening_errors(candidates: DataFrame, jds: DataFrame) -> DataFrame:
    """Pairs that can't be scored: (job_description_id, candidate_id, error_message).

    They follow from experience and minimum alone, so nothing is scored or ranked for them. Vacancies are dealt to blocks,
    candidates are repeated once per block and joined to it.
    """
    wanted = jds.where(F.col("required_experience_min").isNotNull()).select(F.col("id").alias("job"))
    blocks = max(1, -(-wanted.count() // BLOCK_VACANCIES))
    dealt = wanted.groupBy(F.pmod(F.xxhash64("job"), F.lit(blocks)).cast("int").alias("block")).agg(F.collect_list("job").alias("jobs"))
    unknown = candidates.where(~F.col("is_duplicate") & F.col("experience_years").isNull()).select(F.col("id").alias("candidate_id"))
    unknown = unknown.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    return unknown.join(dealt, "block").select(
        F.explode("jobs").alias("job_description_id"), "candidate_id", F.lit("experience is unknown").alias("error_message"))


def cut_scores(scored: DataFrame, terms: DataFrame, percentage: str) -> DataFrame:
    """Per vacancy the least score that can be on the list, and the number of its scored pairs.

    Scores are hundredths, so a vacancy's histogram has at most 10,001 rows however many pairs it has; the list ends
    in the score group in which the running count from the top reaches the list's length.
    """
    cents = F.round(F.col("final_score") * 100).cast("int")
    counts = scored.groupBy("job_description_id", cents.alias("cents")).agg(F.count(F.lit(1)).alias("n"))
    whole = Window.partitionBy("job_description_id")
    above = whole.orderBy(F.desc("cents")).rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select("job_description_id", "cents", F.coalesce(F.sum("n").over(above), F.lit(0)).alias("before"),
                           F.sum("n").over(whole).alias("group_size"))
    counts = counts.join(terms.select("job_description_id", "config"), "job_description_id")
    on_list = (F.col("before") < scoring.cut_off(F.col("group_size"), F.col("config")[percentage])) & (
        F.col("cents") >= F.ceil(F.round(F.col("config")["min_score_threshold"] * 100, 6)))
    return counts.where(on_list).groupBy("job_description_id").agg(F.min("cents").alias("least"), F.max("group_size").alias("group_size"))


def screen_listed(candidates: DataFrame, jds: DataFrame, list_type: str = "shortlist", as_of: Column | None = None) -> DataFrame:
    """The result rows of one list, as ``screen`` gives them, without sorting all pairs.

    Pairs are scored once and kept as narrow rows; the histogram of a vacancy gives its cut-off score, and only pairs from
    that score on are ranked. They are a vacancy's best rows, so their ranks are the ranks among all.
    """
    as_of = F.current_timestamp().cast("timestamp_ntz") if as_of is None else as_of
    terms = vacancy_terms(jds)
    narrow = score_columns(scored_pairs(candidates, jds).where(~_unscorable())).select(
        "job_description_id", "candidate_id", "semantic_score", "skill_match_score", "experience_score", "final_score")
    narrow = write_stage(narrow, "scored-pairs")
    cut = cut_scores(narrow, terms, f"{list_type}_percentage")
    survivors = narrow.join(cut, "job_description_id").where(F.round(F.col("final_score") * 100).cast("int") >= F.col("least"))
    ranked = rank_rows(survivors.drop("least"), "job_description_id", [F.desc("final_score"), F.asc("candidate_id")], size="survivors")
    people = candidates.where(~F.col("is_duplicate")).select(
        F.col("id").alias("candidate_id"), text.skill_set(F.col("skills")).alias("offered"), F.col("experience_years").alias("years"))
    shown = ranked.join(by_shuffle(people), "candidate_id").join(terms, "job_description_id").select(
        *[c for c in ranked.columns if c != "survivors"], "config", *display_columns())
    return listed_rows(shown, as_of).where(f"in_{list_type}")


def run_history(results: DataFrame, candidates: DataFrame, jds: DataFrame, executed_at: Column) -> DataFrame:
    """One audit row per vacancy: counts, score statistics and a snapshot of its settings."""
    stats = results.groupBy("job_description_id").agg(
        F.count_if("in_longlist").cast("int").alias("longlist_count"),
        F.count_if("in_shortlist").cast("int").alias("shortlist_count"),
        scoring.round2(scoring.mean_of_hundredths(F.col("final_score"))).alias("avg_score"),
        F.max("final_score").alias("max_score"),
        F.min("final_score").alias("min_score"),
    )
    pool = candidates.where(~F.col("is_duplicate")).agg(F.count("*").cast("int").alias("total_candidates"))
    settings = jds.select(
        F.col("id").alias("job_description_id"),
        F.coalesce("matching_config", F.lit("{}")).alias("config_snapshot"))
    run_key = F.concat_ws("|", F.col("job_description_id"), executed_at.cast("string"))
    # ``pool`` is one row, the result of a global count
    return (
        stats.join(settings, "job_description_id").join(F.broadcast(pool), F.lit(True))
        .select(
            "job_description_id",
            F.substring(F.sha2(run_key, 256), 1, 8).alias("batch_id"),
            "total_candidates", "longlist_count", "shortlist_count", "avg_score", "max_score", "min_score",
            "config_snapshot", executed_at.alias("executed_at"))
    )
