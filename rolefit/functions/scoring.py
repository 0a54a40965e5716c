"""Scores of one (vacancy, candidate) pair as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from rolefit.schemas import MATCHING_CONFIG

# Defaults used where a vacancy's settings leave a key out.
CONFIG_DEFAULTS = {
    "semantic_weight": 0.7,
    "skill_weight": 0.3,
    "experience_weight": 0.0,
    "min_score_threshold": 50.0,
    "longlist_percentage": 0.5,
    "shortlist_percentage": 0.2,
}


def matching_config(raw: Column) -> Column:
    """JSON settings to a struct of doubles with every default filled in."""
    parsed = F.from_json(raw, MATCHING_CONFIG)
    return F.struct(
        *[F.coalesce(parsed[key], F.lit(value)).alias(key) for key, value in CONFIG_DEFAULTS.items()]
    )


def round2(c: Column) -> Column:
    """Two decimals, half up on doubles; the same arithmetic in any SQL engine."""
    return F.floor(c * F.lit(100.0) + F.lit(0.5)) / F.lit(100.0)


def mean_of_hundredths(c: Column) -> Column:
    """Aggregate: mean of values with two decimals, summed as whole hundredths so that the result
    does not depend on the order of the rows; NULL over no rows."""
    whole = F.floor(c * F.lit(100.0) + F.lit(0.5)).cast("long")
    return F.sum(whole).cast("double") / F.nullif(F.count(whole), F.lit(0)) / F.lit(100.0)


def skill_score(matched: Column, wanted: Column) -> Column:
    """Share of wanted skills matched, 0-100; 0 when nothing is wanted."""
    return F.when(wanted == 0, F.lit(0.0)).otherwise(
        matched.cast("double") / wanted.cast("double") * F.lit(100.0)
    )


def experience_gap(low: Column, high: Column, years: Column) -> Column:
    """Years missing below the minimum, or in excess of a (non-zero) maximum."""
    return (
        F.when(low.isNull(), F.lit(0))
        .when(years < low, low - years)
        .when((high != 0) & (years > high), years - high)
        .otherwise(F.lit(0))
        .cast("int")
    )


def experience_score(low: Column, high: Column, years: Column) -> Column:
    """100 inside the asked range, 20 less per missing year, 5 less per extra year, never below 0."""
    score = (
        F.when(low.isNull(), F.lit(0))
        .when(years < low, F.greatest(F.lit(0), 100 - (low - years) * 20))
        .when((high != 0) & (years > high), F.greatest(F.lit(0), 100 - (years - high) * 5))
        .otherwise(F.lit(100))
    )
    return score.cast("double")


def weighted_score(semantic: Column, skill: Column, experience: Column, config: Column) -> Column:
    """Weighted mean of the three scores before rounding; 0 when the weights sum to 0."""
    ws, wk, we = config["semantic_weight"], config["skill_weight"], config["experience_weight"]
    total = ws + wk + we
    return F.when(total == 0, F.lit(0.0)).otherwise((semantic * ws + skill * wk + experience * we) / total)


def cut_off(rows: Column, share: Column) -> Column:
    """How many of ``rows`` a share keeps, truncated toward zero."""
    return (rows.cast("double") * share).cast("long")


def match_reason(score: Column, min_years: Column, years: Column, wanted: Column, offered: Column) -> Column:
    """Readable reason for a recommendation; ``wanted`` and ``offered`` are sorted skill sets."""
    shared = F.slice(F.sort_array(F.array_intersect(wanted, offered)), 1, 3)
    have = F.coalesce(years, F.lit(0))
    asks = F.coalesce(min_years, F.lit(0)) != 0
    experience = F.when(
        asks & (have >= min_years),
        F.concat(F.lit("Has "), have.cast("string"), F.lit(" years of experience (required: "),
                 min_years.cast("string"), F.lit("+)")),
    ).when(asks, F.concat(F.lit("Experience gap of "), (min_years - have).cast("string"), F.lit(" years")))
    skills = F.when(F.size(shared) > 0, F.concat(F.lit("Matching skills: "), F.array_join(shared, ", ")))
    overall = (
        F.when(score >= 80, F.lit("Excellent semantic profile match"))
        .when(score >= 60, F.lit("Good profile alignment"))
        .otherwise(F.lit("Partial profile match"))
    )
    return F.concat_ws("; ", experience, skills, overall)
