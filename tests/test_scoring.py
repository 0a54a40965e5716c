import pytest
from pyspark.sql import functions as F

from rolefit.functions import scoring as sc


@pytest.mark.parametrize("low, high, years, score, gap", [
    (5, 8, 3, 60.0, 2), (5, 8, 6, 100.0, 0), (5, 8, 10, 90.0, 2), (5, 8, 0, 0.0, 5),
    (None, 8, 3, 0.0, 0), (5, 0, 90, 100.0, 0), (5, None, 90, 100.0, 0), (0, 1, 99, 0.0, 98)])
def test_experience(one, low, high, years, score, gap):
    cols = F.col("i_low"), F.col("i_high"), F.col("i_years")
    values = dict(i_low=low, i_high=high, i_years=years)
    assert one(sc.experience_score(*cols), **values) == score
    assert one(sc.experience_gap(*cols), **values) == gap


@pytest.mark.parametrize("config, final", [
    ('{"semantic_weight": 0.7, "skill_weight": 0.3, "experience_weight": 0}', 71.0),
    ('{"semantic_weight": 0, "skill_weight": 0, "experience_weight": 0}', 0.0),
    ("{}", 71.0), (None, 71.0), ('{"experience_weight": 1.0}', 85.5)])
def test_final_score(one, config, final):
    score = sc.weighted_score(F.lit(80.0), F.lit(50.0), F.lit(100.0), sc.matching_config(F.col("c")))
    assert one(sc.round2(score), c=config) == final


def test_skill_score_and_cut_off(one):
    assert one(sc.skill_score(F.lit(0), F.col("i"))  , i=0) == 0.0
    assert one(sc.round2(sc.skill_score(F.lit(2), F.col("i"))), i=3) == 66.67
    assert one(sc.cut_off(F.col("i"), F.lit(0.29)), i=100) == 28
    assert one(sc.cut_off(F.col("i"), F.lit(0.2)), i=3) == 0


@pytest.mark.parametrize("score, low, years, text", [
    (80.0, 3, 5, "Has 5 years of experience (required: 3+); Matching skills: a, b, c; Excellent semantic profile match"),
    (60.0, 3, 1, "Experience gap of 2 years; Matching skills: a, b, c; Good profile alignment"),
    (59.9, 0, 1, "Matching skills: a, b, c; Partial profile match"),
    (59.9, None, 1, "Matching skills: a, b, c; Partial profile match")])
def test_reason(one, score, low, years, text):
    skills = F.array(*[F.lit(x) for x in "dcba"])
    reason = sc.match_reason(F.lit(score), F.col("i_low"), F.col("i_years"), skills, skills)
    assert one(reason, i_low=low, i_years=years) == text
