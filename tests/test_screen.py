import datetime
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from rolefit.functions import vectors
from rolefit.plans.recommend import recommend
from rolefit.operators.ranking import rank_rows
from rolefit.plans import screen as screening
from rolefit.plans.screen import screen, screen_listed, screening_errors

PEOPLE = ("id long, name string, email string, phone string, skills string, text_content string, summary string, "
          "experience string, experience_years int, is_duplicate boolean, created_at timestamp_ntz, profile_embedding array<float>")
JOBS = ("id long, title string, description string, required_skills string, required_experience_min int, "
        "required_experience_max int, matching_config string, jd_embedding array<float>")


def as_of():
    return F.expr("TIMESTAMP_NTZ '2024-02-01 00:00:00'")


def vector(rng):
    return [float(np.float32(rng.gauss(0, 1))) for _ in range(6)]


@pytest.fixture(scope="module")
def tables(spark):
    import datetime

    rng = random.Random(5)
    people = []
    for i in range(1, 81):
        v = None if i % 7 == 0 else [0.0] * 6 if i % 11 == 0 else vector(rng)
        skills = rng.choice([None, "", "Python, aws", "SQL\n docker,AWS", "python,sql,docker"])
        people.append((i, f"P {i}", None, None, skills, f"text {i}" if i % 13 else None, "s" if i % 26 else None, None,
                       None if i % 17 == 0 else rng.randrange(12), i % 10 == 0,
                       datetime.datetime(2024, 1, 1 + i % 5), v))
    jobs = [
        (1, "Senior", "We use Docker", "Python, AWS", 3, 6, '{"min_score_threshold": 5}', vector(rng)),
        (2, "Any", "nothing asked", None, None, None, None, vector(rng)),
        (3, "Junior", "sql and SQL", "sql", 0, 0, '{"semantic_weight": 0.4, "skill_weight": 0.4, "experience_weight": 0.2, '
         '"min_score_threshold": 0, "longlist_percentage": 0.29}', vector(rng)),
        (4, "Empty", "", "x", 2, 4, "{}", None),
    ]
    return people, jobs, spark.createDataFrame(people, PEOPLE).repartition(6), spark.createDataFrame(jobs, JOBS)


def cosine(a, b):
    if a is None or b is None or not np.any(a) or not np.any(b):
        return 0.0
    a, b = np.array(a), np.array(b)
    return np.floor(a @ b / np.sqrt(a @ a) / np.sqrt(b @ b) * 1e8 + 0.5) / 1e6


def expected(people, job):
    wanted = {s.strip() for s in (job[3] or "").split(",") if s.strip()}
    wanted |= {t for t in ("Docker", "Sql") if t.lower() in job[2].lower()}
    keys = {s.lower() for s in wanted}
    import json
    cfg = {"semantic_weight": .7, "skill_weight": .3, "experience_weight": 0., "min_score_threshold": 50,
           "longlist_percentage": .5, "shortlist_percentage": .2, **json.loads(job[6] or "{}")}
    rows = []
    for p in people:
        if p[9] or (p[8] is None and job[4] is not None):
            continue
        have = {s.strip().lower() for s in (p[4] or "").replace("\n", ",").split(",") if s.strip()}
        skill = len(keys & have) / len(keys) * 100 if keys else 0.0
        low, high, years = job[4], job[5], p[8]
        if low is None:
            exp, gap = 0, 0
        elif years < low:
            exp, gap = max(0, 100 - (low - years) * 20), low - years
        elif high and years > high:
            exp, gap = max(0, 100 - (years - high) * 5), years - high
        else:
            exp, gap = 100, 0
        total = cfg["semantic_weight"] + cfg["skill_weight"] + cfg["experience_weight"]
        written = bool(p[5] or p[6]) and bool(job[2])
        raw = (cosine(p[11], job[7]) * written * cfg["semantic_weight"] + skill * cfg["skill_weight"] + exp * cfg["experience_weight"]) / total
        final = np.floor(raw * 100 + 0.5) / 100
        show = lambda c: ", ".join(sorted(s for s in wanted if c(s.lower()))) or None
        rows.append([p[0], final, gap, show(lambda s: s in have), show(lambda s: s not in have)])
    rows.sort(key=lambda r: (-r[1], r[0]))
    n = len(rows)
    return {r[0]: (*r[1:], place, place <= int(n * cfg["longlist_percentage"]) and r[1] >= cfg["min_score_threshold"],
                   place <= int(n * cfg["shortlist_percentage"]) and r[1] >= cfg["min_score_threshold"])
            for place, r in enumerate(rows, start=1)}


def as_dict(results):
    return {(r["job_description_id"], r["candidate_id"]): (
        r["final_score"], r["experience_gap"], r["matched_skills"], r["missing_skills"], r["rank_position"],
        r["in_longlist"], r["in_shortlist"]) for r in results.collect()}


def test_screen_equals_one_by_one(tables):
    people, jobs, people_df, jobs_df = tables
    run = screen(people_df, jobs_df, as_of())
    got = as_dict(run.results)
    want = {(j[0], c): v for j in jobs for c, v in expected(people, j).items()}
    assert got == want
    assert {(r["job_description_id"], r["candidate_id"]) for r in run.errors.collect()} == {
        (j[0], p[0]) for j in jobs for p in people if j[4] is not None and p[8] is None and not p[9]}
    history = {r["job_description_id"]: r for r in run.history.collect()}
    for j in jobs:
        rows = [v for k, v in want.items() if k[0] == j[0]]
        h = history[j[0]]
        assert (h["total_candidates"], h["longlist_count"], h["shortlist_count"]) == (
            sum(not p[9] for p in people), sum(v[5] for v in rows), sum(v[6] for v in rows))
        assert h["max_score"] == max(v[0] for v in rows) and len(h["batch_id"]) == 8


def test_all_vacancies_at_once_equals_each_alone_and_many_passes(tables, monkeypatch):
    _, _, people_df, jobs_df = tables
    whole = as_dict(screen(people_df, jobs_df, as_of()).results)
    alone = as_dict(screen(people_df.repartition(3), jobs_df.where("id = 3"), as_of()).results)
    assert alone == {k: v for k, v in whole.items() if k[0] == 3}
    blocks = list(vectors.vacancy_blocks(jobs_df, spare_bytes=2 * 8 * 6))
    assert len(blocks) > 1 and sum(b.size for b in blocks) == 4 and all(b.size <= 2 for b in blocks)
    monkeypatch.setattr(vectors, "VACANCIES_PER_ARRAY", 2)
    monkeypatch.setattr(vectors.vacancy_blocks, "__defaults__", ("jd_embedding", 2 * 8 * 6))
    assert as_dict(screen(people_df, jobs_df, as_of()).results) == whole


@pytest.mark.parametrize("top_n, min_score, batch", [(3, -100.0, 5), (10, 0.0, 10000), (4, 20.0, 7)])
def test_recommend_equals_one_by_one(spark, tables, top_n, min_score, batch):
    people, jobs, people_df, jobs_df = tables
    rejected = spark.createDataFrame([(1, "rejected"), (2, "reviewed"), (3, "rejected")], "candidate_id long, status string")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    try:
        got = {}
        for r in recommend(people_df, jobs_df, rejected, top_n, min_score).orderBy("job_description_id", "rank_position").collect():
            got.setdefault(r["job_description_id"], []).append((r["candidate_id"], r["recommendation_score"]))
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    want = {}
    for j in jobs:
        if not j[2]:
            continue
        pool = [p for p in people if not p[9] and p[0] not in (1, 3) and any((p[5], p[6], p[7], p[4]))
                and (not j[4] or (p[8] is not None and p[8] >= j[4]))]
        scored = [(cosine(p[11], j[7]), p[10], p[0]) for p in pool]
        best = sorted((s for s in scored if s[0] >= min_score), key=lambda s: (-s[0], -s[1].timestamp(), s[2]))[:top_n]
        if best:
            want[j[0]] = [(i, s) for s, _, i in best]
    assert got == want


def test_tfidf_cosines_over_whole_texts(spark):
    long = "filler " * 1000 + "spark engine"
    people = spark.createDataFrame([(1, long), (2, "cooking with Fire"), (3, None), (4, "")], "id long, text string")
    jobs = spark.createDataFrame([(7, "Spark engine!"), (8, "spark, fire"), (9, "")], "id long, text string")
    got = {(r["candidate_id"], r["job_description_id"]): r["semantic_score"] for r in vectors.tfidf_cosines(people, jobs).collect()}
    weight = np.log(5 / 2)
    assert set(got) == {(1, 7), (1, 8), (2, 8)}
    assert abs(got[1, 7] - 100 * 2 * weight / (np.sqrt(1000 ** 2 + 2) * weight * np.sqrt(2))) < 1e-5
    assert abs(got[2, 8] - 100 / np.sqrt(3 * 2)) < 1e-5


@pytest.mark.parametrize("min_score", [-100.0, 0.0, 50.0])
def test_empty_texts_score_nothing_and_are_never_recommended(spark, min_score):
    people = spark.createDataFrame(
        [(1, "", None, None, 5, False, datetime.datetime(2024, 1, 1), [1.0, 0.0]), (2, "text", None, "", 5, False, datetime.datetime(2024, 1, 1), [1.0, 0.0])],
        "id long, text_content string, summary string, skills string, experience_years int, is_duplicate boolean, created_at timestamp_ntz, profile_embedding array<float>")
    jobs = spark.createDataFrame([(1, "d", "", 0, None, "{}", [1.0, 0.0]), (2, "", "", 0, None, "{}", [1.0, 0.0])],
        "id long, description string, required_skills string, required_experience_min int, required_experience_max int, matching_config string, jd_embedding array<float>")
    scores = {(r["job_description_id"], r["candidate_id"]): r["semantic_score"] for r in screen(people, jobs, as_of()).results.collect()}
    assert scores == {(1, 1): 0.0, (1, 2): 100.0, (2, 1): 0.0, (2, 2): 0.0}
    found = recommend(people, jobs, None, 10, min_score)
    assert [(r["job_description_id"], r["candidate_id"]) for r in found.collect()] == [(1, 2)]


@pytest.mark.parametrize("list_type", ["shortlist", "longlist"])
def test_lists_by_cut_off_equal_the_whole_ranking(tables, monkeypatch, list_type):
    _, _, people, jobs = tables
    whole = screen(people, jobs, as_of()).results
    want = sorted(map(tuple, whole.where(f"in_{list_type}").collect()))
    ranked = []
    monkeypatch.setattr(screening, "rank_rows", lambda df, *a, **k: ranked.append(df.count()) or rank_rows(df, *a, **k))
    got = screen_listed(people, jobs, list_type, as_of())
    assert got.columns == whole.columns and sorted(map(tuple, got.collect())) == want and want
    assert ranked[0] < whole.count() * 0.6  # ties at the cut-off are ranked too


def test_lists_of_ties_and_nobody(tables):
    _, jobs, people, frame = tables
    spark = people.sparkSession
    same = spark.createDataFrame([(i, "n", None, None, "Python", "t", "s", None, 4, False, None, jobs[2][7]) for i in range(1, 41)], PEOPLE)
    want = screen(same, frame.where("id = 3"), as_of()).results.where("in_shortlist").collect()
    got = screen_listed(same, frame.where("id = 3"), "shortlist", as_of()).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, want)) and [r["rank_position"] for r in got] and len(got) < 40
    assert screen_listed(same.where("id < 0"), frame, "shortlist", as_of()).count() == 0


def test_errors_need_no_scores(tables, monkeypatch):
    people, jobs, frame, jds = tables
    monkeypatch.setattr(screening, "score_all", None)
    monkeypatch.setattr(screening, "BLOCK_VACANCIES", 1)
    got = {(r["job_description_id"], r["candidate_id"]) for r in screening_errors(frame, jds).collect()}
    assert got == {(j[0], p[0]) for j in jobs for p in people if j[4] is not None and p[8] is None and not p[9]}
