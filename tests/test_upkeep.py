import datetime

import pytest
from pyspark.sql import functions as F

from rolefit import schemas
from rolefit.operators import filters, reports, upkeep
from rolefit.plans.dashboard import dashboard, summary_export, trends
from rolefit.sources import tables


def at():
    return F.expr("TIMESTAMP_NTZ '2024-01-31 00:00:00'")



def rows_of(df):
    return sorted(tuple(r) for r in df.collect())


def test_overlay_marks_and_touches(spark):
    base = spark.createDataFrame([(1, False, None, None, None), (2, False, None, None, None)],
                                 "id long, is_duplicate boolean, duplicate_of long, duplicate_confidence double, updated_at timestamp_ntz")
    decisions = spark.createDataFrame([(2, True, 1, 0.9), (1, False, None, None)],
                                      "id long, is_duplicate boolean, duplicate_of long, duplicate_confidence double")
    got = {r["id"]: r for r in upkeep.mark_duplicates(base, decisions, at()).collect()}
    assert (got[2]["is_duplicate"], got[2]["duplicate_of"], got[2]["duplicate_confidence"]) == (True, 1, 0.9)
    assert got[2]["updated_at"] == datetime.datetime(2024, 1, 31) and got[1]["updated_at"] is None
    recs = spark.createDataFrame([(1, None), (2, "interested")], "id long, candidate_response string")
    answered = upkeep.save_response(recs, spark.createDataFrame([(1, "no_response")], "id long, candidate_response string"))
    assert rows_of(answered) == [(1, "no_response"), (2, "interested")]


def test_delete_insert_and_checks(spark):
    rows = spark.createDataFrame([(1, 10), (2, 20), (3, 20)], "id long, job long")
    assert rows_of(upkeep.delete_rows(rows, spark.createDataFrame([(2,)], "id long"))) == [(1, 10), (3, 20)]
    assert rows_of(upkeep.delete_rows(rows, spark.createDataFrame([(20,)], "id long"), "job").select("id", "job")) == [(1, 10)]
    new = spark.createDataFrame([(2, 20), (9, 90)], "id long, job long")
    assert rows_of(upkeep.insert_if_absent(new, rows, ["id", "job"])) == [(9, 90)]
    assert rows_of(upkeep.unique_violations(rows, "job")) == [(20, 2)]
    parents = spark.createDataFrame([(10,)], "id long")
    assert rows_of(upkeep.orphans(rows, "job", parents).select("id")) == [(2,), (3,)]


def test_new_ids_follow_order(spark):
    names = spark.createDataFrame([(n,) for n in "dbca"], "path string").repartition(3)
    assert rows_of(upkeep.new_ids(names, 100, F.asc("path")).select("path", "id")) == [("a", 101), ("b", 102), ("c", 103), ("d", 104)]


def test_append_replace_clear_export(spark, tmp_path):
    path = str(tmp_path / "system_config")
    upkeep.append(tables.config_seed(spark, at()), schemas.SYSTEM_CONFIG, path)
    stored = tables.read_table(spark, str(tmp_path), "system_config")
    assert stored.count() == 4 and stored.schema == schemas.SYSTEM_CONFIG
    assert tables.by_id(stored, 2).first()["config_key"] == "default_screening_weights"
    assert [r["id"] for r in tables.scan(stored, "id > 1", [F.desc("id")], 2).collect()] == [4, 3]
    assert tables.query(spark, "SELECT count(*) AS n FROM {t} WHERE id > :low", {"low": 3}, t=stored).first()["n"] == 1
    with pytest.raises(ValueError):
        upkeep.conform(stored.withColumn("nope", F.lit(1)), schemas.SYSTEM_CONFIG)

    results = str(tmp_path / "results")
    make = lambda rows: spark.createDataFrame(rows, "candidate_id long, final_score double, job_description_id long")
    upkeep.replace_partitions(make([(1, 1.0, 1), (2, 2.0, 1), (1, 3.0, 2)]), results)
    upkeep.replace_partitions(make([(7, 9.0, 1)]), results)
    assert rows_of(spark.read.parquet(results).select("job_description_id", "candidate_id")) == [(1, 7), (2, 1)]
    upkeep.clear_table(make([(1, 1.0, 1)]), str(tmp_path / "gone"))
    assert spark.read.parquet(str(tmp_path / "gone")).count() == 0
    upkeep.export_csv(make([(1, 1.5, 1)]).withColumn("v", F.array(F.lit(1))), str(tmp_path / "csv"))
    assert spark.read.option("header", True).csv(str(tmp_path / "csv")).columns == ["candidate_id", "final_score", "job_description_id"]


def test_filters_and_reports(spark):
    day = lambda d: datetime.datetime(2024, 1, d)
    people = spark.createDataFrame([
        (1, "Ann_X", "a@x.org", "1", "py", 4, "email", False, None, None, day(30)),
        (2, "Bob", "", None, None, None, "upload", False, None, None, day(2)),
        (3, "ann", None, None, None, 2, "email", True, 1, 0.9, day(29))],
        "id long, name string, email string, phone string, skills string, experience_years int, source_type string, "
        "is_duplicate boolean, duplicate_of long, duplicate_confidence double, created_at timestamp_ntz")
    assert [r["id"] for r in filters.candidate_search(people, name="ANN", show_duplicates=True).collect()] == [1, 3]
    assert [r["id"] for r in filters.candidate_search(people, name="n_x").collect()] == [1]
    summary = filters.search_summary(people).first()
    assert (summary["found"], summary["avg_experience"], summary["with_email"], summary["duplicates"]) == (3, 2.0, 1, 1)
    assert reports.candidates_in_period(people, 7, at()).first()[0] == 1
    assert rows_of(reports.candidates_by_source(people)) == [("email", 1), ("upload", 1)]
    assert reports.duplicate_rate(people.where("id < 0")).first()[0] == 0.0
    assert reports.duplicate_report(people).first()["original_name"] == "Ann_X"
    results = spark.createDataFrame([
        (1, 1, 90.0, True, True, "hired", day(5)), (2, 1, 70.0, True, False, "pending", day(6))],
        "job_description_id long, candidate_id long, final_score double, in_longlist boolean, in_shortlist boolean, "
        "status string, screened_at timestamp_ntz")
    jobs = spark.createDataFrame([(1, "A", "active"), (2, "B", "closed"), (3, "C", "active")], "id long, title string, status string")
    history = spark.createDataFrame([(1, 1, 90.0, day(30)), (2, 0, 70.0, day(30))],
                                    "job_description_id long, shortlist_count int, avg_score double, executed_at timestamp_ntz")
    assert tuple(reports.funnel(results, people).first()) == (2, 1, 2, 1, 1, 1)
    assert tuple(reports.funnel(results, people, 2).first()) == (2, 1, 1, 0, 0, 0)
    assert tuple(reports.funnel(results.where("false"), people).first()) == (2, 0, 0, 0, 0, 0)
    assert [tuple(r)[1:6] for r in reports.vacancy_summary(jobs, results).orderBy("job_id").collect()] == [(1, 1, 1, 1, 90.0), (3, 0, 0, 0, None)]
    assert reports.screening_stats(results, history).first().asDict() == {
        "screening_runs": 2, "candidates_screened": 1, "avg_score": 80.0, "shortlisted": 1}
    bins = {(r["job_description_id"], r["bin"]) for r in reports.score_histogram(
        results.withColumn("final_score", F.when(F.col("job_description_id") == 1, 100.0).otherwise(-3.0))).collect()}
    assert bins == {(1, 19), (2, 0)}
    kpis = dashboard(people, results, history, jobs, at())
    assert kpis["numbers"].first()["avg_score"] == 80.0
    assert [r["activity_type"] for r in kpis["activity"].collect()] == ["candidate_added", "screening_completed", "screening_completed", "candidate_added"]
    assert rows_of(trends(people, history, 30, at())["daily_screenings"]) == [(datetime.date(2024, 1, 30), 2, 80.0)]
    assert summary_export(people, results, history, at()).first()["Screened Candidates"] == 1
    metric = upkeep.metric_rows(kpis["numbers"], "x", at(), ["hired"]).where("metric_name = 'screened'").first()
    assert (metric["metric_value"], metric["metric_data"]) == (1.0, '{"hired":1}')
