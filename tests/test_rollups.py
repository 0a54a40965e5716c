import datetime

from pyspark.sql import functions as F

from rolefit.operators import reports, rollups

AT = datetime.datetime(2024, 1, 31)
PEOPLE = "id long, is_duplicate boolean, created_at timestamp_ntz"
RESULTS = "job_description_id long, candidate_id long, final_score double, in_longlist boolean, in_shortlist boolean, status string, screened_at timestamp_ntz"
HISTORY = "job_description_id long, avg_score double, executed_at timestamp_ntz"


def day(d, hour=0):
    return datetime.datetime(2024, 1, d, hour)


def at():
    return F.expr("TIMESTAMP_NTZ '2024-01-31 00:00:00'")


def tables(spark, people, results, history):
    return spark.createDataFrame(people, PEOPLE), spark.createDataFrame(results, RESULTS), spark.createDataFrame(history, HISTORY)


def filled(store, people, results, history, days=None):
    for source, rows in (("candidates", people), ("results", results), ("history", history)):
        rollups.refresh(rows, store, source, days)


def same_as_scan(spark, store, people, results, history):
    scan = reports.dashboard_row(people, results, history, at()).first().asDict()
    assert rollups.dashboard_row(spark, store, at()).first().asDict() == scan
    for ours, plain in ((rollups.daily_candidates(spark, store, 30, at()), reports.daily_candidates(people, 30, at())),
                        (rollups.daily_screenings(spark, store, 30, at()), reports.daily_screenings(history, 30, at()))):
        assert [tuple(r) for r in ours.collect()] == [tuple(r) for r in plain.collect()]
    return scan


PEOPLE_ROWS = [(1, False, day(2)), (2, True, day(2, 5)), (3, False, day(30, 23)), (4, False, None), (5, None, day(30))]
RESULT_ROWS = [(1, 1, 90.25, True, True, "hired", day(3)), (2, 1, 70.1, True, False, "pending", day(4)),
               (1, 40_000, 10.0, False, False, "rejected", day(3)), (2, -7, None, None, None, None, None),
               (2, 32_768, 0.0, False, False, "reviewed", day(4, 9))]
RUN_ROWS = [(1, 50.13, day(3)), (2, None, day(4)), (2, 35.05, day(3, 12))]


def test_rollups_equal_the_scan(spark, tmp_path):
    given = tables(spark, PEOPLE_ROWS, RESULT_ROWS, RUN_ROWS)
    filled(str(tmp_path), *given)
    scan = same_as_scan(spark, str(tmp_path), *given)
    assert scan["screened"] == 4 and scan["total_candidates"] == 3


def test_only_changed_days_are_replaced(spark, tmp_path):
    store = str(tmp_path)
    filled(store, *tables(spark, PEOPLE_ROWS, RESULT_ROWS, RUN_ROWS))
    stamps = {p: p.stat().st_mtime_ns for p in tmp_path.glob("*/day=2024-01-0[24]/*.parquet")}
    assert stamps
    # the third and the 30th change: one result goes to another candidate, one person and all runs of the 3rd are deleted
    people = [r for r in PEOPLE_ROWS if r[0] != 3] + [(9, True, day(30, 1))]
    results = [(1, 77, 20.5, True, False, "hired", day(3)), *RESULT_ROWS[1:2], *RESULT_ROWS[3:]]
    new = tables(spark, people, results, RUN_ROWS[1:2])
    days = [datetime.date(2024, 1, 3), datetime.date(2024, 1, 30)]
    filled(store, *new, days=days)
    same_as_scan(spark, store, *new)
    assert stamps == {p: p.stat().st_mtime_ns for p in stamps}
    filled(store, *new, days=days)  # a repeated refresh changes nothing
    same_as_scan(spark, store, *new)
    # the day of rows without a time, and no day at all
    gone = tables(spark, [r for r in people if r[2]], [r for r in results if r[6]], RUN_ROWS[1:2])
    filled(store, *gone, days=[])
    filled(store, *gone, days=[None])
    same_as_scan(spark, store, *gone)


def test_changed_days_and_the_filter_on_the_scan(spark, tmp_path):
    people = spark.createDataFrame(PEOPLE_ROWS, PEOPLE)
    days = rollups.changed_days(people, "candidates")
    assert set(days) == {datetime.date(2024, 1, 2), datetime.date(2024, 1, 30), None}
    people.write.parquet(str(tmp_path / "p"))
    read = spark.read.parquet(str(tmp_path / "p")).where(rollups._on_days("created_at", [datetime.date(2024, 1, 2)]))
    plan = read._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(created_at" in plan and "LessThan(created_at" in plan
    assert sorted(r["id"] for r in read.collect()) == [1, 2]


def test_empty_tables(spark, tmp_path):
    given = tables(spark, [], [], [])
    filled(str(tmp_path), *given)
    same_as_scan(spark, str(tmp_path), *given)
    assert rollups.screened_people(spark, str(tmp_path), approximate=True).first()[0] == 0


def test_sketches_stay_within_three_standard_errors(spark, tmp_path):
    ids = spark.range(60_000).select(
        F.lit(1).cast("long").alias("job_description_id"), (F.col("id") % 25_000 * 7919).alias("candidate_id"),
        F.lit(1.0).alias("final_score"), F.lit(True).alias("in_longlist"), F.lit(False).alias("in_shortlist"),
        F.lit("pending").alias("status"), F.timestamp_add("DAY", (F.col("id") % 9).cast("int"), at()).cast("timestamp_ntz").alias("screened_at"))
    rollups.refresh(ids, str(tmp_path), "results")
    exact = rollups.screened_people(spark, str(tmp_path)).first()[0]
    near = rollups.screened_people(spark, str(tmp_path), approximate=True).first()[0]
    assert exact == 25_000 and abs(near - exact) <= 3 * 1.04 / 2 ** (rollups.SKETCH_BITS / 2) * exact
