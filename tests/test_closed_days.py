import datetime

from rolefit.streaming.trends import closed_days, daily_counts, late_rows, start_closed_days

SCHEMA = "ts timestamp_ntz, value double"


def deliver(spark, tmp_path, rows):
    """One delivery of (day, value) rows, then the feed over what is new; returns the finished stream."""
    source = str(tmp_path / "source")
    made = [(datetime.datetime(2024, 3, d, 12), v) for d, v in rows]
    spark.createDataFrame(made, SCHEMA).coalesce(1).write.mode("append").parquet(source)
    stream = spark.readStream.schema(SCHEMA).parquet(source)
    query = start_closed_days(daily_counts(stream, "ts", "value", "1 day"), str(tmp_path / "closed"), str(tmp_path / "progress"))
    query.awaitTermination()
    return query


def feed(spark, tmp_path):
    return {r["day"].day: (r["rows"], r["hundredths"]) for r in closed_days(spark, str(tmp_path / "closed")).collect()}


def test_days_close_once_and_late_rows_are_counted(spark, tmp_path):
    query = deliver(spark, tmp_path, [(1, 1.0), (1, 2.5), (2, 1.0), (4, 1.0)])
    assert feed(spark, tmp_path) == {1: (2, 350), 2: (1, 100)}  # the mark is noon of the 3rd
    assert query.lastProgress["stateOperators"][0]["numRowsTotal"] == 1  # only the open day is kept
    # the 1st has closed; the 3rd is still open, though nothing came for it yet; the 2nd's row comes too late too
    query = deliver(spark, tmp_path, [(1, 9.0), (2, -1.0), (2, 1.5), (3, 4.0), (8, 1.0)])
    assert feed(spark, tmp_path) == {1: (2, 350), 2: (1, 100), 3: (1, 400), 4: (1, 100)}
    assert query.lastProgress["stateOperators"][0]["numRowsTotal"] == 1
    closed = closed_days(spark, str(tmp_path / "closed"))
    assert closed.count() == 4  # no day twice
    late = late_rows(spark.read.schema(SCHEMA).parquet(str(tmp_path / "source")), closed, "ts", "value")
    assert sorted((r["day"].day, r["late_rows"], r["late_hundredths"]) for r in late.collect()) == [(1, 1, 900), (2, 2, 50)]


def test_a_day_of_late_rows_only_counts(spark, tmp_path):
    deliver(spark, tmp_path, [(1, 1.0), (9, 1.0)])
    deliver(spark, tmp_path, [(5, 2.0), (12, 1.0)])
    assert feed(spark, tmp_path) == {1: (1, 100), 9: (1, 100)}
    closed = closed_days(spark, str(tmp_path / "closed"))
    late = late_rows(spark.read.schema(SCHEMA).parquet(str(tmp_path / "source")), closed, "ts", "value")
    assert [tuple(r) for r in late.collect()] == [(datetime.date(2024, 3, 5), 1, 200)]


def test_starting_again_without_news_changes_nothing(spark, tmp_path):
    deliver(spark, tmp_path, [(1, 1.0), (1, None), (4, 1.0)])
    before = feed(spark, tmp_path)
    stream = spark.readStream.schema(SCHEMA).parquet(str(tmp_path / "source"))
    start_closed_days(daily_counts(stream, "ts", "value", "1 day"), str(tmp_path / "closed"), str(tmp_path / "progress")).awaitTermination()
    assert feed(spark, tmp_path) == before == {1: (2, 100)}
