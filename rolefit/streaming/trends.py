"""Daily counts from a stream of rows: all days kept up to date, or each day once when it has closed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

LATENESS = "40 days"


CLOSED_SCHEMA = "day date, rows long, hundredths long, batch_id long"


def _hundredths(value: str) -> Column:
    return F.floor(F.col(value) * 100.0 + 0.5).cast("long")


def daily_counts(rows: DataFrame, time: str, value: str, lateness: str = LATENESS) -> DataFrame:
    """Rows, and sum of ``value`` in hundredths, per day of ``time``.

    State is one row per day: of open days in append mode, of all days in complete mode. Watermarks need an instant: the zone-less wall clock is read as UTC, whatever the session's zone.
    """
    here, utc = F.current_timezone(), F.lit("UTC")
    return (
        rows.withColumn("_at", F.convert_timezone(utc, here, F.col(time)).cast("timestamp"))
        .withWatermark("_at", lateness)
        .groupBy(F.window("_at", "1 day"))
        .agg(F.count("*").alias("rows"), F.sum(_hundredths(value)).alias("hundredths"))
        .select(
            F.to_date(F.convert_timezone(here, utc, F.col("window.start").cast("timestamp_ntz"))).alias("day"),
            "rows", "hundredths")
    )


def start_daily(counts: DataFrame, table: str, checkpoint: str) -> StreamingQuery:
    """Complete mode: after every batch ``table`` holds all days, a small result by construction."""
    def write(days: DataFrame, batch_id: int) -> None:
        days.coalesce(1).write.mode("overwrite").parquet(table)

    return (
        counts.writeStream.outputMode("complete").foreachBatch(write)
        .option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )


def start_closed_days(counts: DataFrame, table: str, checkpoint: str) -> StreamingQuery:
    """Append mode: a day is written once, when the watermark has passed its end, and leaves the state.

    A batch owns the partition with its number and overwrites it, so a batch repeated after a failure adds nothing
    twice and readers never see the table gone. Rows that come after their day has closed are left out;
    ``late_rows`` counts them.
    """
    def write(days: DataFrame, batch_id: int) -> None:
        days.coalesce(1).write.mode("overwrite").parquet(f"{table}/batch_id={batch_id}")

    return (
        counts.writeStream.outputMode("append").foreachBatch(write)
        .option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )


def closed_days(spark: SparkSession, table: str) -> DataFrame:
    return spark.read.schema(CLOSED_SCHEMA).parquet(table)


def late_rows(rows: DataFrame, closed: DataFrame, time: str, value: str) -> DataFrame:
    """Per day up to the newest closed one: rows, and hundredths, that came after the day had closed.

    ``rows`` is the whole source as a table. Days without late rows are left out; a day all of whose rows were late
    is counted, though the feed doesn't have it. A day later than the newest closed one counts once that has closed.
    """
    counted = rows.groupBy(F.to_date(time).alias("day")).agg(
        F.count("*").alias("n"), F.sum(_hundredths(value)).alias("total"))
    newest = closed.agg(F.max("day").alias("newest"))  # one row
    held = counted.join(F.broadcast(newest), F.col("day") <= F.col("newest")).join(closed, "day", "left")
    late = F.col("n") - F.coalesce("rows", F.lit(0))
    missed = F.coalesce("total", F.lit(0)) - F.coalesce("hundredths", F.lit(0))
    return held.select("day", late.alias("late_rows"), missed.alias("late_hundredths")).where(F.col("late_rows") > 0)
