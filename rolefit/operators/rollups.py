"""Per-day partial results of the reports: merged when read, refreshed for changed days only.

A store is a folder of four small tables, partitioned by day. Counts and sums add up over days. People screened do
not, as one person is screened on many days: their ids are kept as bitmaps (exact, 4 KB per 32,768 ids and day) and
as sketches (approximate, one row per day). Reading a report never touches the tables the store was made of.
"""

from __future__ import annotations

import datetime
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rolefit.functions import scoring
from rolefit.operators.reports import REVIEWED

SKETCH_BITS = 12  # 2^12 registers: a standard error of about 1.6 %
Days = list[datetime.date | None]


def _hundredths(c: str) -> Column:
    return F.floor(F.col(c) * 100.0 + 0.5).cast("long")


def people_days(candidates: DataFrame) -> DataFrame:
    return candidates.groupBy("day").agg(
        F.count("*").alias("n"), F.count_if(~F.col("is_duplicate")).alias("ours"),
        F.count_if("is_duplicate").alias("duplicates"))


def result_days(results: DataFrame) -> DataFrame:
    return results.groupBy("day").agg(
        F.count("*").alias("n"),
        F.sum(_hundredths("final_score")).alias("cents"),
        F.count_if("in_longlist").alias("longlisted"),
        F.count_if("in_shortlist").alias("shortlisted"),
        F.count_if(F.col("status").isin(*REVIEWED)).alias("reviewed"),
        F.count_if(F.col("status") == "hired").alias("hired"),
        F.hll_sketch_agg("candidate_id", SKETCH_BITS).alias("people"))


def screened_bits(results: DataFrame) -> DataFrame:
    """One bitmap per day and block of 32,768 candidate ids; rows without a candidate have no bit.

    Rows go to their block before a bitmap is made: made where the rows lie, every task would hand on nearly all blocks,
    4 KB each, and both tasks and blocks grow with the rows.
    """
    known = results.where(F.col("candidate_id").isNotNull()).select(
        "day", F.bitmap_bucket_number("candidate_id").alias("block"), F.bitmap_bit_position("candidate_id").alias("place"))
    placed = known.repartition(int(results.sparkSession.conf.get("spark.sql.shuffle.partitions")), "day", "block")
    return placed.groupBy("day", "block").agg(F.bitmap_construct_agg("place").alias("bits"))


def run_days(history: DataFrame) -> DataFrame:
    return history.groupBy("day").agg(
        F.count("*").alias("runs"), F.sum(_hundredths("avg_score")).alias("cents"), F.count("avg_score").alias("scored"))


Part = tuple[Callable[[DataFrame], DataFrame], str]
PARTS: dict[str, tuple[str, dict[str, Part]]] = {
    "candidates": ("created_at", {"people_days": (people_days, "n long, ours long, duplicates long, day date")}),
    "results": ("screened_at", {
        "result_days": (result_days, "n long, cents long, longlisted long, shortlisted long, reviewed long, hired long, "
                                     "people binary, day date"),
        "screened_bits": (screened_bits, "block long, bits binary, day date")}),
    "history": ("executed_at", {"run_days": (run_days, "runs long, cents long, scored long, day date")}),
}


def changed_days(rows: DataFrame, source: str) -> Days:
    """Days that added, altered or deleted ``rows`` of ``source`` touch: as many as the calendar has at most.

    An altered time touches two days; give the row as it was and as it is.
    """
    return [r["day"] for r in rows.select(F.to_date(PARTS[source][0]).alias("day")).distinct().collect()]


def _on_days(time: str, days: Days) -> Column:
    """Rows of these days; the range on the time itself is what reaches the scan."""
    known = [d for d in days if d is not None]
    found = F.lit(False)
    if known:
        first, after = min(known), max(known) + datetime.timedelta(days=1)
        span = (F.col(time) >= F.lit(first).cast("timestamp_ntz")) & (F.col(time) < F.lit(after).cast("timestamp_ntz"))
        found = span & F.to_date(time).isin(known)
    return found | F.col(time).isNull() if None in days else found


def refresh(rows: DataFrame, store: str, source: str, days: Days | None = None) -> None:
    """Bring the store's partials of ``source`` ("candidates", "results" or "history") up to its ``rows``.

    Without ``days`` everything is made anew; with them only these days are read and replaced, also days that have
    no row any more. NULL times are a day of their own, ``None``. Running it again leaves the same store.
    """
    time, parts = PARTS[source]
    if days is not None:
        if not days:
            return
        rows = rows.where(_on_days(time, days))
    dated = rows.withColumn("day", F.to_date(time))
    for name, (make, _) in parts.items():
        partial = make(dated)
        write = partial.write
        if days is not None:
            # a row of nulls adds nothing to any sum, but makes a day without rows replace what it held
            blank = rows.sparkSession.createDataFrame([(d,) for d in days], "day date")
            write = partial.unionByName(blank, allowMissingColumns=True).write.option("partitionOverwriteMode", "dynamic")
        write.mode("overwrite").partitionBy("day").parquet(f"{store}/{name}")


def part(spark: SparkSession, store: str, name: str) -> DataFrame:
    schema = next(parts[name][1] for _, parts in PARTS.values() if name in parts)
    return spark.read.schema(schema).parquet(f"{store}/{name}")


def _total(c: str | Column) -> Column:
    return F.coalesce(F.sum(c), F.lit(0))


def _since(days: int, as_of: Column) -> Column:
    return F.col("day") >= F.date_sub(F.to_date(as_of), days)


def screened_people(spark: SparkSession, store: str, approximate: bool = False) -> DataFrame:
    """Distinct candidates with a result, one row ``screened``: by bitmaps, or by merged sketches on request."""
    if approximate:
        merged = part(spark, store, "result_days").agg(F.hll_union_agg("people").alias("people"))
        return merged.select(F.coalesce(F.hll_sketch_estimate("people"), F.lit(0)).cast("long").alias("screened"))
    blocks = part(spark, store, "screened_bits").where(F.col("bits").isNotNull()).groupBy("block").agg(
        F.bitmap_count(F.bitmap_or_agg("bits")).alias("people"))
    return blocks.agg(_total("people").alias("screened"))


def dashboard_row(spark: SparkSession, store: str, as_of: Column, approximate: bool = False) -> DataFrame:
    """The single-number KPIs of ``reports.dashboard_row`` from partials; ``as_of`` counts as its whole day."""
    rate = F.sum("duplicates").cast("double") / F.nullif(F.sum("n"), F.lit(0)) * F.lit(100.0)
    people = part(spark, store, "people_days").agg(
        _total("ours").alias("total_candidates"),
        _total(F.when(_since(30, as_of), F.col("ours"))).alias("candidates_this_month"),
        _total(F.when(_since(7, as_of), F.col("ours"))).alias("candidates_this_week"),
        scoring.round2(F.coalesce(rate, F.lit(0.0))).alias("duplicate_rate"))
    mean = F.sum("cents").cast("double") / F.nullif(F.sum("n"), F.lit(0)) / F.lit(100.0)
    stages = part(spark, store, "result_days").agg(
        *[_total(c).alias(c) for c in ("longlisted", "shortlisted", "reviewed", "hired")],
        F.coalesce(scoring.round2(mean), F.lit(0.0)).alias("avg_score"))
    runs = part(spark, store, "run_days").agg(_total("runs").alias("screening_runs"))
    # four one-row frames
    row = people
    for one in (screened_people(spark, store, approximate), stages, runs):
        row = row.join(F.broadcast(one), F.lit(True))
    return row


def daily_candidates(spark: SparkSession, store: str, days: int, as_of: Column) -> DataFrame:
    rows = part(spark, store, "people_days").where(_since(days, as_of) & (F.col("ours") > 0))
    return rows.select("day", F.col("ours").alias("candidates")).orderBy("day")


def daily_screenings(spark: SparkSession, store: str, days: int, as_of: Column) -> DataFrame:
    mean = F.col("cents").cast("double") / F.nullif(F.col("scored"), F.lit(0)) / F.lit(100.0)
    rows = part(spark, store, "run_days").where(_since(days, as_of) & (F.col("runs") > 0))
    return rows.select("day", F.col("runs").alias("screenings"), mean.alias("avg_score")).orderBy("day")
