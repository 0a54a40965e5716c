"""Ranking within groups of any size."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rolefit.session import new_path, remove, write_stage

#: Rows that a task sorts at most and, while that gives work to all partitions, at least; rows of (partition, group) up to which
#: they are sent to every task.
TASK_ROWS, LEAST_ROWS, FEW_RUNS = 1_000_000, 20_000, 200_000
_ROW_BITS = 33  # monotonically_increasing_id(): partition number above, row number below


def rank_rows(df: DataFrame, group: str, order: list[Column], rank: str = "rank_position", size: str = "group_size") -> DataFrame:
    """Row number (from 1) of every row in its group, and the group's row count.

    A window partitioned by the group would sort one group in one task, and a vacancy's group is
    every candidate there is. Here all rows are range-partitioned on (group, order), so a large group
    or a large tie spreads over many tasks; ``order`` must be a total order, with a unique last key.
    Each row then needs only its place in its partition plus the rows its group has in earlier
    partitions, and the latter come from one small row per (partition, group): at most one per
    partition and one per group. Rows are written before, as sampling the range bounds would make them twice, and the
    sorted rows are written once, because range bounds are sampled and must not change between the two uses. The first of
    these tables is removed when there is the second.
    """
    spark, unranked = df.sparkSession, new_path(df.sparkSession, "unranked")
    df.write.parquet(unranked)
    rows = spark.read.schema(df.schema).parquet(unranked)
    n, partitions = rows.count(), int(spark.conf.get("spark.sql.shuffle.partitions"))
    tasks = max(1, -(-n // TASK_ROWS), min(partitions, -(-n // LEAST_ROWS)))
    laid_out = write_stage(
        rows.repartitionByRange(tasks, F.col(group), *order)
        .sortWithinPartitions(F.col(group), *order)
        .withColumn("_row", F.monotonically_increasing_id()),
        "ranked",
    ).withColumn("_part", F.shiftright("_row", _ROW_BITS))
    remove(spark, unranked)
    runs = laid_out.groupBy(group, "_part").agg(F.count("*").alias("_n"), F.min("_row").alias("_first"))
    earlier = Window.partitionBy(group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    runs = runs.select(
        group, "_part", "_first",
        F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"),
        F.sum("_n").over(Window.partitionBy(group)).alias(size),
    )
    if runs.count() <= FEW_RUNS:
        runs = F.broadcast(runs)  # else all ranked rows would be shuffled once more
    return (
        laid_out.join(runs, [group, "_part"])
        .withColumn(rank, F.col("_before") + F.col("_row") - F.col("_first") + 1)
        .drop("_row", "_part", "_first", "_before")
    )
