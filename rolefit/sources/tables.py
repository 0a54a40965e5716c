"""Stored tables: scans, lookups, parameterised SQL, seed rows."""

from __future__ import annotations

from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rolefit.schemas import SYSTEM_CONFIG, TABLES

# The configuration rows a new installation starts with.
CONFIG_SEED = (
    ("duplicate_threshold", '{"name_similarity": 85, "phone_similarity": 90}', "Thresholds for duplicate detection"),
    ("default_screening_weights", '{"semantic": 0.7, "skill": 0.3, "experience": 0.0}', "Default scoring weights"),
    ("email_fetch_config", '{"fetch_interval_hours": 1, "mark_as_read": false}', "Email fetching configuration"),
    ("ui_settings", '{"items_per_page": 50, "theme": "light"}', "UI preferences"),
)


def read_table(spark: SparkSession, root: str, name: str) -> DataFrame:
    """A stored table with its declared schema."""
    return spark.read.schema(TABLES[name]).parquet(f"{root}/{name}")


def scan(
    df: DataFrame, where: str | Column | None = None, order_by: list[Column] | None = None, limit: int | None = None
) -> DataFrame:
    """Optional filter, order and limit; filters and columns reach the file scan."""
    if where is not None:
        df = df.where(where)
    if order_by:
        df = df.orderBy(*order_by)
    return df.limit(limit) if limit else df


def by_id(df: DataFrame, record_id: int) -> DataFrame:
    return df.where(F.col("id") == F.lit(record_id))


def query(spark: SparkSession, sql: str, params: dict[str, Any] | None = None, **tables: DataFrame) -> DataFrame:
    """SQL text with named parameters (``:name``) and tables (``{name}``) bound, never pasted in."""
    return spark.sql(sql, args=params or {}, **tables)


def config_seed(spark: SparkSession, as_of: Column) -> DataFrame:
    rows = [(i, *row) for i, row in enumerate(CONFIG_SEED, start=1)]
    seed = spark.createDataFrame(rows, "id long, config_key string, config_value string, description string")
    return seed.withColumn("updated_at", as_of.cast("timestamp_ntz")).select(*SYSTEM_CONFIG.names)
