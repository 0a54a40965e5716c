"""Table upkeep on plain Parquet: appends, overlays, deletes, checks.

Updates never overwrite the files being read: each operator returns the table's next state, which
the caller writes to a new snapshot.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def conform(df: DataFrame, schema: T.StructType) -> DataFrame:
    """Columns of ``schema`` in order, missing ones as NULL; unknown columns are an error."""
    unknown = set(df.columns) - set(schema.names)
    if unknown:
        raise ValueError(f"columns not in the table: {sorted(unknown)}")
    return df.select(*[
        (F.col(f.name) if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in schema])


def append(df: DataFrame, schema: T.StructType, path: str) -> None:
    conform(df, schema).write.mode("append").parquet(path)


def overlay(base: DataFrame, patch: DataFrame, key: str = "id", touched_at: Column | None = None) -> DataFrame:
    """``base`` with the non-NULL values of ``patch`` laid over matching rows.

    ``patch`` has the key and any of the base's columns, one row per key. Patched rows get
    ``updated_at`` set when a time is given.
    """
    changed = [c for c in patch.columns if c != key]
    laid = patch.select(key, *[F.col(c).alias(f"_new_{c}") for c in changed], F.lit(True).alias("_hit"))
    joined = base.join(laid, key, "left")
    out = []
    for c in base.columns:
        value = F.coalesce(f"_new_{c}", c) if c in changed else F.col(c)
        if c == "updated_at" and touched_at is not None:
            value = F.when(F.col("_hit"), touched_at).otherwise(value)
        out.append(value.alias(c))
    return joined.select(*out)


def mark_duplicates(candidates: DataFrame, decisions: DataFrame, touched_at: Column | None = None) -> DataFrame:
    """Candidates with flag, original and confidence set from decisions that found a duplicate."""
    patch = decisions.where("is_duplicate").select(
        "id", F.lit(True).alias("is_duplicate"), "duplicate_of", "duplicate_confidence")
    return overlay(candidates, patch, touched_at=touched_at)


def mark_contacted(recommendations: DataFrame, ids: DataFrame, as_of: Column) -> DataFrame:
    patch = ids.select("id", F.lit(True).alias("was_contacted"), as_of.alias("contacted_at"))
    return overlay(recommendations, patch)


def save_response(recommendations: DataFrame, responses: DataFrame) -> DataFrame:
    return overlay(recommendations, responses.select("id", "candidate_response"))


def delete_rows(df: DataFrame, ids: DataFrame, column: str = "id") -> DataFrame:
    """Rows whose ``column`` is not among ``ids.id``; used alike for dependants (cascade)."""
    return df.join(ids.select(F.col("id").alias(column)).distinct(), column, "left_anti")


def insert_if_absent(new: DataFrame, stored: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of ``new`` whose key is not stored yet; stored rows are never refreshed."""
    return new.join(stored.select(*keys).distinct(), keys, "left_anti")


def replace_partitions(df: DataFrame, path: str, partition: str = "job_description_id") -> None:
    """Replace all rows of the partitions present in ``df``, leaving the others alone.

    Rows are clustered by partition value first, so that no task opens a file for every value; the
    rebalancing splits a large value over as many tasks as its size asks for.
    """
    (df.hint("rebalance", partition)
     .write.option("maxRecordsPerFile", 5_000_000).mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(partition).parquet(path))


def clear_table(df: DataFrame, path: str) -> None:
    """Leave an empty table of the same schema."""
    df.limit(0).write.mode("overwrite").parquet(path)


def vacancies_from_forms(forms: DataFrame, created_at: Column) -> DataFrame:
    """New vacancy rows from form values: title and description required, maximum 0 means none."""
    given = lambda c: F.coalesce(F.col(c), F.lit("")) != ""
    settings = F.to_json(F.struct(
        "semantic_weight", "skill_weight", "experience_weight", "min_score_threshold",
        "longlist_percentage", "shortlist_percentage"))
    return forms.where(given("title") & given("description")).select(
        "title", "description", "department", "location", "required_skills", "required_experience_min",
        F.when(F.col("required_experience_max") > 0, F.col("required_experience_max")).alias("required_experience_max"),
        "required_certifications", "status", settings.alias("matching_config"), created_at.alias("created_at"))


def metric_rows(row: DataFrame, category: str, calculated_at: Column, payload: list[str] | None = None) -> DataFrame:
    """One metric row per numeric column of a KPI row, with a JSON payload of chosen columns."""
    numbers = [f.name for f in row.schema if isinstance(f.dataType, T.NumericType) and f.name not in (payload or [])]
    data = F.to_json(F.struct(*payload)) if payload else F.lit(None).cast("string")
    entries = F.array(*[
        F.struct(F.lit(n).alias("metric_name"), F.col(n).cast("double").alias("metric_value")) for n in numbers])
    return row.select(F.explode(entries).alias("m"), data.alias("metric_data")).select(
        "m.metric_name", F.lit(category).alias("metric_category"), "m.metric_value", "metric_data",
        calculated_at.alias("calculated_at"))


def unique_violations(df: DataFrame, *key: str) -> DataFrame:
    """Keys stored more than once (NULL keys are allowed, as in SQL)."""
    whole = df.where(" AND ".join(f"{k} IS NOT NULL" for k in key))
    return whole.groupBy(*key).agg(F.count("*").alias("rows")).where("rows > 1")


def orphans(child: DataFrame, column: str, parent: DataFrame) -> DataFrame:
    """Child rows whose non-NULL reference has no parent."""
    return child.where(F.col(column).isNotNull()).join(
        parent.select(F.col("id").alias(column)), column, "left_anti")


def new_ids(df: DataFrame, last_id: int, order: Column) -> DataFrame:
    """Sequential ids after ``last_id`` in ``order`` (a unique key), numbered without a global sort task."""
    from rolefit.operators.ranking import rank_rows

    numbered = rank_rows(df.withColumn("_all", F.lit(0)), "_all", [order], rank="_n", size="_size")
    return numbered.withColumn("id", F.lit(last_id).cast("long") + F.col("_n")).drop("_all", "_n", "_size")


def export_csv(df: DataFrame, path: str) -> None:
    """CSV with a header, written in parallel; binary and array columns have no CSV form and are left out."""
    plain = [f.name for f in df.schema if not isinstance(f.dataType, (T.BinaryType, T.ArrayType, T.MapType, T.StructType))]
    df.select(*plain).write.mode("overwrite").option("header", True).option("escape", '"').csv(path)
