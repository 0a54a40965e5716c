"""Row selections of the search pages, lists and views."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CANDIDATE_VIEW = ("id", "name", "email", "phone", "skills", "experience_years", "source_type", "created_at")
VACANCY_ORDERS = {
    "created_at": lambda: [F.desc("created_at"), F.asc("id")],
    "title": lambda: [F.asc("title"), F.asc("id")],
}
LIST_FLAGS = {"shortlist": "in_shortlist", "longlist": "in_longlist"}


def canonical(df: DataFrame) -> DataFrame:
    """Rows that are not duplicates."""
    return df.where(~F.col("is_duplicate"))


def newest_first(df: DataFrame) -> DataFrame:
    return df.orderBy(F.desc("created_at"), F.asc("id"))


def contains_ci(column: str, needle: str) -> Column:
    """Case-insensitive containment; "%" and "_" typed by the user stay wildcards."""
    return F.col(column).ilike(f"%{needle}%")


def last_days(column: str, days: int, as_of: Column) -> Column:
    """Rows of the last ``days`` days before ``as_of``."""
    return F.col(column) >= as_of - F.make_dt_interval(F.lit(days))


def candidate_search(
    df: DataFrame, name: str | None = None, email: str | None = None, source: str | None = None,
    show_duplicates: bool = False, limit: int | None = 100,
) -> DataFrame:
    """Candidate page: optional name, e-mail and source filters, newest first, one page of rows."""
    if name:
        df = df.where(contains_ci("name", name))
    if email:
        df = df.where(contains_ci("email", email))
    if source:
        df = df.where(F.col("source_type") == source)
    if not show_duplicates:
        df = canonical(df)
    df = newest_first(df)
    return df.limit(limit) if limit else df


def search_summary(page: DataFrame) -> DataFrame:
    """Average experience, rows with an e-mail, duplicates, over the rows of one result page."""
    return page.agg(
        F.count("*").alias("found"),
        F.avg(F.coalesce("experience_years", F.lit(0))).alias("avg_experience"),
        F.count_if(F.col("email") != "").alias("with_email"),
        F.count_if("is_duplicate").alias("duplicates"),
    )


def vacancy_search(df: DataFrame, title: str | None = None, status: str | None = None, sort: str = "created_at") -> DataFrame:
    """Vacancy library with optional title and status filters and one of the known orders."""
    if title:
        df = df.where(contains_ci("title", title))
    if status:
        df = df.where(F.col("status") == status)
    return df.orderBy(*VACANCY_ORDERS[sort]())


def active_candidates(df: DataFrame) -> DataFrame:
    """The standing view of canonical candidates; whoever reads it orders it."""
    return canonical(df).select(*CANDIDATE_VIEW)


def list_rows(results: DataFrame, list_type: str = "all") -> DataFrame:
    """Rows of the short list, the long list, or all rows."""
    return results.where(F.col(LIST_FLAGS[list_type])) if list_type in LIST_FLAGS else results
