"""The dashboard and the trend page as bundles of lazy DataFrames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rolefit.operators import reports


def dashboard(candidates: DataFrame, results: DataFrame, history: DataFrame, jds: DataFrame, as_of: Column) -> dict[str, DataFrame]:
    """All single numbers in one row, plus the source split and the activity feed."""
    return {
        "numbers": reports.dashboard_row(candidates, results, history, as_of),
        "by_source": reports.candidates_by_source(candidates),
        "activity": reports.recent_activity(candidates, history, jds),
    }


def trends(candidates: DataFrame, history: DataFrame, days: int, as_of: Column) -> dict[str, DataFrame]:
    return {
        "daily_candidates": reports.daily_candidates(candidates, days, as_of),
        "daily_screenings": reports.daily_screenings(history, days, as_of),
    }


def summary_export(candidates: DataFrame, results: DataFrame, history: DataFrame, as_of: Column) -> DataFrame:
    """The one-row summary report under its printed headings."""
    row = reports.dashboard_row(candidates, results, history, as_of)
    headings = {
        "total_candidates": "Total Candidates", "candidates_this_month": "Candidates This Month",
        "duplicate_rate": "Duplicate Rate", "screened": "Screened Candidates", "shortlisted": "Shortlisted",
        "avg_score": "Average Score",
    }
    return row.select(*[F.col(c).alias(shown) for c, shown in headings.items()])
