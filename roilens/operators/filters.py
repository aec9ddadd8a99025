"""Filters F1-F6 (dashboard selections and predicates) as plain ``where``
clauses -- Catalyst pushes them into the Parquet scan."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def filter_departments(df: DataFrame, departments: list[str] | None) -> DataFrame:
    """multi-select; ``None`` keeps everything, an empty list keeps nothing."""
    if departments is None:
        return df
    return df.where(F.col("department").isin(list(departments)))


def filter_period(df: DataFrame, period: str = "Both") -> DataFrame:
    """Before / After / Both."""
    if period in (None, "Both"):
        return df
    return df.where(F.col("period") == period)


def merged_only(df: DataFrame) -> DataFrame:
    """F3."""
    return df.where(F.col("pr_state") == "merged")


def filter_risk(df: DataFrame, mode: str = "scored") -> DataFrame:
    """'scored' (score > 0), 'flagged' (flag = 1), 'high' (High/Critical)."""
    if mode == "scored":
        return df.where(F.col("risk_score") > 0)
    if mode == "flagged":
        return df.where(F.col("risk_flag") == 1)
    if mode == "high":
        return df.where(F.col("risk_level").isin("High", "Critical"))
    raise ValueError(f"unknown risk filter {mode!r}")


def in_review_range(df: DataFrame) -> DataFrame:
    """0 < cycle < 500 and reviews >= 0."""
    c = F.col("cycle_time_hours")
    return df.where((c > 0) & (c < 500) & (F.col("review_count") >= 0))


def not_blank(df: DataFrame, col: str) -> DataFrame:
    """not NULL and not empty."""
    return df.where(F.col(col).isNotNull() & (F.col(col) != ""))
