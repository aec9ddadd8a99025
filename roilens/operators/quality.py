"""Constraint audit of the business tables -- one row per rule with the
number of violating rows (0 = satisfied). Replaces the storage engine's
declared PK / UNIQUE / NOT NULL / CHECK / FK enforcement.

Per-row rules (NOT NULL, CHECK) of a table are counted in one pass;
duplicate checks are one grouped aggregation per key (map-side partial
counts); foreign keys are ``left_anti`` joins against the parent key.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _dups(df: DataFrame, keys: list[str]) -> DataFrame:
    """Rows whose key appears more than once (NULL keys excluded)."""
    cond = reduce(lambda a, b: a & b, [F.col(k).isNotNull() for k in keys])
    return (df.where(cond).groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > 1)
            .agg(F.coalesce(F.sum("n"), F.lit(0)).alias("violations")))


def _row_rules(df: DataFrame, table: str, rules: dict) -> DataFrame:
    """All per-row rules of one table (NOT NULL, CHECK) counted in ONE pass,
    then unpivoted to one row per rule."""
    g = df.agg(*[F.count_if(cond).alias(name) for name, cond in rules.items()])
    return g.unpivot([], list(rules), "rule", "violations").select(
        F.lit(table).alias("table_name"), "rule", F.col("violations").cast("bigint").alias("violations"))


def _orphans(child: DataFrame, parent: DataFrame, key: str) -> DataFrame:
    c = child.where(F.col(key).isNotNull()).select(key)
    return c.join(parent.select(key), key, "left_anti").agg(F.count(F.lit(1)).alias("violations"))


def constraint_audit(users: DataFrame, logs: DataFrame, tickets: DataFrame, prs: DataFrame,
                     cache: DataFrame | None = None) -> DataFrame:
    rules: list[tuple[str, str, DataFrame]] = [
        ("users_master", "pk_user_id", _dups(users, ["user_id"])),
        ("users_master", "unique_github_username", _dups(users, ["github_username"])),
        ("ai_usage_logs", "pk_prompt_id", _dups(logs, ["prompt_id"])),
        ("ai_usage_logs", "fk_user_id", _orphans(logs, users, "user_id")),
        ("tickets", "pk_jira_issue_id", _dups(tickets, ["jira_issue_id"])),
        ("tickets", "fk_user_id", _orphans(tickets, users, "user_id")),
        ("pull_requests", "pk_pr_id", _dups(prs, ["pr_id"])),
        ("pull_requests", "fk_user_id", _orphans(prs, users, "user_id")),
    ]
    row_rules = [
        _row_rules(users, "users_master", {
            "not_null_user_id": F.col("user_id").isNull(),
            "not_null_employee_name": F.col("employee_name").isNull(),
            "not_null_department": F.col("department").isNull()}),
        _row_rules(logs, "ai_usage_logs", {"not_null_timestamp": F.col("timestamp").isNull()}),
        _row_rules(tickets, "tickets", {
            "check_period": ~F.coalesce(F.col("period").isin("Before", "After"), F.lit(False))}),
        _row_rules(prs, "pull_requests", {
            "check_period": ~F.coalesce(F.col("period").isin("Before", "After", "Unknown"), F.lit(False))}),
    ]
    if cache is not None:
        rules += [("analytics_cache", "pk_cache_id", _dups(cache, ["cache_id"])),
                  ("analytics_cache", "unique_user_month", _dups(cache, ["user_id", "month_year"])),
                  ("analytics_cache", "fk_user_id", _orphans(cache, users, "user_id"))]
    frames = [f.select(F.lit(t).alias("table_name"), F.lit(r).alias("rule"),
                       F.col("violations").cast("bigint").alias("violations")) for t, r, f in rules]
    return reduce(DataFrame.unionByName, frames + row_rules)
