"""Ad-hoc SQL with bound parameters over DataFrames.

``run_sql`` binds named parameters (``:name`` markers, never string
interpolation) and passes DataFrames as ``{name}`` table references, so no
global temp views are created and Catalyst optimises the SQL together with
the plans of the input frames.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def run_sql(spark: SparkSession, sql: str, params: dict | None = None, **frames: DataFrame) -> DataFrame:
    return spark.sql(sql, args=params or {}, **frames)


# Department x period PR efficiency for one department (NULL = all), as SQL text.
PR_EFFICIENCY_SQL = """
SELECT department, period,
       count(pr_id) AS pr_count,
       CAST(round(CAST(CAST(sum(CAST(cycle_time_hours AS DECIMAL(18,2))) AS DOUBLE) / count(cycle_time_hours)
            AS DECIMAL(28,8)), 2) AS DOUBLE) AS avg_cycle_hrs,
       count(DISTINCT github_username) AS unique_contributors
FROM {prs}
WHERE pr_state = 'merged' AND period IN ('Before', 'After')
  AND (:department IS NULL OR department = :department)
GROUP BY department, period
"""

# Month x department usage trend from a given month on, as SQL text.
MONTHLY_USAGE_SQL = """
SELECT date_format(timestamp, 'yyyy-MM') AS month_year, department,
       count(prompt_id) AS prompt_count,
       sum(token_count) AS total_tokens,
       count(DISTINCT user_id) AS active_users
FROM {logs}
WHERE timestamp >= CAST(:since AS TIMESTAMP_NTZ)
GROUP BY 1, 2
"""
