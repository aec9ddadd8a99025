"""Declared schemas of the business tables (coerced once at ingest)."""

from __future__ import annotations

from pyspark.sql import types as T

S, D, L, I = T.StringType(), T.DoubleType(), T.LongType(), T.IntegerType()
TS = T.TimestampNTZType()


def _st(*fields) -> T.StructType:
    return T.StructType([T.StructField(n, t, True) for n, t in fields])


USERS = _st(("user_id", S), ("employee_name", S), ("department", S), ("role", S), ("license_type", S),
            ("hourly_rate", D), ("ai_adoption_date", T.DateType()), ("employment_status", S),
            ("github_username", S))

USAGE_LOGS = _st(("prompt_id", S), ("user_id", S), ("timestamp", TS), ("department", S), ("model_name", S),
                 ("prompt_text", S), ("token_count", L), ("cost_usd", D), ("risk_flag", I), ("risk_score", D),
                 ("risk_level", S))

TICKETS = _st(("jira_issue_id", S), ("user_id", S), ("department", S), ("created_at", TS), ("resolved_at", TS),
              ("cycle_time_hours", D), ("story_points", I), ("priority", S), ("period", S),
              ("avg_ticket_resolution_hours", D), ("jira_tickets_closed", I))

PULL_REQUESTS = _st(("pr_id", S), ("user_id", S), ("github_username", S), ("repo_name", S), ("repo_full_name", S),
                    ("department", S), ("pr_title", S), ("pr_state", S), ("created_at", TS), ("merged_at", TS),
                    ("cycle_time_hours", D), ("lines_added", L), ("lines_removed", L), ("review_count", L),
                    ("commit_count", L), ("rework_ratio", D), ("period", S))

ANALYTICS_CACHE = _st(("cache_id", S), ("user_id", S), ("department", S), ("month_year", S),
                      ("total_ai_cost", D), ("total_tokens", L), ("tickets_before_avg", D),
                      ("tickets_after_avg", D), ("hours_saved", D), ("dollar_value_saved", D), ("net_roi", D),
                      ("pii_violations", L), ("pr_cycle_time_avg", D), ("dept_risk_score", D),
                      ("computed_at", S))

TABLES: dict[str, T.StructType] = {
    "users_master": USERS,
    "ai_usage_logs": USAGE_LOGS,
    "tickets": TICKETS,
    "pull_requests": PULL_REQUESTS,
    "analytics_cache": ANALYTICS_CACHE,
}

# Raw landed JSON shapes (one PR / one search page per line).
RAW_PR = T.StructType([
    T.StructField("number", L), T.StructField("title", S), T.StructField("state", S),
    T.StructField("created_at", S), T.StructField("updated_at", S), T.StructField("merged_at", S),
    T.StructField("additions", L), T.StructField("deletions", L), T.StructField("review_comments", L),
    T.StructField("commits", L),
    T.StructField("user", T.StructType([T.StructField("login", S)])),
    T.StructField("base", T.StructType([T.StructField("repo", T.StructType([
        T.StructField("name", S), T.StructField("full_name", S)]))])),
])

RAW_TICKET_PAGE = T.StructType([
    T.StructField("total", L), T.StructField("startAt", L),
    T.StructField("issues", T.ArrayType(T.StructType([
        T.StructField("key", S),
        T.StructField("fields", T.StructType([
            T.StructField("created", S), T.StructField("resolutiondate", S),
            T.StructField("priority", T.StructType([T.StructField("name", S)])),
            T.StructField("assignee", T.StructType([T.StructField("displayName", S)])),
            T.StructField("story_points", D),
            T.StructField("status", T.StructType([T.StructField("name", S)])),
        ])),
    ]))),
])
