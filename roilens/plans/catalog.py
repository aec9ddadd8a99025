"""Registered queries: one Spark plan per operator and, where SQL can express
it, an independent DuckDB oracle over the same canonical tables.

Every query reads the driver tables of ``sf_dir`` (through the canonical
mapping) -- nothing runs on made-up input.
"""

from __future__ import annotations

from typing import Callable

from pyspark.sql import DataFrame, SparkSession

from .. import params as P
from .inputs import Inputs
from .oracle import EM, ES, RD, oracle

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn
    return deco


def _I(spark, sf) -> Inputs:
    return Inputs(spark, sf)


# ---------------------------------------------------------------- A1 (Q1)

@register("user_roi_sql", oracle(["users_master", "logs_c", "tickets"], f"""
select u.user_id, u.employee_name, u.department, u.role, u.hourly_rate, u.license_type, u.github_username,
  coalesce(c.total_cost, 0) as total_ai_cost, coalesce(c.total_tokens, 0) as total_tokens,
  coalesce(c.prompt_count, 0) as total_prompts,
  coalesce(jb.avg_cycle, 0) as avg_cycle_before_hrs, coalesce(jb.n, 0) as tickets_before,
  coalesce(ja.avg_cycle, 0) as avg_cycle_after_hrs, coalesce(ja.n, 0) as tickets_after,
  {RD('coalesce(jb.avg_cycle,0) - coalesce(ja.avg_cycle,0)', 2)} as hours_saved_per_ticket,
  {RD('(coalesce(jb.avg_cycle,0) - coalesce(ja.avg_cycle,0)) / nullif(coalesce(jb.avg_cycle,0),0) * 100', 1)} as pct_improvement,
  {RD('(coalesce(jb.avg_cycle,0) - coalesce(ja.avg_cycle,0)) * coalesce(ja.n,0) * u.hourly_rate', 2)} as dollar_value_saved,
  {RD('(coalesce(jb.avg_cycle,0) - coalesce(ja.avg_cycle,0)) * coalesce(ja.n,0) * u.hourly_rate - coalesce(c.total_cost,0)', 2)} as net_roi
from users_master u
left join (select user_id, {ES('cost_usd', 6)} as total_cost, cast(sum(token_count) as bigint) as total_tokens,
           count(prompt_id) as prompt_count from logs_c group by user_id) c on c.user_id = u.user_id
left join (select user_id, {EM('cycle_time_hours', 2)} as avg_cycle, count(*) as n
           from tickets where period = 'Before' group by user_id) jb on jb.user_id = u.user_id
left join (select user_id, {EM('cycle_time_hours', 2)} as avg_cycle, cast(sum(jira_tickets_closed) as bigint) as n
           from tickets where period = 'After' group by user_id) ja on ja.user_id = u.user_id
"""))
def q_user_roi_sql(spark, sf):
    from ..operators.roi import user_roi
    i = _I(spark, sf)
    return user_roi(i.users(), i.logs_cost(), i.tickets())


# ---------------------------------------------------------------- PR family

_MERGED_BA = "pr_state = 'merged' and period in ('Before','After')"


@register("pr_efficiency", oracle(["prs"], f"""
select department, period, count(pr_id) as pr_count,
  {RD(EM('cycle_time_hours', 2), 2)} as avg_cycle_hrs,
  {RD(EM('rework_ratio', 3), 3)} as avg_rework_ratio,
  {RD('avg(review_count)', 1)} as avg_reviews,
  count(distinct github_username) as unique_contributors,
  cast(sum(lines_added) as bigint) as total_lines_added, cast(sum(lines_removed) as bigint) as total_lines_removed
from prs where {_MERGED_BA} group by department, period"""))
def q_pr_efficiency(spark, sf):
    from ..operators.pulls import pr_efficiency
    return pr_efficiency(_I(spark, sf).pull_requests())


@register("pr_delta_sql", oracle(["prs"], f"""
select b.department, {RD('b.c', 2)} as before_avg_hrs, {RD('a.c', 2)} as after_avg_hrs,
  {RD('b.c - a.c', 2)} as hours_saved, {RD('(b.c - a.c) / nullif(b.c, 0) * 100', 1)} as pct_improvement,
  {RD('b.r - a.r', 3)} as rework_improvement, b.n as before_prs, a.n as after_prs
from (select department, {EM('cycle_time_hours', 2)} as c, {EM('rework_ratio', 3)} as r, count(*) as n
      from prs where period = 'Before' and pr_state = 'merged' group by department) b
join (select department, {EM('cycle_time_hours', 2)} as c, {EM('rework_ratio', 3)} as r, count(*) as n
      from prs where period = 'After' and pr_state = 'merged' group by department) a on b.department = a.department"""))
def q_pr_delta_sql(spark, sf):
    from ..operators.pulls import pr_delta_sql
    return pr_delta_sql(_I(spark, sf).pull_requests())


@register("repo_stats", oracle(["prs"], f"""
select repo_full_name, repo_name, department, period, count(pr_id) as pr_count,
  {RD(EM('cycle_time_hours', 2), 2)} as avg_cycle_hrs,
  {RD('quantile_cont(cycle_time_hours, 0.5)', 2)} as median_cycle_hrs,
  {RD(EM('rework_ratio', 3), 3)} as avg_rework,
  count(distinct github_username) as contributors,
  cast(sum(lines_added) as bigint) as total_additions, cast(sum(lines_removed) as bigint) as total_deletions
from prs where pr_state = 'merged' group by repo_full_name, repo_name, department, period"""))
def q_repo_stats(spark, sf):
    from ..operators.pulls import repo_stats
    return repo_stats(_I(spark, sf).pull_requests())


@register("top_contributors_sql", oracle(["prs"], f"""
select github_username, min(department) as department, count(pr_id) as prs_merged,
  {RD(EM('cycle_time_hours', 2), 2)} as avg_cycle_hrs, {RD(EM('rework_ratio', 3), 3)} as avg_rework,
  count(distinct repo_name) as repos_contributed, cast(sum(lines_added) as bigint) as total_lines_added
from prs where pr_state = 'merged' and period = 'After' group by github_username
order by prs_merged desc, github_username asc nulls last limit 20"""))
def q_top_contributors_sql(spark, sf):
    from ..operators.pulls import top_contributors_sql
    return top_contributors_sql(_I(spark, sf).pull_requests())


_PERF = f"""select department, period, count(pr_id) as pr_count,
  {RD(EM('cycle_time_hours', 2), 2)} as avg_cycle_hours,
  {RD('quantile_cont(cycle_time_hours, 0.5)', 2)} as median_cycle_hours,
  {RD('quantile_cont(cycle_time_hours, 0.9)', 2)} as p90_cycle_hours,
  {RD(EM('rework_ratio', 3), 2)} as avg_rework_ratio,
  {RD('avg(review_count)', 2)} as avg_review_count, {RD('avg(commit_count)', 2)} as avg_commits,
  cast(sum(lines_added) as bigint) as total_lines_added, cast(sum(lines_removed) as bigint) as total_lines_removed,
  count(distinct github_username) as unique_contributors
from prs_e where period in ('Before','After') and department is not null group by department, period"""


@register("pr_performance", oracle(["prs_e"], _PERF))
def q_pr_performance(spark, sf):
    from ..operators.pulls import pr_performance
    return pr_performance(_I(spark, sf).pull_requests_enriched())


@register("pr_delta", oracle(["prs_e"], f"""
, s as ({_PERF}),
d as (select department,
  coalesce(max(case when period='Before' then avg_cycle_hours end), 0) as before_avg,
  coalesce(max(case when period='Before' then median_cycle_hours end), 0) as before_median,
  coalesce(max(case when period='Before' then avg_rework_ratio end), 0) as before_rework,
  cast(coalesce(max(case when period='Before' then pr_count end), 0) as bigint) as before_prs,
  coalesce(max(case when period='After' then avg_cycle_hours end), 0) as after_avg,
  coalesce(max(case when period='After' then median_cycle_hours end), 0) as after_median,
  coalesce(max(case when period='After' then avg_rework_ratio end), 0) as after_rework,
  cast(coalesce(max(case when period='After' then pr_count end), 0) as bigint) as after_prs,
  cast(coalesce(max(case when period='After' then unique_contributors end), 0) as bigint) as contributors
  from s group by department)
select *, greatest(before_avg - after_avg, 0) as hours_saved,
  {RD('coalesce(greatest(before_avg - after_avg, 0) / nullif(before_avg, 0) * 100, 0)', 1)} as pct_improvement,
  {RD('coalesce((before_rework - after_rework) / nullif(before_rework, 0) * 100, 0)', 1)} as rework_improvement_pct
from d""".replace("\n, s as", ", s as", 1)))
def q_pr_delta(spark, sf):
    from ..operators.pulls import pr_delta, pr_performance
    return pr_delta(pr_performance(_I(spark, sf).pull_requests_enriched()))


@register("repo_breakdown", oracle(["prs_e"], f"""
select repo_name, department, period, count(pr_id) as pr_count,
  {RD(EM('cycle_time_hours', 2), 2)} as avg_cycle, {RD(EM('rework_ratio', 3), 2)} as avg_rework,
  count(distinct github_username) as contributors
from prs_e where repo_name is not null and department is not null and period is not null
group by repo_name, department, period"""))
def q_repo_breakdown(spark, sf):
    from ..operators.pulls import repo_breakdown
    return repo_breakdown(_I(spark, sf).pull_requests_enriched())


@register("pr_sync_summary", oracle(["prs_e"], f"""
select department, period, count(pr_id) as pr_count,
  {RD(EM('cycle_time_hours', 2), 2)} as avg_cycle_hrs, {RD(EM('rework_ratio', 3), 2)} as avg_rework,
  count(distinct github_username) as unique_contributors
from prs_e where department is not null and period is not null group by department, period"""))
def q_pr_sync_summary(spark, sf):
    from ..operators.pulls import pr_sync_summary
    return pr_sync_summary(_I(spark, sf).pull_requests_enriched())


@register("top_contributors", oracle(["prs_e"], f"""
select github_username, department, count(pr_id) as total_prs,
  {RD(EM('cycle_time_hours', 2), 2)} as avg_cycle, {RD(EM('rework_ratio', 3), 2)} as avg_rework,
  cast(sum(lines_added) as bigint) as total_lines, count(distinct repo_name) as repos
from prs_e where pr_state = 'merged' and github_username is not null and department is not null
group by github_username, department order by total_prs desc, github_username, department limit 15"""))
def q_top_contributors(spark, sf):
    from ..operators.pulls import top_contributors
    return top_contributors(_I(spark, sf).pull_requests_enriched())


@register("pr_velocity_monthly", oracle(["prs_e"], f"""
select strftime(merged_at, '%Y-%m') as month, department, count(pr_id) as pr_count,
  {RD(EM('cycle_time_hours', 2), 2)} as avg_cycle, {RD(EM('rework_ratio', 3), 2)} as avg_rework
from prs_e where merged_at is not null and department is not null group by 1, 2"""))
def q_pr_velocity_monthly(spark, sf):
    from ..operators.pulls import pr_velocity_monthly
    return pr_velocity_monthly(_I(spark, sf).pull_requests_enriched())


# ---------------------------------------------------------------- tickets

@register("ticket_cycle_backfill", oracle(["tickets"], """
select jira_issue_id, case when cycle_time_hours = 0
   then greatest(coalesce(date_diff('microsecond', created_at, resolved_at)/3600000000, 0.0), 0.0)
   else cycle_time_hours end as cycle_time_hours
from tickets"""))
def q_ticket_cycle_backfill(spark, sf):
    from ..operators.tickets import backfill_cycle
    return backfill_cycle(_I(spark, sf).tickets()).select("jira_issue_id", "cycle_time_hours")


@register("dept_performance", oracle(["tickets"], f"""
select department, {EM("case when period='Before' then cycle_time_hours end", 2)} as before_mean,
  quantile_cont(cycle_time_hours, 0.5) filter (where period='Before') as before_median,
  nullif(count(cycle_time_hours) filter (where period='Before'), 0) as before_count,
  {EM("case when period='After' then cycle_time_hours end", 2)} as after_mean,
  quantile_cont(cycle_time_hours, 0.5) filter (where period='After') as after_median,
  nullif(count(cycle_time_hours) filter (where period='After'), 0) as after_count,
  case when {EM("case when period='Before' then cycle_time_hours end", 2)} - {EM("case when period='After' then cycle_time_hours end", 2)} is null then null
       else greatest({EM("case when period='Before' then cycle_time_hours end", 2)} - {EM("case when period='After' then cycle_time_hours end", 2)}, 0.0) end as hours_saved_mean,
  case when quantile_cont(cycle_time_hours, 0.5) filter (where period='Before') - quantile_cont(cycle_time_hours, 0.5) filter (where period='After') is null then null
       else greatest(quantile_cont(cycle_time_hours, 0.5) filter (where period='Before') - quantile_cont(cycle_time_hours, 0.5) filter (where period='After'), 0.0) end as hours_saved_median,
  {RD("coalesce(greatest(" + EM("case when period='Before' then cycle_time_hours end", 2) + " - " + EM("case when period='After' then cycle_time_hours end", 2) + ", 0.0) / nullif(" + EM("case when period='Before' then cycle_time_hours end", 2) + ", 0) * 100, 0.0)", 1)} as pct_improvement
from tickets where department is not null and period in ('Before','After') group by department"""))
def q_dept_performance(spark, sf):
    from ..operators.tickets import dept_performance
    return dept_performance(_I(spark, sf).tickets())


_VEL = f"""select department, period, count(jira_issue_id) as total_tickets,
  cast(sum(story_points) as bigint) as total_story_points,
  {RD(EM('cycle_time_hours', 2), 2)} as avg_cycle_hours,
  {RD('quantile_cont(cycle_time_hours, 0.5)', 2)} as median_cycle_hours,
  {RD('quantile_cont(cycle_time_hours, 0.9)', 2)} as p90_cycle_hours
from tickets where department is not null and period is not null group by department, period"""


@register("ticket_velocity", oracle(["tickets"], _VEL))
def q_ticket_velocity(spark, sf):
    from ..operators.tickets import velocity
    return velocity(_I(spark, sf).tickets())


@register("throughput_delta", oracle(["tickets"], f"""
, v as ({_VEL}),
d as (select department,
  coalesce(max(case when period='Before' then avg_cycle_hours end), 0)::double as before_cycle,
  coalesce(max(case when period='After' then avg_cycle_hours end), 0)::double as after_cycle,
  coalesce(max(case when period='Before' then total_story_points end), 0)::bigint as before_points,
  coalesce(max(case when period='After' then total_story_points end), 0)::bigint as after_points
  from v group by department)
select *, {RD('coalesce((before_cycle - after_cycle) / nullif(before_cycle, 0) * 100, 0.0)', 1)} as cycle_improvement_pct,
  {RD('coalesce(cast(after_points - before_points as double) / nullif(before_points, 0) * 100, 0.0)', 1)} as throughput_lift_pct
from d"""))
def q_throughput_delta(spark, sf):
    from ..operators.tickets import throughput_delta, velocity
    return throughput_delta(velocity(_I(spark, sf).tickets()))


@register("priority_breakdown", oracle(["tickets"], """
select department, priority, period, count(jira_issue_id) as ticket_count from tickets
where department is not null and priority is not null and period is not null group by all"""))
def q_priority_breakdown(spark, sf):
    from ..operators.tickets import priority_breakdown
    return priority_breakdown(_I(spark, sf).tickets())


@register("resolution_heatmap", oracle(["tickets"], "select department, " + ", ".join(
    f"{RD('coalesce(' + EM(f'case when priority = {chr(39)}{p}{chr(39)} then cycle_time_hours end', 2) + ', 0.0)', 2)} as \"{p}\""
    for p in ("Low", "Medium", "High", "Critical")) + " from tickets where department is not null group by department"))
def q_resolution_heatmap(spark, sf):
    from ..operators.tickets import resolution_heatmap
    return resolution_heatmap(_I(spark, sf).tickets())


@register("cycle_by_period", oracle(["tickets"], f"""
select department, period, {RD(EM('cycle_time_hours', 2), 1)} as mean_hours from tickets
where department is not null and period is not null group by department, period"""))
def q_cycle_by_period(spark, sf):
    from ..operators.tickets import cycle_by_period
    return cycle_by_period(_I(spark, sf).tickets())


@register("points_vs_cycle", oracle(["tickets"], f"""
select period, cast(regr_count(cycle_time_hours, story_points::double) as bigint) as n,
  {RD('regr_slope(cycle_time_hours, story_points::double)', 4)} as slope,
  {RD('regr_intercept(cycle_time_hours, story_points::double)', 4)} as intercept,
  {RD('regr_r2(cycle_time_hours, story_points::double)', 4)} as r_squared
from tickets where story_points > 0 and cycle_time_hours > 0 and period is not null group by period"""))
def q_points_vs_cycle(spark, sf):
    from ..operators.tickets import points_vs_cycle
    return points_vs_cycle(_I(spark, sf).tickets())


@register("priority_counts", oracle(["tickets"], """
select priority, period, count(jira_issue_id) as "count" from tickets
where priority is not null and period is not null group by priority, period"""))
def q_priority_counts(spark, sf):
    from ..operators.tickets import priority_counts
    return priority_counts(_I(spark, sf).tickets())


# ---------------------------------------------------------------- usage

@register("prompt_cost", oracle(["logs_c"], "select prompt_id, model_name, token_count, cost_usd from logs_c"))
def q_prompt_cost(spark, sf):
    return _I(spark, sf).logs_cost().select("prompt_id", "model_name", "token_count", "cost_usd")


@register("enrich_usage", oracle(["logs_e"], """
select prompt_id, user_id, department, employee_name, role, license_type, hourly_rate, github_username,
  cast(timestamp as date) as date, cast(hour(timestamp) as integer) as hour, dayname(timestamp) as day_name,
  cast(weekofyear(timestamp) as integer) as week, strftime(timestamp, '%Y-%m') as month_year from logs_e"""))
def q_enrich_usage(spark, sf):
    from ..operators.usage import enrich_usage
    i = _I(spark, sf)
    return enrich_usage(i.logs(), i.users()).select(
        "prompt_id", "user_id", "department", "employee_name", "role", "license_type", "hourly_rate",
        "github_username", "date", "hour", "day_name", "week", "month_year")


@register("monthly_dept_trend", oracle(["logs_s"], f"""
select strftime(timestamp, '%Y-%m') as month_year, department, count(prompt_id) as prompt_count,
  cast(sum(token_count) as bigint) as total_tokens, {RD(ES('cost_usd', 6), 4)} as total_cost,
  count(distinct user_id) as active_users, cast(sum(risk_flag) as bigint) as pii_violations
from logs_s group by 1, 2"""))
def q_monthly_dept_trend(spark, sf):
    from ..operators.usage import monthly_dept_trend
    return monthly_dept_trend(_I(spark, sf).logs())


@register("monthly_trend", oracle(["logs_e"], f"""
, m as (select strftime(timestamp, '%Y-%m') as month_year, {ES('cost_usd', 6)} as total_cost,
  cast(sum(token_count) as bigint) as total_tokens, count(distinct user_id) as active_users, count(prompt_id) as prompt_count
  from logs_e where timestamp is not null group by 1)
select *, {RD('(total_cost - lag(total_cost) over (order by month_year)) / nullif(lag(total_cost) over (order by month_year), 0) * 100', 1)}
  as cost_mom_pct from m"""))
def q_monthly_trend(spark, sf):
    from ..operators.usage import monthly_trend
    return monthly_trend(_enriched(spark, sf))


def _enriched(spark, sf):
    return _I(spark, sf).logs_enriched()


@register("daily_trend", oracle(["logs_e"], f"""
select cast(timestamp as date) as date, {ES('cost_usd', 6)} as cost, cast(sum(token_count) as bigint) as tokens
from logs_e where timestamp is not null group by 1"""))
def q_daily_trend(spark, sf):
    from ..operators.usage import daily_trend
    return daily_trend(_enriched(spark, sf))


@register("dept_spend", oracle(["logs_e"], f"""
select department, {ES('cost_usd', 6)} as cost_usd from logs_e where department is not null group by 1"""))
def q_dept_spend(spark, sf):
    from ..operators.usage import dept_spend
    return dept_spend(_enriched(spark, sf))


@register("weekday_volume", oracle(["logs_e"], """
select d.day, coalesce(c.events, 0) as events
from (values ('Monday'),('Tuesday'),('Wednesday'),('Thursday'),('Friday'),('Saturday'),('Sunday')) d(day)
left join (select dayname(timestamp) as day, count(prompt_id) as events from logs_e
           where timestamp is not null group by 1) c on c.day = d.day"""))
def q_weekday_volume(spark, sf):
    from ..operators.usage import weekday_volume
    return weekday_volume(_enriched(spark, sf))


@register("active_users", oracle(["logs_e"], """
select department, count(distinct user_id) as active_users from logs_e where department is not null group by 1"""))
def q_active_users(spark, sf):
    from ..operators.usage import active_users
    return active_users(_enriched(spark, sf))


@register("day_hour_heatmap", oracle(["logs_e"], "select dayname(timestamp) as day_name, " + ", ".join(
    f"count(*) filter (where hour(timestamp) = {h}) as h{h:02d}" for h in range(24))
    + " from logs_e where timestamp is not null group by 1"))
def q_day_hour_heatmap(spark, sf):
    from ..operators.usage import day_hour_heatmap
    return day_hour_heatmap(_enriched(spark, sf))


@register("model_usage", oracle(["logs_e"], f"""
select model_name, count(prompt_id) as requests, {ES('cost_usd', 6)} as total_cost from logs_e
where model_name is not null group by 1"""))
def q_model_usage(spark, sf):
    from ..operators.usage import model_usage
    return model_usage(_enriched(spark, sf))


@register("dept_model_cost", oracle(["logs_e"], f"""
select department, model_name, {ES('cost_usd', 6)} as cost_usd from logs_e
where department is not null and model_name is not null group by 1, 2"""))
def q_dept_model_cost(spark, sf):
    from ..operators.usage import dept_model_cost
    return dept_model_cost(_enriched(spark, sf))


@register("token_histogram", oracle(["logs_e"], """
, t as (select token_count::double as t from logs_e where token_count > 0),
b as (select min(t) as lo, max(t) as hi from t),
x as (select case when hi = lo then 0 else least(cast(floor((t - lo) / ((hi - lo) / 40)) as integer), 39) end as bin, count(*) as n
      from t, b group by 1)
select cast(g.bin as integer) as bin, lo + g.bin * (hi - lo) / 40 as bin_start, lo + (g.bin + 1) * (hi - lo) / 40 as bin_end,
  coalesce(x.n, 0) as "count"
from range(40) g(bin) cross join b left join x on x.bin = g.bin where lo is not null"""))
def q_token_histogram(spark, sf):
    from ..operators.usage import token_histogram
    return token_histogram(_enriched(spark, sf))


@register("token_median", oracle(["logs_e"], """
select median(token_count) as median_tokens from logs_e where token_count > 0"""))
def q_token_median(spark, sf):
    from ..operators.usage import token_median
    return token_median(_enriched(spark, sf))


@register("usage_header", oracle(["logs_e"], """
select count(*) as usage_events, count(distinct user_id) as active_users from logs_e"""))
def q_usage_header(spark, sf):
    from ..operators.usage import usage_header
    return usage_header(_enriched(spark, sf))


@register("department_domain", oracle(["users_master"], """
select distinct department from users_master where department is not null"""))
def q_department_domain(spark, sf):
    from ..operators.usage import department_domain
    return department_domain(_I(spark, sf).users())


# ---------------------------------------------------------------- governance

from .oracle import M12, level_sql, pii_types_sql  # noqa: E402


@register("pii_detect", oracle(["ai_usage_logs"], "select prompt_id, " + ", ".join(
    f"coalesce(regexp_matches(prompt_text, '{pat}'), false) as has_{n}"
    for n, pat in __import__('roilens.params', fromlist=['x']).PII_PATTERNS) + " from ai_usage_logs"))
def q_pii_detect(spark, sf):
    from ..operators.governance import detect_pii
    out = detect_pii(_I(spark, sf).logs_raw())
    return out.select("prompt_id", *[c for c in out.columns if c.startswith("has_")])


def _kw_list_sql():
    from .. import params as P
    return "[" + ", ".join(f"'{k}'" for k in P.SENSITIVE_KEYWORDS) + "]"


@register("keyword_scan", oracle(["ai_usage_logs"], f"""
select prompt_id, array_to_string(list_filter({_kw_list_sql()}, lambda k: coalesce(contains(lower(prompt_text), k), false)), ',') as keywords,
  cast(len(list_filter({_kw_list_sql()}, lambda k: coalesce(contains(lower(prompt_text), k), false))) as integer) as keyword_count
from ai_usage_logs"""))
def q_keyword_scan(spark, sf):
    from pyspark.sql import functions as F
    from ..operators.governance import keyword_scan
    out = keyword_scan(_I(spark, sf).logs_raw())
    return out.select("prompt_id", F.array_join("keywords", ",").alias("keywords"), "keyword_count")


@register("prompt_risk", oracle(["logs_s"], f"""
select prompt_id, risk_score, risk_level, risk_flag, {pii_types_sql()} as pii_types from logs_s"""))
def q_prompt_risk(spark, sf):
    from pyspark.sql import functions as F
    from ..operators.governance import prompt_risk
    out = prompt_risk(_I(spark, sf).logs_raw())
    return out.select("prompt_id", "risk_score", "risk_level", "risk_flag",
                      F.array_join("pii_types", "|").alias("pii_types"))


@register("scan_logs", oracle(["logs_s"], f"""
select prompt_id, risk_score, risk_level, risk_flag, {pii_types_sql()} as pii_types from logs_s"""))
def q_scan_logs(spark, sf):
    from pyspark.sql import functions as F
    from ..operators.governance import scan_logs
    out = scan_logs(_I(spark, sf).logs_raw(), dedupe=True)
    return out.withColumn("pii_types", F.array_join("pii_types", "|"))


@register("risk_level", oracle(["logs_s"], f"""
select prompt_id, risk_score, {level_sql('risk_score')} as risk_level, cast(risk_score >= 25 as integer) as risk_flag
from logs_s"""))
def q_risk_level(spark, sf):
    from ..functions.risk import risk_flag, risk_level
    lg = _I(spark, sf).logs()
    return lg.select("prompt_id", "risk_score", risk_level("risk_score").alias("risk_level"),
                     risk_flag("risk_score").alias("risk_flag"))


def _redact_sql(t: str) -> str:
    from .. import params as P
    out = t
    for n, pat in P.PII_PATTERNS:
        out = f"regexp_replace({out}, '{pat}', '{P.REDACTION_TOKENS[n]}', 'g')"
    return out


@register("redact_text", oracle(["ai_usage_logs"], f"""
select prompt_id, {_redact_sql('prompt_text')} as prompt_text from ai_usage_logs"""))
def q_redact_text(spark, sf):
    from pyspark.sql import functions as F
    from ..functions.risk import redact
    from ..operators.governance import by_distinct_text
    logs = _I(spark, sf).logs_raw().select("prompt_id", "prompt_text")
    out = by_distinct_text(logs, "prompt_text", lambda d: d.withColumn("redacted", redact(F.col("_t"))))
    return out.select("prompt_id", F.col("redacted").alias("prompt_text"))


PSEUDONYM_SALT = "roilens-check-salt"


@register("pseudonymise", oracle(["users_master"], f"""
select user_id, 'USR_' || upper(substr(sha256('{PSEUDONYM_SALT}' || ':' || user_id), 1, 12)) as pseudonym
from users_master"""))
def q_pseudonymise(spark, sf):
    from pyspark.sql import functions as F
    from ..functions.risk import pseudonym
    return _I(spark, sf).users().select("user_id", pseudonym(F.col("user_id"), PSEUDONYM_SALT).alias("pseudonym"))


@register("redact_frame", oracle(["ai_usage_logs"], f"""
select prompt_id, 'USR_' || upper(substr(sha256('{PSEUDONYM_SALT}' || ':' || user_id), 1, 12)) as user_id,
  {_redact_sql('prompt_text')} as prompt_text from ai_usage_logs"""))
def q_redact_frame(spark, sf):
    from ..operators.governance import redact_frame
    lg = _I(spark, sf).logs_raw().select("prompt_id", "user_id", "prompt_text")
    return redact_frame(lg, "prompt_text", "user_id", pseudonymise=True, salt=PSEUDONYM_SALT)


@register("apply_risk_update", oracle(["ai_usage_logs", "logs_s"], """
select l.prompt_id, s.risk_score, s.risk_level, s.risk_flag from ai_usage_logs l
left join logs_s s on s.prompt_id = l.prompt_id"""))
def q_apply_risk_update(spark, sf):
    from pyspark.sql import functions as F
    from ..operators.governance import apply_risk_update, scan_logs
    i = _I(spark, sf)
    stored = i.logs_raw().select("prompt_id", F.lit(0.0).alias("risk_score"), F.lit("Low").alias("risk_level"),
                                 F.lit(0).alias("risk_flag"))
    upd = scan_logs(i.logs_raw(), dedupe=True).where("risk_score > 0").drop("pii_types")  # all others keep what is stored
    return apply_risk_update(stored, upd).select("prompt_id", "risk_score", "risk_level", "risk_flag")


@register("worst_prompts", oracle(["logs_s"], """
select prompt_id, user_id, department, model_name, timestamp, risk_score, risk_level,
  substr(prompt_text, 1, 100) || '...' as prompt_preview
from logs_s where risk_score > 0 order by risk_score desc, prompt_id limit 25"""))
def q_worst_prompts(spark, sf):
    from ..operators.governance import worst_prompts
    return worst_prompts(_I(spark, sf).logs())


@register("incident_log", oracle(["logs_e"], f"""
select user_id, department, model_name, risk_level, {RD('risk_score', 1)} as risk_score,
  substr(prompt_text, 1, 80) || '…' as prompt_text, timestamp
from logs_e where risk_score > 0 order by risk_score desc, prompt_id limit 20"""))
def q_incident_log(spark, sf):
    from ..operators.governance import incident_log
    return incident_log(_enriched(spark, sf))


@register("risk_rollup", oracle(["logs_e"], f"""
select department, risk_level, {ES('risk_score', 1)} as total_risk,
  grouping(department, risk_level) as grouping_level
from logs_e where risk_score > 0 group by rollup(department, risk_level)"""))
def q_risk_rollup(spark, sf):
    from ..operators.governance import risk_rollup
    return risk_rollup(_enriched(spark, sf))


@register("corporate_risk", oracle(["logs_e"], f"""
select coalesce({RD(EM('case when risk_score > 0 then risk_score end', 1), 1)}, 0.0) as corporate_risk_index from logs_e"""))
def q_corporate_risk(spark, sf):
    from ..operators.governance import corporate_risk
    return corporate_risk(_enriched(spark, sf))


@register("pii_by_department", oracle(["logs_e"], """
select department, count(prompt_id) as pii_events from logs_e where risk_flag = 1 and department is not null group by 1"""))
def q_pii_by_department(spark, sf):
    from ..operators.governance import pii_by_department
    return pii_by_department(_enriched(spark, sf))


# ---------------------------------------------------------------- ROI / summary / licences

def _scratch(spark, name: str) -> str:
    """A fresh folder under the shared checkpoint directory."""
    import uuid
    from ..session import ensure_checkpoint_dir
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/roilens-{name}-{uuid.uuid4().hex}"


def _summary(spark, sf):
    """The per-user summary as a plan: nothing runs before its consumer does."""
    from ..operators.roi import user_summary
    i = _I(spark, sf)
    return user_summary(i.users(), i.logs_cost(), i.tickets(), i.pull_requests())


def _classified(spark, sf):
    from ..operators.licences import classify_users
    return classify_users(_summary(spark, sf))


@register("dept_roi", oracle(["users_master", "logs_s", "tickets"], f"""
select u.department, count(distinct u.user_id) as headcount, {RD(ES('c.total_cost', 6), 2)} as dept_ai_spend,
  {RD(M12('jb.c'), 2)} as avg_cycle_before, {RD(M12('ja.c'), 2)} as avg_cycle_after,
  {RD('(' + M12('jb.c') + ' - ' + M12('ja.c') + ') / nullif(' + M12('jb.c') + ', 0) * 100', 1)} as dept_efficiency_pct,
  {RD(M12('r.avg_risk'), 2)} as avg_risk_score
from users_master u
left join (select user_id, {ES('cost_usd', 6)} as total_cost from logs_s group by user_id) c on c.user_id = u.user_id
left join (select user_id, {EM('cycle_time_hours', 2)} as c from tickets where period = 'Before' group by user_id) jb on jb.user_id = u.user_id
left join (select user_id, {EM('cycle_time_hours', 2)} as c from tickets where period = 'After' group by user_id) ja on ja.user_id = u.user_id
left join (select user_id, {EM('risk_score', 1)} as avg_risk from logs_s where risk_score > 0 group by user_id) r on r.user_id = u.user_id
group by u.department"""))
def q_dept_roi(spark, sf):
    from ..operators.roi import dept_roi
    i = _I(spark, sf)
    return dept_roi(i.users(), i.logs(), i.tickets())


@register("user_summary", oracle(["us"], "select * from us"))
def q_user_summary(spark, sf):
    # a single consumer: plan it straight through (no intermediate table)
    from ..operators.roi import user_summary
    i = _I(spark, sf)
    return user_summary(i.users(), i.logs_cost(), i.tickets(), i.pull_requests())


@register("classify_users", oracle(["classified"], "select * from classified"))
def q_classify_users(spark, sf):
    return _classified(spark, sf)


@register("recommend_tier", oracle(["classified"], """
select user_id, total_tokens, prompt_count, tickets_closed, recommended_tier from classified"""))
def q_recommend_tier(spark, sf):
    return _classified(spark, sf).select("user_id", "total_tokens", "prompt_count", "tickets_closed",
                                         "recommended_tier")


@register("licence_saving", oracle(["classified"], """
select user_id, license_type, recommended_tier, current_licence_cost, recommended_licence_cost, potential_saving
from classified"""))
def q_licence_saving(spark, sf):
    return _classified(spark, sf).select("user_id", "license_type", "recommended_tier", "current_licence_cost",
                                         "recommended_licence_cost", "potential_saving")


@register("roi_formula", oracle(["us"], f"""
select user_id, {RD('greatest(avg_cycle_before - avg_cycle_after, 0.0)', 2)} as hours_saved_per_ticket,
  {RD('greatest(avg_cycle_before - avg_cycle_after, 0.0) * tickets_closed * hourly_rate', 2)} as dollar_value_saved,
  {RD('greatest(avg_cycle_before - avg_cycle_after, 0.0) * tickets_closed * hourly_rate - total_cost', 2)} as net_roi,
  {RD('case when avg_cycle_before > 0 then greatest(avg_cycle_before - avg_cycle_after, 0.0) / avg_cycle_before * 100 else 0.0 end', 1)} as pct_improvement,
  greatest(avg_cycle_before - avg_cycle_after, 0.0) * tickets_closed * hourly_rate - total_cost > 0 as roi_positive
from us"""))
def q_roi_formula(spark, sf):
    from ..functions.roi import roi_columns
    s = _summary(spark, sf)
    cols = roi_columns("avg_cycle_before", "avg_cycle_after", "tickets_closed", "hourly_rate", "total_cost")
    return s.select("user_id", *[c.alias(k) for k, c in cols.items()])


@register("zombie_sql", oracle(["users_master", "logs_c", "tickets", "prs"], f"""
, cost as (select user_id, {ES('cost_usd', 6)} as total_cost, count(*) as prompt_count from logs_c group by user_id)
select u.user_id, u.employee_name, u.department, u.role, u.license_type,
  coalesce(c.total_cost, 0.0) as total_ai_cost, coalesce(c.prompt_count, 0) as total_prompts,
  cast(coalesce(ja.n, 0) as bigint) as tickets_after_ai, coalesce(gh.n, 0) as prs_merged, 'Zombie' as classification
from users_master u
left join cost c on c.user_id = u.user_id
left join (select user_id, sum(jira_tickets_closed) as n from tickets where period = 'After' group by user_id) ja
  on ja.user_id = u.user_id
left join (select user_id, count(*) as n from prs where pr_state = 'merged' group by user_id) gh on gh.user_id = u.user_id
where coalesce(c.total_cost, 0.0) > (select {EM('total_cost', 6)} from cost)
  and coalesce(ja.n, 0) = 0 and coalesce(gh.n, 0) = 0"""))
def q_zombie_sql(spark, sf):
    from ..operators.licences import zombie_licences
    i = _I(spark, sf)
    return zombie_licences(i.users(), i.logs_cost(), i.tickets(), i.pull_requests())


@register("optimisation_summary", oracle(["classified"], f"""
select count(*) as total_users, count(*) filter (where category = 'Champion') as champion_count,
  count(*) filter (where category = 'Healthy') as healthy_count,
  count(*) filter (where category = 'Underutilized') as underutil_count,
  count(*) filter (where category = 'At-Risk') as at_risk_count,
  count(*) filter (where category = 'Zombie') as zombie_count,
  {RD("coalesce(count(*) filter (where category = 'Zombie') * 100.0 / nullif(count(*), 0), 0.0)", 1)} as zombie_pct,
  count(*) filter (where category in ('Zombie','At-Risk','Underutilized') and potential_saving > 0) as downgrade_candidates,
  {RD("coalesce(" + ES("case when category = 'Zombie' then current_licence_cost end", 2) + ", 0.0)", 2)} as monthly_saving_zombies,
  {RD("coalesce(" + ES("case when category in ('Zombie','At-Risk','Underutilized') and potential_saving > 0 then potential_saving end", 2) + ", 0.0)", 2)} as monthly_saving_downgrades,
  {RD("coalesce(" + ES("case when category = 'Zombie' then current_licence_cost end", 2) + ", 0.0) + coalesce(" + ES("case when category in ('Zombie','At-Risk','Underutilized') and potential_saving > 0 then potential_saving end", 2) + ", 0.0)", 2)} as total_monthly_saving,
  {RD("(coalesce(" + ES("case when category = 'Zombie' then current_licence_cost end", 2) + ", 0.0) + coalesce(" + ES("case when category in ('Zombie','At-Risk','Underutilized') and potential_saving > 0 then potential_saving end", 2) + ", 0.0)) * 12", 2)} as annual_saving_projection
from classified"""))
def q_optimisation_summary(spark, sf):
    from ..operators.licences import optimisation_summary
    return optimisation_summary(_classified(spark, sf))


@register("category_distribution", oracle(["classified"], f"""
select d.category, coalesce(c.n, 0) as "count",
  {RD('coalesce(c.n, 0) / greatest((select count(*) from classified), 1) * 100', 1)} as pct
from (values ('Champion'),('Healthy'),('Underutilized'),('At-Risk'),('Zombie')) d(category)
left join (select category, count(*) as n from classified group by 1) c on c.category = d.category"""))
def q_category_distribution(spark, sf):
    from ..operators.licences import category_distribution
    return category_distribution(_classified(spark, sf))


@register("top_performers", oracle(["classified"], """
select user_id, employee_name, department, role, category, pct_improvement, tickets_closed, hours_saved_per_ticket,
  net_roi, total_cost from classified order by pct_improvement desc, user_id limit 10"""))
def q_top_performers(spark, sf):
    from ..operators.licences import top_performers
    return top_performers(_classified(spark, sf))


@register("zombie_report", oracle(["classified"], """
select user_id, employee_name, department, role, license_type, total_cost, total_tokens, prompt_count, tickets_closed,
  current_licence_cost from classified where category = 'Zombie'"""))
def q_zombie_report(spark, sf):
    from ..operators.licences import zombie_report
    return zombie_report(_classified(spark, sf))


@register("at_risk_report", oracle(["classified"], """
select user_id, employee_name, department, role, total_cost, tickets_closed, pct_improvement, net_roi,
  recommended_tier, potential_saving from classified where category = 'At-Risk'"""))
def q_at_risk_report(spark, sf):
    from ..operators.licences import at_risk_report
    return at_risk_report(_classified(spark, sf))


@register("dept_benchmark", oracle(["classified"], f"""
select *, {RD('coalesce(total_net_roi / nullif(total_spend, 0), 0.0)', 3)} as roi_per_dollar_spent,
  {RD('zombie_count / headcount * 100', 1)} as zombie_pct from (
select department, count(user_id) as headcount, {ES('total_cost', 6)} as total_spend,
  {EM('pct_improvement', 1)} as avg_pct_improvement,
  {RD('cast(sum(cast(net_roi as decimal(30,12))) as double)', 6)} as total_net_roi,
  {RD(M12('hours_saved_per_ticket'), 6)} as avg_hours_saved,
  cast(sum(tickets_closed) as bigint) as total_tickets, cast(sum(is_zombie) as bigint) as zombie_count
from classified where department is not null group by department)"""))
def q_dept_benchmark(spark, sf):
    from ..operators.roi import dept_benchmark
    return dept_benchmark(_classified(spark, sf))


@register("dept_risk", oracle(["logs_e"], f"""
select department, case when quantile_cont(risk_score, 0.8) filter (where risk_score > 0) is null then 0.0 else {RD('least(quantile_cont(risk_score, 0.8) filter (where risk_score > 0), 100.0)', 1)} end
  as dept_risk_score from logs_e where department is not null group by department"""))
def q_dept_risk(spark, sf):
    from ..operators.roi import dept_risk
    return dept_risk(_enriched(spark, sf))


@register("analytics_cache", oracle(["us", "logs_e"], f"""
, m as (select user_id, strftime(timestamp, '%Y-%m') as month_year, {ES('cost_usd', 6)} as m_cost,
           sum(token_count) as m_tokens, sum(risk_flag) as m_flags
        from logs_e where timestamp is not null and user_id is not null group by 1, 2),
dr as (select department, case when quantile_cont(risk_score, 0.8) filter (where risk_score > 0) is null then 0.0 else {RD('least(quantile_cont(risk_score, 0.8) filter (where risk_score > 0), 100.0)', 1)} end
  as dept_risk_score from logs_e where department is not null group by department)
select sha256(us.user_id || '|' || m.month_year) as cache_id, us.user_id, us.department, m.month_year,
  m.m_cost as total_ai_cost, cast(coalesce(m.m_tokens, 0) as bigint) as total_tokens,
  us.avg_cycle_before as tickets_before_avg, us.avg_cycle_after as tickets_after_avg,
  {RD('greatest(us.avg_cycle_before - us.avg_cycle_after, 0.0)', 2)} as hours_saved,
  {RD('greatest(us.avg_cycle_before - us.avg_cycle_after, 0.0) * us.tickets_closed * us.hourly_rate', 2)} as dollar_value_saved,
  {RD('greatest(us.avg_cycle_before - us.avg_cycle_after, 0.0) * us.tickets_closed * us.hourly_rate - m.m_cost', 2)} as net_roi,
  cast(coalesce(m.m_flags, 0) as bigint) as pii_violations, us.avg_pr_cycle as pr_cycle_time_avg,
  dr.dept_risk_score, cast(null as varchar) as computed_at
from us join m on m.user_id = us.user_id left join dr on dr.department = us.department"""))
def q_analytics_cache(spark, sf):
    from ..operators.roi import analytics_cache
    logs = _enriched(spark, sf).select("user_id", "timestamp", "department", "cost_usd", "token_count", "risk_flag", "risk_score")
    from ..operators.roi import user_summary
    i = _I(spark, sf)
    # the summary has a single consumer here: planned straight through
    return analytics_cache(user_summary(i.users(), i.logs_cost(), i.tickets(), i.pull_requests()), logs)


@register("executive_kpis", oracle(["logs_s", "tickets", "users_master"], f"""
, b as (select {EM("case when period = 'Before' then cycle_time_hours end", 2)} as b,
               {EM("case when period = 'After' then cycle_time_hours end", 2)} as a from tickets)
select {RD(f"coalesce((select {ES('cost_usd', 6)} from logs_s), 0.0)", 2)} as total_spend,
  {RD('case when b.b > 0 and b.a is null then null when b.b > 0 then (1 - b.a / b.b) * 100 else 0.0 end', 1)} as pct_improvement,
  coalesce((select cast(sum(token_count) as bigint) from logs_s), 0) as total_tokens,
  (select count(*) from logs_s where risk_level in ('High','Critical')) as high_risk_events,
  (select count(github_username) from users_master) as github_matched
from b"""))
def q_executive_kpis(spark, sf):
    from ..operators.roi import executive_kpis
    i = _I(spark, sf)
    return executive_kpis(i.logs(), i.tickets(), i.users())


# ---------------------------------------------------------------- statistics

def _long_sql() -> str:
    from ..operators.stats import RELATIONSHIPS
    return " union all ".join(f"select '{lbl}' as label, total_cost::double as x, {col}::double as y from us"
                              for lbl, col in RELATIONSHIPS)


@register("spend_vs_productivity", oracle(["us"], f"""
, lng as ({_long_sql()}),
m as (select label, count(*) as n, corr(x, y) as r, regr_slope(y, x) as slope, regr_intercept(y, x) as intercept,
        regr_r2(y, x) as r2, regr_sxx(y, x) as sxx, regr_syy(y, x) as syy
      from lng where x is not null and y is not null and not isnan(x) and not isnan(y) group by label),
h as (select x, y from lng where label = 'cost_vs_hours_saved' and x is not null and y is not null),
rk as (select rank() over (order by x) + (count(*) over (partition by x) - 1) / 2.0 as rx,
              rank() over (order by y) + (count(*) over (partition by y) - 1) / 2.0 as ry from h),
sp as (select 'cost_vs_hours_saved' as label, corr(rx, ry) as rho, count(*) as sn from rk)
select m.label, m.n,
  {RD('case when m.n >= 3 then m.r else 0.0 end', 4)} as pearson_r,
  {RD('case when sp.sn >= 3 then sp.rho when sp.sn is not null then 0.0 end', 4)} as spearman_rho,
  {RD('case when m.n >= 3 then m.slope else 0.0 end', 6)} as slope,
  {RD('case when m.n >= 3 then m.intercept else 0.0 end', 4)} as intercept,
  {RD('case when m.n >= 3 then coalesce(m.r2, m.r * m.r) else 0.0 end', 4)} as r_squared,
  {RD('case when m.n >= 3 and m.sxx > 0 then sqrt(greatest(1.0 - m.r * m.r, 0.0) * m.syy / m.sxx / (m.n - 2)) end', 6)} as std_err
from m left join sp on sp.label = m.label"""))
def q_spend_vs_productivity(spark, sf):
    from ..operators.stats import spend_vs_productivity
    return spend_vs_productivity(_summary(spark, sf))


def _t_p_sql(r: str, n: str) -> str:
    """Two-sided p-value of a correlation r on n pairs as the finite series of Student's t with n - 2 degrees of freedom,
    where the series' sine is |r| (the Spark side uses the incomplete beta function instead)."""
    def series(term: str) -> str:
        return f"coalesce(list_sum(list_transform(range(0, cast(({n} - 2) // 2 as bigint)), lambda k: {term})), 0.0)"
    even = f"abs({r}) * " + series(f"exp(lgamma(k + 0.5) - lgamma(k + 1.0)) / sqrt(pi()) * pow(1 - {r} * {r}, k)")
    odd = f"2 / pi() * (asin(abs({r})) + abs({r}) * " + series(
        f"sqrt(pi()) / 2 * exp(lgamma(k + 1.0) - lgamma(k + 1.5)) * pow(1 - {r} * {r}, k + 0.5)") + ")"
    return (f"case when {n} < 3 then 1.0 when abs({r}) >= 1 then 0.0 "
            f"else greatest(0.0, 1 - (case when {n} % 2 = 0 then {even} else {odd} end)) end")


def _wording_sql(r: str, p: str, n: str) -> str:
    return (f"case when {n} < 3 then 'Insufficient data' when {p} >= 0.05 then 'Not statistically significant' else printf("
            f"'%s %s correlation (r=%.2f, p=%.3f)', case when abs({r}) >= {P.STRONG_R} then 'Strong' when abs({r}) >= {P.MODERATE_R} "
            f"then 'Moderate' else 'Weak' end, case when {r} > 0 then 'positive' else 'negative' end, {r}, {p}) end")


def _moments_sql(x: str, y: str) -> str:
    return f"""
, m as (select count(*) as n, corr(y, x) as r, regr_slope(y, x) as slope, regr_intercept(y, x) as intercept,
          regr_r2(y, x) as r2, regr_sxx(y, x) as sxx, regr_syy(y, x) as syy
        from (select {x}::double as x, {y}::double as y from us) where x is not null and y is not null),
mp as (select *, {_t_p_sql('r', 'n')} as p from (select * replace (case when n >= 3 then r else 0.0 end as r) from m))"""


@register("correlation_significance", oracle(["us"], f"""
, lng as ({_long_sql()}),
m as (select label, count(*) as n, corr(y, x) as r, regr_slope(y, x) as slope, regr_intercept(y, x) as intercept,
        regr_r2(y, x) as r2, regr_sxx(y, x) as sxx, regr_syy(y, x) as syy
      from lng where x is not null and y is not null and not isnan(x) and not isnan(y) group by label),
h as (select x, y from lng where label = 'cost_vs_hours_saved' and x is not null and y is not null),
rk as (select rank() over (order by x) + (count(*) over (partition by x) - 1) / 2.0 as rx,
              rank() over (order by y) + (count(*) over (partition by y) - 1) / 2.0 as ry from h),
sp as (select 'cost_vs_hours_saved' as label, corr(rx, ry) as rho, count(*) as sn from rk),
j as (select m.* replace (case when m.n >= 3 then m.r else 0.0 end as r),
        case when sp.sn >= 3 then sp.rho when sp.sn is not null then 0.0 end as rho from m left join sp on sp.label = m.label),
mp as (select *, {_t_p_sql('r', 'n')} as p, case when rho is not null then {_t_p_sql('rho', 'n')} end as sp_p from j)
select label, n, {RD('r', 4)} as pearson_r, {RD('rho', 4)} as spearman_rho,
  {RD('case when n >= 3 then slope else 0.0 end', 6)} as slope,
  {RD('case when n >= 3 then intercept else 0.0 end', 4)} as intercept,
  {RD('case when n >= 3 then coalesce(r2, r * r) else 0.0 end', 4)} as r_squared,
  {RD('case when n >= 3 and sxx > 0 then sqrt(greatest(1.0 - r * r, 0.0) * syy / sxx / (n - 2)) end', 6)} as std_err,
  {RD('p', 4)} as pearson_p, {RD('sp_p', 4)} as spearman_p, p < 0.05 as significant, {_wording_sql('r', 'p', 'n')} as interpretation
from mp"""))
def q_correlation_significance(spark, sf):
    from ..operators.stats import spend_vs_productivity
    return spend_vs_productivity(_summary(spark, sf), with_p=True)


@register("pearson", oracle(["us"], _moments_sql("total_cost", "hours_saved_per_ticket") + f"""
select n, {RD('r', 4)} as pearson_r, {RD('p', 4)} as pearson_p, p < 0.05 as significant, {_wording_sql('r', 'p', 'n')} as interpretation from mp"""))
def q_pearson(spark, sf):
    from ..operators.stats import pearson
    return pearson(_summary(spark, sf), "total_cost", "hours_saved_per_ticket")


@register("spearman", oracle(["us"], f"""
, h as (select total_cost::double as x, hours_saved_per_ticket::double as y from us),
rk as (select rank() over (order by x) + (count(*) over (partition by x) - 1) / 2.0 as rx,
              rank() over (order by y) + (count(*) over (partition by y) - 1) / 2.0 as ry from h),
sp as (select count(*) as n, corr(rx, ry) as r from rk), mp as (select n, r, {_t_p_sql('r', 'n')} as p from sp)
select n, {RD('r', 4)} as spearman_rho, {RD('p', 4)} as spearman_p, p < 0.05 as significant from mp"""))
def q_spearman(spark, sf):
    from ..operators.stats import spearman
    return spearman(_summary(spark, sf), "total_cost", "hours_saved_per_ticket")


@register("ols", oracle(["us"], _moments_sql("total_cost", "net_roi") + f"""
select {RD('case when n >= 3 then slope else 0.0 end', 6)} as slope, {RD('case when n >= 3 then intercept else 0.0 end', 4)} as intercept,
  {RD('case when n >= 3 then coalesce(r2, r * r) else 0.0 end', 4)} as r_squared, {RD('p', 4)} as p_value,
  {RD('case when n >= 3 and sxx > 0 then sqrt(greatest(1.0 - r * r, 0.0) * syy / sxx / (n - 2)) end', 6)} as std_err,
  case when n >= 3 then n else 0 end as n from mp"""))
def q_ols(spark, sf):
    from ..operators.stats import ols
    return ols(_summary(spark, sf), "total_cost", "net_roi")


@register("ols_predictions", oracle(["us"], f"""
, f as (select regr_slope(net_roi, total_cost) as b1, regr_intercept(net_roi, total_cost) as b0 from us)
select total_cost::double as x, net_roi::double as y, {RD('b1 * total_cost + b0', 4)} as predicted from us, f"""))
def q_ols_predictions(spark, sf):
    from pyspark.sql import functions as F
    from ..functions.numeric import round_dec
    from ..operators.stats import ols_predictions
    out = ols_predictions(_summary(spark, sf), "total_cost", "net_roi")
    return out.withColumn("predicted", round_dec(F.col("predicted"), 4))


# ---------------------------------------------------------------- PR dashboard and columns

@register("rework_by_period", oracle(["prs_e"], f"""
select department, period, {EM('rework_ratio', 3)} as rework_ratio from prs_e
where department is not null and period is not null group by 1, 2"""))
def q_rework_by_period(spark, sf):
    from ..operators.pulls import rework_by_period
    return rework_by_period(_I(spark, sf).pull_requests_enriched())


@register("pr_kpis", oracle(["prs_e"], f"""
select count(*) filter (where pr_state = 'merged') as prs_merged,
  {RD(f"case when {EM('case when period = ' + chr(39) + 'Before' + chr(39) + ' then cycle_time_hours end', 2)} > 0 and {EM('case when period = ' + chr(39) + 'After' + chr(39) + ' then cycle_time_hours end', 2)} is null then null when {EM('case when period = ' + chr(39) + 'Before' + chr(39) + ' then cycle_time_hours end', 2)} > 0 then (1 - {EM('case when period = ' + chr(39) + 'After' + chr(39) + ' then cycle_time_hours end', 2)} / {EM('case when period = ' + chr(39) + 'Before' + chr(39) + ' then cycle_time_hours end', 2)}) * 100 else 0.0 end", 1)} as cycle_improvement_pct,
  {RD(f"case when {EM('case when period = ' + chr(39) + 'Before' + chr(39) + ' then rework_ratio end', 3)} > 0 and {EM('case when period = ' + chr(39) + 'After' + chr(39) + ' then rework_ratio end', 3)} is null then null when {EM('case when period = ' + chr(39) + 'Before' + chr(39) + ' then rework_ratio end', 3)} > 0 then (1 - {EM('case when period = ' + chr(39) + 'After' + chr(39) + ' then rework_ratio end', 3)} / {EM('case when period = ' + chr(39) + 'Before' + chr(39) + ' then rework_ratio end', 3)}) * 100 else 0.0 end", 1)} as rework_improvement_pct,
  count(distinct github_username) as contributors, count(distinct repo_name) as repos
from prs_e"""))
def q_pr_kpis(spark, sf):
    from ..operators.pulls import pr_kpis
    return pr_kpis(_I(spark, sf).pull_requests_enriched())


@register("pr_monthly_total", oracle(["prs_e"], """
select month, cast(sum(pr_count) as bigint) as pr_count from (
  select strftime(merged_at, '%Y-%m') as month, department, count(pr_id) as pr_count from prs_e
  where merged_at is not null and department is not null group by 1, 2) group by month"""))
def q_pr_monthly_total(spark, sf):
    from ..operators.pulls import pr_monthly_total, pr_velocity_monthly
    return pr_monthly_total(pr_velocity_monthly(_I(spark, sf).pull_requests_enriched()))


@register("review_depth_ols", oracle(["prs_e"], f"""
select department, cast(regr_count(cycle_time_hours, review_count::double) as bigint) as n,
  {RD('regr_slope(cycle_time_hours, review_count::double)', 4)} as slope,
  {RD('regr_intercept(cycle_time_hours, review_count::double)', 4)} as intercept,
  {RD('regr_r2(cycle_time_hours, review_count::double)', 4)} as r_squared
from prs_e where cycle_time_hours > 0 and cycle_time_hours < 500 and review_count >= 0 and department is not null
group by department"""))
def q_review_depth_ols(spark, sf):
    from ..operators.pulls import review_depth_ols
    return review_depth_ols(_I(spark, sf).pull_requests_enriched())


@register("review_sample", oracle(["prs_e"], """
select pr_id, department, review_count, cycle_time_hours from prs_e
where cycle_time_hours > 0 and cycle_time_hours < 500 and review_count >= 0
order by md5(cast(pr_id as varchar) || ':42'), pr_id limit 600"""))
def q_review_sample(spark, sf):
    from ..operators.pulls import review_sample
    return review_sample(_I(spark, sf).pull_requests_enriched(), 600).select(
        "pr_id", "department", "review_count", "cycle_time_hours")


def _pr_delta_df(spark, sf):
    from ..operators.pulls import pr_delta, pr_performance
    return pr_delta(pr_performance(_I(spark, sf).pull_requests_enriched()))


@register("melt_cycle", oracle(["prs_e"], f"""
, s as ({_PERF}),
d as (select department, coalesce(max(case when period='Before' then avg_cycle_hours end), 0) as b,
             coalesce(max(case when period='After' then avg_cycle_hours end), 0) as a from s group by department)
select department, 'Before Copilot' as period, {RD('b', 1)} as avg_hours from d
union all select department, 'After Copilot', {RD('a', 1)} from d"""))
def q_melt_cycle(spark, sf):
    from ..operators.pulls import melt_before_after
    return melt_before_after(_pr_delta_df(spark, sf), "before_avg", "after_avg", "avg_hours", 1)


@register("melt_rework", oracle(["prs_e"], f"""
, s as ({_PERF}),
d as (select department, coalesce(max(case when period='Before' then avg_rework_ratio end), 0) as b,
             coalesce(max(case when period='After' then avg_rework_ratio end), 0) as a from s group by department)
select department, 'Before Copilot' as period, {RD('b', 3)} as rework_ratio from d
union all select department, 'After Copilot', {RD('a', 3)} from d"""))
def q_melt_rework(spark, sf):
    from ..operators.pulls import melt_before_after
    return melt_before_after(_pr_delta_df(spark, sf), "before_rework", "after_rework", "rework_ratio", 3)


@register("period_label", oracle(["pull_requests"], """
select pr_id, case when merged_at >= timestamp '1998-01-01 00:00:00' then 'After'
                   when merged_at is not null then 'Before' end as period_label from pull_requests"""))
def q_period_label(spark, sf):
    from pyspark.sql import functions as F
    from .. import params as P
    from ..functions.pulls import period_label
    return _I(spark, sf).c.pull_requests().select(
        "pr_id", period_label(F.col("merged_at"), P.CANONICAL_CUTOFF).alias("period_label"))


@register("period_backfill", oracle(["prs_e"], "select pr_id, period from prs_e"))
def q_period_backfill(spark, sf):
    from pyspark.sql import functions as F
    from .. import params as P
    from ..functions.pulls import period_backfill
    return _I(spark, sf).c.pull_requests().select(
        "pr_id", period_backfill("period", "merged_at", P.CANONICAL_CUTOFF).alias("period"))


@register("department_fill", oracle(["prs_e"], "select pr_id, repo_name, department from prs_e"))
def q_department_fill(spark, sf):
    from ..operators.pulls import department_fill
    i = _I(spark, sf)
    return department_fill(i.c.pull_requests(), i.c.repo_department()).select("pr_id", "repo_name", "department")


@register("pr_derived", oracle(["prs"], """
select pr_id, split_part(repo_full_name, '/', 2) as short_repo, cycle_time_hours, rework_ratio from prs"""))
def q_pr_derived(spark, sf):
    from ..functions.pulls import short_repo_name
    from ..operators.pulls import pr_derived
    out = pr_derived(_I(spark, sf).c.pull_requests())
    return out.select("pr_id", short_repo_name("repo_full_name").alias("short_repo"), "cycle_time_hours",
                      "rework_ratio")


@register("map_contributors", oracle(["prs"], "select pr_id, github_username, user_id from prs"))
def q_map_contributors(spark, sf):
    from ..operators.pulls import map_contributors
    i = _I(spark, sf)
    return map_contributors(i.c.pull_requests(), i.users()).select("pr_id", "github_username", "user_id")


@register("usage_time_features", oracle(["ai_usage_logs"], """
select prompt_id, cast(timestamp as date) as date, cast(hour(timestamp) as integer) as hour, dayname(timestamp) as day_name,
  cast(weekofyear(timestamp) as integer) as week, strftime(timestamp, '%Y-%m') as month_year from ai_usage_logs"""))
def q_usage_time_features(spark, sf):
    from ..functions.timecols import time_features
    return time_features(_I(spark, sf).logs_raw().select("prompt_id", "timestamp"), "timestamp").drop("timestamp")


# ---------------------------------------------------------------- sources, sinks, filters, quality

@register("scan_department", oracle(["logs_c"], """
select prompt_id, user_id, department, token_count, cost_usd from logs_c where department = 'BUILDING'"""))
def q_scan_department(spark, sf):
    from ..sources.tables import scan_department
    return scan_department(_I(spark, sf).logs_cost(), "BUILDING").select(
        "prompt_id", "user_id", "department", "token_count", "cost_usd")


@register("coerce_types", oracle(["tickets"], """
select jira_issue_id, created_at, resolved_at, cycle_time_hours, cast(story_points as integer) as story_points,
  cast(jira_tickets_closed as integer) as jira_tickets_closed, 0::bigint as bad_number, null::timestamp as bad_time
from tickets"""))
def q_coerce_types(spark, sf):
    from pyspark.sql import functions as F
    from pyspark.sql import types as T
    from ..sources.tables import coerce_types
    t = _I(spark, sf).tickets()
    as_text = t.select(*[F.col(c).cast("string").alias(c) for c in
                         ("jira_issue_id", "created_at", "resolved_at", "cycle_time_hours", "story_points",
                          "jira_tickets_closed")],
                       F.lit("n/a").alias("bad_number"), F.lit("not a time").alias("bad_time"))
    schema = T.StructType([T.StructField("jira_issue_id", T.StringType()),
                           T.StructField("created_at", T.TimestampNTZType()),
                           T.StructField("resolved_at", T.TimestampNTZType()),
                           T.StructField("cycle_time_hours", T.DoubleType()),
                           T.StructField("story_points", T.IntegerType()),
                           T.StructField("jira_tickets_closed", T.IntegerType()),
                           T.StructField("bad_number", T.LongType()),
                           T.StructField("bad_time", T.TimestampNTZType())])
    return coerce_types(as_text, schema)


@register("align_schema", oracle(["pull_requests"], """
select pr_id, null::varchar as user_id, github_username, repo_name, coalesce(repo_full_name, repo_name) as repo_full_name,
  department, pr_title, pr_state, created_at, merged_at, null::double as cycle_time_hours, lines_added::bigint as lines_added,
  lines_removed::bigint as lines_removed, review_count::bigint as review_count, commit_count::bigint as commit_count,
  null::double as rework_ratio, coalesce(period, 'Unknown') as period
from pull_requests"""))
def q_align_schema(spark, sf):
    from ..sources.tables import align_pull_requests
    return align_pull_requests(_I(spark, sf).c.pull_requests())


@register("csv_round_trip", oracle(["tickets"], """
select jira_issue_id, user_id, department, created_at, resolved_at, cycle_time_hours, story_points::integer as story_points,
  priority, period, null::double as avg_ticket_resolution_hours, jira_tickets_closed::integer as jira_tickets_closed
from tickets"""))
def q_csv_round_trip(spark, sf):
    from ..sources.sinks import read_csv, write_csv
    from ..sources.tables import align_schema
    from .. import schemas
    path = _scratch(spark, "csv")
    write_csv(align_schema(_I(spark, sf).tickets(), schemas.TICKETS), path)
    return read_csv(spark, path, "tickets")


@register("csv_round_trip_text", oracle(["ai_usage_logs"], f"""
select prompt_id, {_redact_sql('prompt_text')} as prompt_text from ai_usage_logs"""))
def q_csv_round_trip_text(spark, sf):
    from ..operators.governance import redact_frame
    from ..sources.sinks import read_csv, write_csv
    logs = redact_frame(_I(spark, sf).logs_raw().select("prompt_id", "prompt_text"), "prompt_text")
    path = _scratch(spark, "csv_text")
    write_csv(logs, path, "zstd")  # a text is written with each of its rows
    return read_csv(spark, path, logs.schema)


def _raw_prs(spark, sf):
    from pyspark.sql import functions as F
    p = _I(spark, sf).c.pull_requests()
    iso = "yyyy-MM-dd'T'HH:mm:ss'Z'"
    num = F.regexp_extract("pr_id", r"#(\d+)-(\d+)$", 1).cast("bigint") * 100 + \
        F.regexp_extract("pr_id", r"#(\d+)-(\d+)$", 2).cast("bigint")
    return p.select(num.alias("number"), F.col("pr_title").alias("title"), F.lit("closed").alias("state"),
                    F.date_format("created_at", iso).alias("created_at"),
                    F.date_format(F.coalesce("merged_at", "created_at"), iso).alias("updated_at"),
                    F.date_format("merged_at", iso).alias("merged_at"),
                    F.col("lines_added").alias("additions"), F.col("lines_removed").alias("deletions"),
                    F.col("review_count").alias("review_comments"), F.col("commit_count").alias("commits"),
                    F.struct(F.col("github_username").alias("login")).alias("user"),
                    F.struct(F.struct(F.col("repo_name").alias("name"),
                                      F.col("repo_full_name").alias("full_name")).alias("repo")).alias("base"))


TICKETS_SINCE = "1998-09-18 00:00:00"


@register("ingest_pull_requests", oracle(["pull_requests", "users_master", "repo_department"], f"""
, r as (select p.*, cast(regexp_extract(pr_id, '#(\\d+)-(\\d+)$', 1) as bigint) * 100
                   + cast(regexp_extract(pr_id, '#(\\d+)-(\\d+)$', 2) as bigint) as number
        from pull_requests p where merged_at is not null),
c as (select * from r)
select c.repo_name || '#' || cast(number as varchar) as pr_id, c.github_username, c.repo_name, c.repo_full_name,
  c.pr_title as pr_title, 'merged' as pr_state, c.created_at, c.merged_at,
  {RD("date_diff('microsecond', c.created_at, c.merged_at)/3600000000", 2)} as cycle_time_hours,
  c.lines_added, c.lines_removed, c.review_count, c.commit_count,
  {RD('c.lines_removed/greatest(coalesce(nullif(c.lines_added,0),1),1)', 3)} as rework_ratio,
  case when c.merged_at >= timestamp '2022-06-21 00:00:00' then 'After' else 'Before' end as period,
  rd.department, u.user_id
from c left join repo_department rd on rd.repo_name = c.repo_name
left join (select github_username, user_id from users_master where github_username is not null and github_username <> '') u
  on u.github_username = c.github_username"""))
def q_ingest_pull_requests(spark, sf):
    from ..sources.ingest import ingest_pull_requests
    i = _I(spark, sf)
    return ingest_pull_requests(_raw_prs(spark, sf), i.users(), i.c.repo_department())


def _raw_ticket_pages(spark, sf):
    from pyspark.sql import functions as F
    t = _I(spark, sf).tickets()
    fmt = "yyyy-MM-dd'T'HH:mm:ss.SSS'+0000'"
    status = F.when(F.col("resolved_at").isNotNull(), F.lit("Done")).otherwise(F.lit("In Progress"))
    issue = F.struct(F.col("jira_issue_id").alias("key"), F.struct(
        F.date_format("created_at", fmt).alias("created"),
        F.date_format("resolved_at", fmt).alias("resolutiondate"),
        F.when(F.col("priority") != "Low", F.struct(F.col("priority").alias("name"))).alias("priority"),
        F.lit(None).cast("struct<displayName:string>").alias("assignee"),
        F.when(F.col("story_points") != 13, F.col("story_points").cast("double")).alias("story_points"),
        F.struct(status.alias("name")).alias("status")).alias("fields"))
    page = F.floor(F.regexp_extract("jira_issue_id", r"(\d+)$", 1).cast("bigint") / 100)
    # one page = at most 100 consecutive keys: a bounded group
    return (t.select(page.alias("page"), issue.alias("i")).groupBy("page")
            .agg(F.count(F.lit(1)).alias("total"), F.collect_list("i").alias("issues"))
            .select("total", (F.col("page") * 100).alias("startAt"), "issues"))


@register("ingest_tickets", oracle(["tickets"], f"""
select jira_issue_id, null::varchar as user_id, null::varchar as department, created_at, resolved_at,
  case when resolved_at > created_at then {RD("date_diff('microsecond', created_at, resolved_at)/3600000000", 2)} else 0.0 end
    as cycle_time_hours,
  case when story_points = 13 then 1 else story_points end::integer as story_points,
  case when priority = 'Low' then 'Medium' else priority end as priority, 'After' as period,
  0.0::double as avg_ticket_resolution_hours, 1 as jira_tickets_closed
from tickets where resolved_at is not null and resolved_at >= timestamp '{TICKETS_SINCE}'"""))
def q_ingest_tickets(spark, sf):
    import datetime as dt
    from ..sources.ingest import ingest_tickets
    return ingest_tickets(_raw_ticket_pages(spark, sf), since=dt.datetime.fromisoformat(TICKETS_SINCE))


@register("constraint_audit", oracle(["users_master", "logs_s", "tickets", "prs"], """
, d1 as (select coalesce(sum(n), 0) as v from (select count(*) as n from users_master where user_id is not null group by user_id having count(*) > 1)),
d2 as (select coalesce(sum(n), 0) as v from (select count(*) as n from users_master where github_username is not null group by github_username having count(*) > 1)),
d3 as (select coalesce(sum(n), 0) as v from (select count(*) as n from logs_s where prompt_id is not null group by prompt_id having count(*) > 1)),
d4 as (select coalesce(sum(n), 0) as v from (select count(*) as n from tickets where jira_issue_id is not null group by jira_issue_id having count(*) > 1)),
d5 as (select coalesce(sum(n), 0) as v from (select count(*) as n from prs where pr_id is not null group by pr_id having count(*) > 1))
select 'users_master' as table_name, 'pk_user_id' as rule, (select v from d1)::bigint as violations
union all select 'users_master', 'not_null_user_id', count(*) filter (where user_id is null) from users_master
union all select 'users_master', 'not_null_employee_name', count(*) filter (where employee_name is null) from users_master
union all select 'users_master', 'not_null_department', count(*) filter (where department is null) from users_master
union all select 'users_master', 'unique_github_username', (select v from d2)::bigint
union all select 'ai_usage_logs', 'pk_prompt_id', (select v from d3)::bigint
union all select 'ai_usage_logs', 'not_null_timestamp', count(*) filter (where timestamp is null) from logs_s
union all select 'ai_usage_logs', 'fk_user_id', count(*) from logs_s l where l.user_id is not null
   and not exists (select 1 from users_master u where u.user_id = l.user_id)
union all select 'tickets', 'pk_jira_issue_id', (select v from d4)::bigint
union all select 'tickets', 'check_period', count(*) filter (where period is null or period not in ('Before','After')) from tickets
union all select 'tickets', 'fk_user_id', count(*) from tickets t where t.user_id is not null
   and not exists (select 1 from users_master u where u.user_id = t.user_id)
union all select 'pull_requests', 'pk_pr_id', (select v from d5)::bigint
union all select 'pull_requests', 'check_period', count(*) filter (where period is null or period not in ('Before','After','Unknown')) from prs
union all select 'pull_requests', 'fk_user_id', count(*) from prs p where p.user_id is not null
   and not exists (select 1 from users_master u where u.user_id = p.user_id)"""))
def q_constraint_audit(spark, sf):
    from ..operators.quality import constraint_audit
    i = _I(spark, sf)
    return constraint_audit(i.users(), i.logs(), i.tickets(), i.pull_requests())


@register("filter_departments", oracle(["tickets"], """
select jira_issue_id, department from tickets where department in ('BUILDING', 'MACHINERY')"""))
def q_filter_departments(spark, sf):
    from ..operators.filters import filter_departments
    return filter_departments(_I(spark, sf).tickets(), ["BUILDING", "MACHINERY"]).select("jira_issue_id", "department")


@register("filter_period", oracle(["tickets"], "select jira_issue_id, period from tickets where period = 'After'"))
def q_filter_period(spark, sf):
    from ..operators.filters import filter_period
    return filter_period(_I(spark, sf).tickets(), "After").select("jira_issue_id", "period")


@register("filter_risk", oracle(["logs_s"], """
select prompt_id, risk_score, risk_level from logs_s where risk_level in ('High', 'Critical')"""))
def q_filter_risk(spark, sf):
    from ..operators.filters import filter_risk
    return filter_risk(_I(spark, sf).logs(), "high").select("prompt_id", "risk_score", "risk_level")


@register("utc_normalise", oracle(["pull_requests"], """
select pr_id, created_at, merged_at, created_at as ts_utc from pull_requests"""))
def q_utc_normalise(spark, sf):
    from ..functions.timecols import utc_normalise
    return utc_normalise(_I(spark, sf).pull_requests().select("pr_id", "created_at", "merged_at"))


@register("export_bundle", oracle(["ai_usage_logs", "tickets", "users_master", "pull_requests"], """
select 'usage_logs' as dataset, count(*) as "rows" from ai_usage_logs
union all select 'dept_performance', count(distinct department) from tickets
  where department is not null and period in ('Before', 'After')
union all select 'user_summary', count(*) from users_master
union all select 'pull_requests', count(*) from pull_requests"""))
def q_export_bundle(spark, sf):
    """S15 end to end: write the four datasets, report what landed per dataset."""
    from functools import reduce
    from pyspark.sql import DataFrame as _DF, functions as F
    from ..operators.tickets import dept_performance
    from ..sources.sinks import export_bundle
    i = _I(spark, sf)
    summary = _summary(spark, sf)
    paths = export_bundle(_scratch(spark, "export"), i.logs_enriched, dept_performance(i.tickets()),
                          summary, i.pull_requests())
    frames = [spark.read.parquet(p).agg(F.count(F.lit(1)).alias("rows")).select(F.lit(k).alias("dataset"), "rows")
              for k, p in paths.items()]
    return reduce(_DF.unionByName, frames)


@register("replace_repo", oracle(["pull_requests"], """
select repo_name, count(*) filter (where repo_name <> (select min(repo_name) from pull_requests) or pr_state = 'merged')
  as "rows"
from pull_requests group by repo_name"""))
def q_replace_repo(spark, sf):
    """Publish all PRs laid out by repo, then replace one repository's
    partition with its merged PRs only; the other partitions are unchanged."""
    from pyspark.sql import functions as F
    from ..sources.sinks import replace_repo
    from ..sources.versions import read_table
    prs = _I(spark, sf).pull_requests().drop("user_id")
    path = _scratch(spark, "prs")
    replace_repo(spark, prs, path)
    least = prs.agg(F.min("repo_name")).first()[0]  # the caller's choice of a repository
    replace_repo(spark, prs.where(F.col("pr_state") == "merged"), path, least)
    return read_table(spark, path).groupBy("repo_name").agg(F.count(F.lit(1)).alias("rows"))


@register("read_cache", ORACLES["analytics_cache"])
def q_read_cache(spark, sf):
    """An unwritten cache reads as an empty, typed frame; a written one reads back."""
    from ..operators.roi import analytics_cache, user_summary
    from ..operators.usage import enrich_usage
    from ..sources.sinks import write_table
    from ..sources.tables import read_cache
    path = _scratch(spark, "cache")
    assert read_cache(spark, path).count() == 0
    i = _I(spark, sf)
    logs = i.logs_stored(_scratch(spark, "logs"))  # the summary, its median, the months and the risk each read them
    summary = user_summary(i.users(), logs, i.tickets(), i.pull_requests())
    write_table(analytics_cache(summary, enrich_usage(logs, i.users())), path)
    return read_cache(spark, path)


# ---------------------------------------------------------------- S17 parameterised SQL

@register("sql_pr_efficiency", oracle(["prs"], f"""
select department, period, count(pr_id) as pr_count, {RD(EM('cycle_time_hours', 2), 2)} as avg_cycle_hrs,
  count(distinct github_username) as unique_contributors
from prs where pr_state = 'merged' and period in ('Before','After') and department = 'BUILDING'
group by department, period"""))
def q_sql_pr_efficiency(spark, sf):
    from .sql import PR_EFFICIENCY_SQL, run_sql
    return run_sql(spark, PR_EFFICIENCY_SQL, {"department": "BUILDING"}, prs=_I(spark, sf).pull_requests())


@register("sql_monthly_usage", oracle(["ai_usage_logs"], """
select strftime(timestamp, '%Y-%m') as month_year, department, count(prompt_id) as prompt_count,
  cast(sum(token_count) as bigint) as total_tokens, count(distinct user_id) as active_users
from ai_usage_logs where strftime(timestamp, '%Y-%m') >= '2024-06' group by 1, 2"""))
def q_sql_monthly_usage(spark, sf):
    from .sql import MONTHLY_USAGE_SQL, run_sql
    return run_sql(spark, MONTHLY_USAGE_SQL, {"since": "2024-06-01 00:00:00"}, logs=_I(spark, sf).logs_raw())
