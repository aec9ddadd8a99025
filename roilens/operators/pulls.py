"""Pull-request operators: S13 contributor mapping, P3/P4 enrichment, P6/P9
derived columns, A5 (Q3), A6 (Q4), A7, A8 (Q5 + breakdown), A9, T1 (Q6),
T3, N2, D11, D15, D16, D17.

All aggregates are grouped hash aggregations with map-side partial
aggregation; only (department x period)-sized partials are shuffled. The
Before/After comparisons are conditional aggregations over one scan.
"""

from __future__ import annotations

import datetime as _dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import params as P
from ..functions.numeric import clip0, exact_mean, round_dec, safe_div
from ..functions.pulls import period_backfill, pr_cycle_hours, rework_ratio
from ..functions.timecols import month_key
from .filters import in_review_range, merged_only, not_blank
from .stats import add_quantiles

PERIODS = ("Before", "After")


def _merged():
    return F.col("pr_state") == "merged"


def map_contributors(prs: DataFrame, users: DataFrame) -> DataFrame:
    """user_id of each PR author from users.github_username (NULL/'' skipped).

    The lookup has one row a login (of users that share one the smallest id), so a join never multiplies PRs."""
    m = (not_blank(users, "github_username")
         .groupBy("github_username").agg(F.min("user_id").alias("_uid")))
    base = prs.drop("user_id") if "user_id" in prs.columns else prs
    return base.join(m, "github_username", "left").withColumnRenamed("_uid", "user_id")


def pr_derived(prs: DataFrame) -> DataFrame:
    """P6 + P9: cycle_time_hours and rework_ratio."""
    return prs.withColumns({
        "cycle_time_hours": pr_cycle_hours("created_at", "merged_at"),
        "rework_ratio": rework_ratio("lines_added", "lines_removed"),
    })


def department_fill(prs: DataFrame, repo_department: DataFrame) -> DataFrame:
    """NULL or empty department -> department of the repo (short name).

    The lookup is made one row per repository (of several departments the first by name); the planner (AQE) broadcasts it when
    its measured size is small and shuffles otherwise.
    """
    lk = repo_department.groupBy(F.col("repo_name").alias("_repo")).agg(F.min("department").alias("_dept"))
    j = prs.join(lk, prs["repo_name"] == F.col("_repo"), "left")
    d = F.col("department")
    return (j.withColumn("department", F.when(d.isNull() | (d == ""), F.col("_dept")).otherwise(d))
            .drop("_repo", "_dept"))


def enrich_pull_requests(prs: DataFrame, repo_department: DataFrame,
                         cutoff: _dt.datetime = P.CANONICAL_CUTOFF) -> DataFrame:
    """P4 then P3 (the order the dashboard applies them)."""
    return department_fill(prs, repo_department).withColumn(
        "period", period_backfill("period", "merged_at", cutoff))


def pr_efficiency(prs: DataFrame) -> DataFrame:
    """A5 / Q3: merged PRs by department x period (NULL department kept)."""
    return (prs.where(_merged() & F.col("period").isin(*PERIODS))
            .groupBy("department", "period")
            .agg(F.count("pr_id").alias("pr_count"),
                 round_dec(exact_mean("cycle_time_hours"), 2).alias("avg_cycle_hrs"),
                 round_dec(exact_mean("rework_ratio"), 3).alias("avg_rework_ratio"),
                 round_dec(F.avg("review_count"), 1).alias("avg_reviews"),
                 F.countDistinct("github_username").alias("unique_contributors"),
                 F.sum("lines_added").alias("total_lines_added"),
                 F.sum("lines_removed").alias("total_lines_removed"))
            .orderBy("department", "period"))


def pr_delta_sql(prs: DataFrame) -> DataFrame:
    """Before vs After per department; only departments with both periods.

    One scan and one shuffle (conditional aggregation) instead of the
    self-join of two filtered aggregates.
    """
    b, a = F.col("period") == "Before", F.col("period") == "After"
    cyc, rw = F.col("cycle_time_hours"), F.col("rework_ratio")
    g = (prs.where(_merged() & F.col("period").isin(*PERIODS) & F.col("department").isNotNull())
         .groupBy("department")
         .agg(exact_mean(F.when(b, cyc)).alias("b_cycle"),
              exact_mean(F.when(b, rw)).alias("b_rework"),
              F.count_if(b).alias("before_prs"),
              exact_mean(F.when(a, cyc)).alias("a_cycle"),
              exact_mean(F.when(a, rw)).alias("a_rework"),
              F.count_if(a).alias("after_prs"))
         .where((F.col("before_prs") > 0) & (F.col("after_prs") > 0)))
    bc, ac = F.col("b_cycle"), F.col("a_cycle")
    return (g.select("department",
                     round_dec(bc, 2).alias("before_avg_hrs"),
                     round_dec(ac, 2).alias("after_avg_hrs"),
                     round_dec(bc - ac, 2).alias("hours_saved"),
                     round_dec(safe_div(bc - ac, bc) * 100, 1).alias("pct_improvement"),
                     round_dec(F.col("b_rework") - F.col("a_rework"), 3).alias("rework_improvement"),
                     "before_prs", "after_prs")
            .orderBy(F.col("pct_improvement").desc_nulls_last(), "department"))


def pr_performance(prs_enriched: DataFrame) -> DataFrame:
    """A7 summary: department x period (Before/After only, NULL department dropped), 2 dp."""
    keys = ["department", "period"]
    rows = prs_enriched.where(F.col("period").isin(*PERIODS) & F.col("department").isNotNull())
    g = rows.groupBy(*keys).agg(
        F.count("pr_id").alias("pr_count"),
        round_dec(exact_mean("cycle_time_hours"), 2).alias("avg_cycle_hours"),
        round_dec(exact_mean("rework_ratio"), 2).alias("avg_rework_ratio"),
        round_dec(F.avg("review_count"), 2).alias("avg_review_count"),
        round_dec(F.avg("commit_count"), 2).alias("avg_commits"),
        F.sum("lines_added").alias("total_lines_added"),
        F.sum("lines_removed").alias("total_lines_removed"),
        F.countDistinct("github_username").alias("unique_contributors"))
    return add_quantiles(g, rows, keys, {"cycle_time_hours": [0.5, 0.9]}).select(
        *keys, "pr_count", "avg_cycle_hours", round_dec("cycle_time_hours_q0", 2).alias("median_cycle_hours"),
        round_dec("cycle_time_hours_q1", 2).alias("p90_cycle_hours"), "avg_rework_ratio", "avg_review_count",
        "avg_commits", "total_lines_added", "total_lines_removed", "unique_contributors")


def pr_delta(summary: DataFrame) -> DataFrame:
    """A7 delta from the (already 2-dp rounded) summary: outer over departments,
    a missing period counts as 0, hours saved clipped at 0."""
    b, a = F.col("period") == "Before", F.col("period") == "After"

    def pick(cond, col):
        return F.coalesce(F.max(F.when(cond, F.col(col))), F.lit(0))

    g = summary.groupBy("department").agg(
        pick(b, "avg_cycle_hours").cast("double").alias("before_avg"),
        pick(b, "median_cycle_hours").cast("double").alias("before_median"),
        pick(b, "avg_rework_ratio").cast("double").alias("before_rework"),
        pick(b, "pr_count").cast("bigint").alias("before_prs"),
        pick(a, "avg_cycle_hours").cast("double").alias("after_avg"),
        pick(a, "median_cycle_hours").cast("double").alias("after_median"),
        pick(a, "avg_rework_ratio").cast("double").alias("after_rework"),
        pick(a, "pr_count").cast("bigint").alias("after_prs"),
        pick(a, "unique_contributors").cast("bigint").alias("contributors"))
    hs = clip0(F.col("before_avg") - F.col("after_avg"))
    return (g.withColumn("hours_saved", hs)
            .withColumn("pct_improvement",
                        round_dec(F.coalesce(safe_div(F.col("hours_saved"), F.col("before_avg")) * 100,
                                             F.lit(0.0)), 1))
            .withColumn("rework_improvement_pct",
                        round_dec(F.coalesce(safe_div(F.col("before_rework") - F.col("after_rework"),
                                                      F.col("before_rework")) * 100, F.lit(0.0)), 1))
            .orderBy(F.col("pct_improvement").desc(), "department"))


def repo_stats(prs: DataFrame) -> DataFrame:
    """Merged PRs per repository x period (all dimensions grouped, NULLs kept)."""
    keys = ["repo_full_name", "repo_name", "department", "period"]
    rows = merged_only(prs)
    g = rows.groupBy(*keys).agg(
        F.count("pr_id").alias("pr_count"),
        round_dec(exact_mean("cycle_time_hours"), 2).alias("avg_cycle_hrs"),
        round_dec(exact_mean("rework_ratio"), 3).alias("avg_rework"),
        F.countDistinct("github_username").alias("contributors"),
        F.sum("lines_added").alias("total_additions"),
        F.sum("lines_removed").alias("total_deletions"))
    return add_quantiles(g, rows, keys, {"cycle_time_hours": [0.5]}).select(
        *keys, "pr_count", "avg_cycle_hrs", round_dec("cycle_time_hours_q0", 2).alias("median_cycle_hrs"), "avg_rework",
        "contributors", "total_additions", "total_deletions").orderBy("department", "repo_name", "period", "repo_full_name")


def repo_breakdown(prs_enriched: DataFrame) -> DataFrame:
    """A8 (analysis variant): every state, repo x department x period, 2 dp."""
    return (prs_enriched.where(F.col("repo_name").isNotNull() & F.col("department").isNotNull()
                               & F.col("period").isNotNull())
            .groupBy("repo_name", "department", "period")
            .agg(F.count("pr_id").alias("pr_count"),
                 round_dec(exact_mean("cycle_time_hours"), 2).alias("avg_cycle"),
                 round_dec(exact_mean("rework_ratio"), 2).alias("avg_rework"),
                 F.countDistinct("github_username").alias("contributors"))
            .orderBy("department", "repo_name", "period"))


def pr_sync_summary(prs_enriched: DataFrame) -> DataFrame:
    """Post-sync department x period summary, 2 dp."""
    return (prs_enriched.where(F.col("department").isNotNull() & F.col("period").isNotNull())
            .groupBy("department", "period")
            .agg(F.count("pr_id").alias("pr_count"),
                 round_dec(exact_mean("cycle_time_hours"), 2).alias("avg_cycle_hrs"),
                 round_dec(exact_mean("rework_ratio"), 2).alias("avg_rework"),
                 F.countDistinct("github_username").alias("unique_contributors"))
            .orderBy("department", "period"))


def top_contributors_sql(prs: DataFrame, n: int = 20) -> DataFrame:
    """Top-n authors by merged After PRs (tie-break: username).

    ``orderBy(...).limit(n)`` plans as TakeOrderedAndProject: each partition
    keeps its local top n, so only n x partitions rows reach the final merge.
    """
    return (prs.where(_merged() & (F.col("period") == "After"))
            .groupBy("github_username")
            .agg(F.min("department").alias("department"),
                 F.count("pr_id").alias("prs_merged"),
                 round_dec(exact_mean("cycle_time_hours"), 2).alias("avg_cycle_hrs"),
                 round_dec(exact_mean("rework_ratio"), 3).alias("avg_rework"),
                 F.countDistinct("repo_name").alias("repos_contributed"),
                 F.sum("lines_added").alias("total_lines_added"))
            .orderBy(F.col("prs_merged").desc(), F.col("github_username").asc_nulls_last())
            .limit(n))


def top_contributors(prs_enriched: DataFrame, n: int = 15) -> DataFrame:
    """Top-n (author, department) by merged PRs, 2 dp (tie-break: keys)."""
    return (prs_enriched.where(_merged() & F.col("github_username").isNotNull() & F.col("department").isNotNull())
            .groupBy("github_username", "department")
            .agg(F.count("pr_id").alias("total_prs"),
                 round_dec(exact_mean("cycle_time_hours"), 2).alias("avg_cycle"),
                 round_dec(exact_mean("rework_ratio"), 2).alias("avg_rework"),
                 F.sum("lines_added").alias("total_lines"),
                 F.countDistinct("repo_name").alias("repos"))
            .orderBy(F.col("total_prs").desc(), "github_username", "department")
            .limit(n))


def pr_velocity_monthly(prs_enriched: DataFrame) -> DataFrame:
    """PRs per merge month x department; unmerged (NULL month) rows dropped."""
    return (prs_enriched.withColumn("month", month_key("merged_at"))
            .where(F.col("month").isNotNull() & F.col("department").isNotNull())
            .groupBy("month", "department")
            .agg(F.count("pr_id").alias("pr_count"),
                 round_dec(exact_mean("cycle_time_hours"), 2).alias("avg_cycle"),
                 round_dec(exact_mean("rework_ratio"), 2).alias("avg_rework"))
            .orderBy("month", "department"))


def rework_by_period(prs_enriched: DataFrame) -> DataFrame:
    """Mean rework ratio per department x period."""
    return (prs_enriched.where(F.col("department").isNotNull() & F.col("period").isNotNull())
            .groupBy("department", "period")
            .agg(exact_mean("rework_ratio").alias("rework_ratio")))


def pr_kpis(prs_enriched: DataFrame) -> DataFrame:
    """Merged PRs, cycle and rework improvement %, contributors, repositories (one row)."""
    b, a = F.col("period") == "Before", F.col("period") == "After"
    g = prs_enriched.agg(
        F.count_if(_merged()).alias("prs_merged"),
        exact_mean(F.when(b, F.col("cycle_time_hours"))).alias("_bc"),
        exact_mean(F.when(a, F.col("cycle_time_hours"))).alias("_ac"),
        exact_mean(F.when(b, F.col("rework_ratio"))).alias("_br"),
        exact_mean(F.when(a, F.col("rework_ratio"))).alias("_ar"),
        F.countDistinct("github_username").alias("contributors"),
        F.countDistinct("repo_name").alias("repos"))

    def imp(bc, ac):
        return round_dec(F.when(F.col(bc) > 0, (F.col(bc) - F.col(ac)) / F.col(bc) * 100)  # null without After rows
                         .otherwise(F.lit(0.0)), 1)

    return g.select("prs_merged", imp("_bc", "_ac").alias("cycle_improvement_pct"),
                    imp("_br", "_ar").alias("rework_improvement_pct"), "contributors", "repos")


def pr_monthly_total(velocity_monthly: DataFrame) -> DataFrame:
    """PRs per month summed over departments (from N2's output)."""
    return (velocity_monthly.groupBy("month").agg(F.sum("pr_count").cast("bigint").alias("pr_count"))
            .orderBy("month"))


def review_depth_ols(prs_enriched: DataFrame) -> DataFrame:
    """OLS of cycle time on review count per department over all rows in range."""
    x, y = F.col("review_count").cast("double"), F.col("cycle_time_hours")
    return (in_review_range(prs_enriched).where(F.col("department").isNotNull())
            .groupBy("department")
            .agg(F.regr_count(y, x).alias("n"),
                 round_dec(F.regr_slope(y, x), 4).alias("slope"),
                 round_dec(F.regr_intercept(y, x), 4).alias("intercept"),
                 round_dec(F.regr_r2(y, x), 4).alias("r_squared")))


def review_sample(prs_enriched: DataFrame, n: int, seed: int = 42) -> DataFrame:
    """A seeded, reproducible sample of at most n in-range PRs (a sampling
    operator: the limit is the feature). Rows are ranked by a seeded hash of
    the key, so every rerun picks the same rows; TakeOrderedAndProject keeps
    only n rows per partition."""
    return (in_review_range(prs_enriched)
            .withColumn("_h", F.md5(F.concat(F.col("pr_id").cast("string"), F.lit(f":{seed}")).cast("binary")))
            .orderBy("_h", "pr_id").limit(n).drop("_h"))


def melt_before_after(delta: DataFrame, before: str, after: str, value: str, digits: int) -> DataFrame:
    """R2: Before/After columns of a delta table to long form (period label, value)."""
    return (delta.unpivot(["department"], [before, after], "period", value)
            .withColumn("period", F.when(F.col("period") == before, F.lit("Before Copilot"))
                        .otherwise(F.lit("After Copilot")))
            .withColumn(value, round_dec(F.col(value), digits)))
