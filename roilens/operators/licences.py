"""Licence intelligence: W1 zombie licences (Q7, mean spend), W3 five-class
classifier with recommended tier (P18) and savings (P19), A17 optimisation
summary, A18 category distribution, T4 top performers, T6 reports.

Thresholds are global statistics of the user summary; they are evaluated as
scalar subqueries (one aggregate job, no join, no collect) and then every
user row is classified by a ``when`` ladder in the same projection.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import params as P
from ..functions.numeric import exact_mean, exact_sum, round_dec, safe_div
from ..functions.roi import licence_cost, recommend_tier
from .roi import AFTER, usage_per_user


def zombie_licences(users: DataFrame, logs: DataFrame, tickets: DataFrame, prs: DataFrame) -> DataFrame:
    """Spend above the mean per-user spend, no After tickets closed, no merged PRs."""
    cost = usage_per_user(logs)
    closed = (tickets.where(F.col("period") == AFTER).groupBy("user_id")
              .agg(F.sum("jira_tickets_closed").alias("tickets_closed")))
    merged = (prs.where(F.col("pr_state") == "merged").groupBy("user_id")
              .agg(F.count(F.lit(1)).alias("pr_count")))
    mean_cost = cost.agg(exact_mean("total_cost")).scalar()
    j = (users.join(cost, "user_id", "left").join(closed, "user_id", "left").join(merged, "user_id", "left"))
    spend = F.coalesce(F.col("total_cost"), F.lit(0.0))
    return (j.where((spend > mean_cost)
                    & (F.coalesce(F.col("tickets_closed"), F.lit(0)) == 0)
                    & (F.coalesce(F.col("pr_count"), F.lit(0)) == 0))
            .select("user_id", "employee_name", "department", "role", "license_type",
                    spend.alias("total_ai_cost"),
                    F.coalesce(F.col("prompt_count"), F.lit(0)).alias("total_prompts"),
                    F.coalesce(F.col("tickets_closed"), F.lit(0)).cast("bigint").alias("tickets_after_ai"),
                    F.coalesce(F.col("pr_count"), F.lit(0)).alias("prs_merged"),
                    F.lit("Zombie").alias("classification"))
            .orderBy(F.col("total_ai_cost").desc(), "user_id"))


def quantile_row(df: DataFrame, spec: dict[str, list[float]], method: str = "distributed") -> Column:
    """Quantiles ``{column: [p, ...]}`` as ONE scalar subquery, a struct with fields ``<column>_q<i>``.

    ``distributed``: exact, linear interpolation, no single-task gathering
    (``stats.exact_quantiles``, all columns in one pass); ``builtin``: Spark's
    exact ``percentile`` (a value-count map merged in one task per column);
    ``approx``: ``percentile_approx``.
    """
    if method == "distributed":
        from .stats import exact_quantiles

        q = exact_quantiles(df, spec)
    else:
        def agg(c, p):
            return F.percentile(c, p) if method == "builtin" else F.percentile_approx(c, p, 10000)
        q = df.agg(*[agg(c, p).cast("double").alias(f"{c}_q{i}") for c, ps in spec.items()
                     for i, p in enumerate(ps)])
    return q.select(F.struct(*q.columns)).scalar()


def classify_users(summary: DataFrame, method: str = "distributed") -> DataFrame:
    """Zombie -> At-Risk -> Champion -> Underutilized -> Healthy (first match),
    plus recommended tier, licence costs and potential saving; ``is_zombie``
    is replaced by category == Zombie. Thresholds are exact quantiles
    (``method``, see ``quantile_row``), one scalar subquery; measures that the summary lacks count as 0."""
    from ..sources.tables import with_missing

    summary = with_missing(summary, ["total_cost", "total_tokens", "prompt_count", "tickets_closed", "prs_merged",
                                     "license_type", "pct_improvement", "net_roi"])
    q = quantile_row(summary, {
        "total_cost": [P.AT_RISK_COST_P, P.UNDERUTIL_COST_P],
        "tickets_closed": [P.AT_RISK_OUTPUT_P, P.UNDERUTIL_OUTPUT_P],
        "pct_improvement": [P.CHAMPION_IMPROVEMENT_P]}, method)
    row = F.col("_thresholds")  # a subquery is copied wherever it is written, so it is written once
    th = {"cost_hi": row["total_cost_q0"], "cost_lo": row["total_cost_q1"], "out_lo": row["tickets_closed_q0"],
          "out_mid": row["tickets_closed_q1"], "impr_hi": row["pct_improvement_q0"]}
    columns = summary.columns
    summary = summary.withColumn("_thresholds", q)
    cost, tickets = F.col("total_cost"), F.col("tickets_closed")
    impr, roi = F.col("pct_improvement"), F.col("net_roi")
    category = (F.when((cost > th["cost_hi"]) & (tickets == 0), "Zombie")
                .when((cost >= th["cost_hi"]) & (tickets <= th["out_lo"]) & (tickets > 0), "At-Risk")
                .when((impr >= th["impr_hi"]) & (roi > 0), "Champion")
                .when((cost <= th["cost_lo"]) & (tickets <= th["out_mid"]), "Underutilized")
                .otherwise("Healthy"))
    tier = recommend_tier("total_tokens", "prompt_count", "tickets_closed")
    out = (summary.withColumn("category", category).select(*columns, "category")
           .withColumn("is_zombie", (F.col("category") == "Zombie").cast("int"))
           .withColumn("recommended_tier", tier)
           .withColumn("current_licence_cost", licence_cost("license_type"))
           .withColumn("recommended_licence_cost", licence_cost("recommended_tier")))
    return out.withColumn("potential_saving",
                          F.greatest(F.col("current_licence_cost") - F.col("recommended_licence_cost"), F.lit(0.0)))


def optimisation_summary(classified: DataFrame) -> DataFrame:
    """One row of class counts and savings (zeros for an empty input)."""
    cat = F.col("category")
    down = cat.isin("Zombie", "At-Risk", "Underutilized") & (F.col("potential_saving") > 0)
    g = classified.agg(
        F.count(F.lit(1)).alias("total_users"),
        F.count_if(cat == "Champion").alias("champion_count"),
        F.count_if(cat == "Healthy").alias("healthy_count"),
        F.count_if(cat == "Underutilized").alias("underutil_count"),
        F.count_if(cat == "At-Risk").alias("at_risk_count"),
        F.count_if(cat == "Zombie").alias("zombie_count"),
        F.count_if(down).alias("downgrade_candidates"),
        F.coalesce(exact_sum(F.when(cat == "Zombie", F.col("current_licence_cost")), 2), F.lit(0.0)).alias("_mz"),
        F.coalesce(exact_sum(F.when(down, F.col("potential_saving")), 2), F.lit(0.0)).alias("_md"))
    total = F.col("_mz") + F.col("_md")
    return g.select("total_users", "champion_count", "healthy_count", "underutil_count", "at_risk_count",
                    "zombie_count",
                    round_dec(F.coalesce(safe_div(F.col("zombie_count") * 100.0, F.col("total_users")),
                                         F.lit(0.0)), 1).alias("zombie_pct"),
                    "downgrade_candidates",
                    round_dec(F.col("_mz"), 2).alias("monthly_saving_zombies"),
                    round_dec(F.col("_md"), 2).alias("monthly_saving_downgrades"),
                    round_dec(total, 2).alias("total_monthly_saving"),
                    round_dec(total * 12, 2).alias("annual_saving_projection"))


def category_distribution(classified: DataFrame) -> DataFrame:
    """The five categories in fixed order, zero filled, with % of users."""
    spark = classified.sparkSession
    dim = spark.createDataFrame([(i, c) for i, c in enumerate(P.CATEGORY_ORDER)], "cat_idx int, category string")
    counts = classified.groupBy("category").agg(F.count(F.lit(1)).alias("n"))
    total = classified.agg(F.count(F.lit(1))).scalar()
    n = F.coalesce(F.col("n"), F.lit(0))
    return (F.broadcast(dim).join(counts, "category", "left")
            .select("category", n.alias("count"),
                    round_dec(n / F.greatest(total, F.lit(1)) * 100, 1).alias("pct"), "cat_idx")
            .orderBy("cat_idx").drop("cat_idx"))


def top_performers(summary: DataFrame, n: int = 10) -> DataFrame:
    """T4: top-n users by pct_improvement (tie-break: user_id)."""
    cols = [c for c in ("user_id", "employee_name", "department", "role", "category", "pct_improvement",
                        "tickets_closed", "hours_saved_per_ticket", "net_roi", "total_cost")
            if c in summary.columns]
    return summary.select(*cols).orderBy(F.col("pct_improvement").desc(), "user_id").limit(n)


def zombie_report(classified: DataFrame) -> DataFrame:
    """Every Zombie, by spend."""
    return (classified.where(F.col("category") == "Zombie")
            .select("user_id", "employee_name", "department", "role", "license_type", "total_cost",
                    "total_tokens", "prompt_count", "tickets_closed", "current_licence_cost")
            .orderBy(F.col("total_cost").desc(), "user_id"))


def at_risk_report(classified: DataFrame) -> DataFrame:
    """Every At-Risk user, by spend."""
    return (classified.where(F.col("category") == "At-Risk")
            .select("user_id", "employee_name", "department", "role", "total_cost", "tickets_closed",
                    "pct_improvement", "net_roi", "recommended_tier", "potential_saving")
            .orderBy(F.col("total_cost").desc(), "user_id"))
