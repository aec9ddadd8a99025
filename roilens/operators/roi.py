"""ROI operators: A1 user ROI, A2 department roll-up, A3 user summary,
A13 analytics cache, A14 department risk, A15 executive KPIs, A16 benchmark.

Shape of every operator: aggregate each fact table to the user (or
department) grain first -- partial aggregation happens map-side, so only one
row per key and partition crosses the shuffle -- then left-join the small
aggregates onto the dimension. The Before/After split is conditional
aggregation in one pass over the ticket table instead of two filtered scans.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.numeric import exact_mean, exact_sum, round_dec, safe_div
from .stats import add_quantiles

BEFORE, AFTER = "Before", "After"


def _is(period: str):
    return F.col("period") == period


def usage_per_user(logs: DataFrame) -> DataFrame:
    """Spend, tokens and prompt count per user (one shuffle, map-side combine)."""
    return (logs.groupBy("user_id")
            .agg(exact_sum("cost_usd", 6).alias("total_cost"),
                 F.sum("token_count").alias("total_tokens"),
                 F.count("prompt_id").alias("prompt_count")))


def tickets_per_user(tickets: DataFrame) -> DataFrame:
    """Before/After ticket measures per user in one pass.

    before_avg / after_avg: mean cycle of the period (NULL if none);
    before_count: Before rows; after_closed: SUM(jira_tickets_closed) of After rows.
    """
    cyc = F.col("cycle_time_hours")
    return (tickets.where(F.col("period").isin(BEFORE, AFTER))
            .groupBy("user_id")
            .agg(exact_mean(F.when(_is(BEFORE), cyc)).alias("before_avg"),
                 F.count_if(_is(BEFORE)).alias("before_count"),
                 exact_mean(F.when(_is(AFTER), cyc)).alias("after_avg"),
                 F.sum(F.when(_is(AFTER), F.col("jira_tickets_closed"))).alias("after_closed"),
                 F.count_if(_is(AFTER)).alias("after_count")))


def user_roi(users: DataFrame, logs: DataFrame, tickets: DataFrame) -> DataFrame:
    """A1: per-user ROI, unclipped (hours saved may be negative).

    ``tickets_before`` counts Before tickets, ``tickets_after`` sums tickets
    closed After; ``pct_improvement`` is NULL when the Before mean is 0.
    """
    cost = usage_per_user(logs)
    tk = tickets_per_user(tickets)
    b = F.coalesce(F.col("before_avg"), F.lit(0.0))
    a = F.coalesce(F.col("after_avg"), F.lit(0.0))
    n_after = F.coalesce(F.col("after_closed"), F.lit(0)).cast("bigint")
    spend = F.coalesce(F.col("total_cost"), F.lit(0.0))
    dollars = (b - a) * n_after * F.col("hourly_rate")
    return (users.join(cost, "user_id", "left").join(tk, "user_id", "left")
            .select("user_id", "employee_name", "department", "role", "hourly_rate",
                    "license_type", "github_username",
                    spend.alias("total_ai_cost"),
                    F.coalesce(F.col("total_tokens"), F.lit(0)).alias("total_tokens"),
                    F.coalesce(F.col("prompt_count"), F.lit(0)).alias("total_prompts"),
                    b.alias("avg_cycle_before_hrs"),
                    F.coalesce(F.col("before_count"), F.lit(0)).alias("tickets_before"),
                    a.alias("avg_cycle_after_hrs"),
                    n_after.alias("tickets_after"),
                    round_dec(b - a, 2).alias("hours_saved_per_ticket"),
                    round_dec(safe_div(b - a, b) * 100, 1).alias("pct_improvement"),
                    round_dec(dollars, 2).alias("dollar_value_saved"),
                    round_dec(dollars - spend, 2).alias("net_roi"))
            .orderBy(F.col("net_roi").desc_nulls_last(), "user_id"))


def _mean12(x):
    """Order-independent mean of arbitrary doubles (through decimal(30,12))."""
    return exact_mean(x)


def dept_roi(users: DataFrame, logs: DataFrame, tickets: DataFrame) -> DataFrame:
    """A2 / Q2: department roll-up of per-user aggregates (avg of user averages;
    avg risk over users with any flagged prompt). NULL department kept.

    Spend and mean positive risk per user come from ONE aggregation over the
    logs (one scan, one shuffle) instead of two.
    """
    s = F.col("risk_score")
    per_user = logs.groupBy("user_id").agg(
        exact_sum("cost_usd", 6).alias("total_cost"),
        exact_mean(F.when(s > 0, s)).alias("avg_risk"))
    tk = tickets_per_user(tickets)
    j = users.select("user_id", "department").join(per_user, "user_id", "left").join(tk, "user_id", "left")
    g = j.groupBy("department").agg(
        F.countDistinct("user_id").alias("headcount"),
        round_dec(exact_sum("total_cost", 6), 2).alias("dept_ai_spend"),
        _mean12("before_avg").alias("_b"),
        _mean12("after_avg").alias("_a"),
        round_dec(_mean12("avg_risk"), 2).alias("avg_risk_score"))
    b, a = F.col("_b"), F.col("_a")
    return (g.select("department", "headcount", "dept_ai_spend",
                     round_dec(b, 2).alias("avg_cycle_before"), round_dec(a, 2).alias("avg_cycle_after"),
                     round_dec(safe_div(b - a, b) * 100, 1).alias("dept_efficiency_pct"),
                     "avg_risk_score")
            .orderBy(F.col("dept_efficiency_pct").desc_nulls_last(), "department"))


def pr_per_user(prs: DataFrame) -> DataFrame:
    """Merged PR count, mean cycle and mean rework per mapped user."""
    return (prs.where((F.col("pr_state") == "merged") & F.col("user_id").isNotNull())
            .groupBy("user_id")
            .agg(F.count("pr_id").alias("prs_merged"),
                 exact_mean("cycle_time_hours").alias("avg_pr_cycle"),
                 exact_mean("rework_ratio").alias("avg_rework")))


def user_summary(users: DataFrame, logs: DataFrame, tickets: DataFrame,
                 prs: DataFrame | None = None, method: str = "distributed") -> DataFrame:
    """A3: per-user summary with clipped ROI and the median-spend zombie flag.

    Aggregates per user, left-joined onto the user dimension (no per-user
    loop). The median spend is an exact quantile used as a scalar subquery
    (``method``: see ``licences.quantile_row``).
    """
    cost = usage_per_user(logs)
    tk = tickets_per_user(tickets)
    j = users.join(cost, "user_id", "left").join(tk, "user_id", "left")
    if prs is not None:
        j = j.join(pr_per_user(prs), "user_id", "left")
    else:
        j = j.withColumns({"prs_merged": F.lit(None).cast("bigint"),
                           "avg_pr_cycle": F.lit(None).cast("double"),
                           "avg_rework": F.lit(None).cast("double")})
    s = j.select(*users.columns,
                 F.coalesce(F.col("total_cost"), F.lit(0.0)).alias("total_cost"),
                 F.coalesce(F.col("total_tokens"), F.lit(0)).alias("total_tokens"),
                 F.coalesce(F.col("prompt_count"), F.lit(0)).alias("prompt_count"),
                 F.coalesce(F.col("before_avg"), F.lit(0.0)).alias("avg_cycle_before"),
                 F.coalesce(F.col("after_avg"), F.lit(0.0)).alias("avg_cycle_after"),
                 F.coalesce(F.col("after_closed"), F.lit(0)).cast("bigint").alias("tickets_closed"),
                 F.coalesce(F.col("prs_merged"), F.lit(0)).alias("prs_merged"),
                 F.coalesce(F.col("avg_pr_cycle"), F.lit(0.0)).alias("avg_pr_cycle"),
                 F.coalesce(F.col("avg_rework"), F.lit(0.0)).alias("avg_rework"))
    hours = F.greatest(F.col("avg_cycle_before") - F.col("avg_cycle_after"), F.lit(0.0))
    s = s.withColumn("hours_saved_per_ticket", hours)
    dollars = F.coalesce(F.col("hours_saved_per_ticket") * F.col("tickets_closed") * F.col("hourly_rate"),
                         F.lit(0.0))
    s = (s.withColumn("dollar_value_saved", dollars)
         .withColumn("net_roi", F.coalesce(F.col("dollar_value_saved") - F.col("total_cost"), F.lit(0.0)))
         .withColumn("pct_improvement",
                     round_dec(F.coalesce(safe_div(F.col("hours_saved_per_ticket"), F.col("avg_cycle_before")) * 100,
                                          F.lit(0.0)), 1)))
    from .licences import quantile_row

    # the median spend needs only users and their spend: not the ticket/PR joins
    spend = (users.select("user_id").join(cost, "user_id", "left")
             .select(F.coalesce(F.col("total_cost"), F.lit(0.0)).alias("total_cost")))
    med = quantile_row(spend, {"total_cost": [0.5]}, method)["total_cost_q0"]
    zombie = ((F.col("total_cost") > med) & (F.col("tickets_closed") == 0) & (F.col("prs_merged") == 0)
              & (F.col("total_cost") > 0))
    return s.withColumn("is_zombie", F.coalesce(zombie, F.lit(False)).cast("int"))


def dept_risk(logs: DataFrame) -> DataFrame:
    """Per department, p80 of positive risk scores, capped at 100, 1 dp; 0 if none."""
    rows = logs.where(F.col("department").isNotNull()).select(
        "department", F.when(F.col("risk_score") > 0, F.col("risk_score")).alias("risk"))
    g = rows.groupBy("department").agg(F.count("risk").alias("_n"))
    return add_quantiles(g, rows, ["department"], {"risk": [0.8]}).select(
        "department",  # least() skips NULLs, so "no positive score" is handled first
        F.when(F.col("risk_q0").isNull(), F.lit(0.0)).otherwise(round_dec(F.least(F.col("risk_q0"), F.lit(100.0)), 1))
        .alias("dept_risk_score"))


def analytics_cache(summary: DataFrame, logs: DataFrame, computed_at: str | None = None) -> DataFrame:
    """User x month cache rows.

    Monthly spend/tokens/flagged prompts per (user, month) joined to the
    whole-period user summary (ROI recomputed against that month's spend, as
    designed) and the department risk score. ``cache_id`` is a deterministic
    hash of (user, month) so reruns are idempotent; ``computed_at`` is a
    parameter (NULL when not given) so outputs are reproducible.
    """
    from ..functions.roi import roi_columns

    monthly = (logs.withColumn("month_year", F.date_format("timestamp", "yyyy-MM"))
               .where(F.col("month_year").isNotNull() & F.col("user_id").isNotNull())
               .groupBy("user_id", "month_year")
               .agg(exact_sum("cost_usd", 6).alias("m_cost"),
                    F.sum("token_count").alias("m_tokens"),
                    F.sum("risk_flag").alias("m_flags")))
    su = summary.select("user_id", "department", "avg_cycle_before", "avg_cycle_after",
                        "tickets_closed", "hourly_rate", "avg_pr_cycle")
    j = su.join(monthly, "user_id", "inner")
    roi = roi_columns("avg_cycle_before", "avg_cycle_after", "tickets_closed", "hourly_rate", "m_cost")
    rows = j.select(
        F.sha2(F.concat_ws("|", F.col("user_id"), F.col("month_year")), 256).alias("cache_id"),
        "user_id", "department", "month_year",
        F.col("m_cost").alias("total_ai_cost"),
        F.coalesce(F.col("m_tokens"), F.lit(0)).cast("bigint").alias("total_tokens"),
        F.col("avg_cycle_before").alias("tickets_before_avg"),
        F.col("avg_cycle_after").alias("tickets_after_avg"),
        roi["hours_saved_per_ticket"].alias("hours_saved"),
        roi["dollar_value_saved"].alias("dollar_value_saved"),
        roi["net_roi"].alias("net_roi"),
        F.coalesce(F.col("m_flags"), F.lit(0)).cast("bigint").alias("pii_violations"),
        F.col("avg_pr_cycle").alias("pr_cycle_time_avg"))
    risk = dept_risk(logs)
    out = rows.join(risk, "department", "left")
    ts = F.lit(computed_at).cast("string") if computed_at else F.lit(None).cast("string")
    return out.withColumn("computed_at", ts)


def executive_kpis(logs: DataFrame, tickets: DataFrame, users: DataFrame) -> DataFrame:
    """One row -- spend, unclipped cycle improvement, tokens, High/Critical
    prompts, users with a GitHub login. Each measure is a scalar subquery."""
    spend = logs.agg(exact_sum("cost_usd", 6)).scalar()
    tokens = logs.agg(F.sum("token_count")).scalar()
    high = logs.agg(F.count_if(F.col("risk_level").isin("High", "Critical"))).scalar()
    b = tickets.agg(exact_mean(F.when(F.col("period") == BEFORE, F.col("cycle_time_hours")))).scalar()
    a = tickets.agg(exact_mean(F.when(F.col("period") == AFTER, F.col("cycle_time_hours")))).scalar()
    matched = users.agg(F.count("github_username")).scalar()
    pct = F.when(b > 0, (b - a) / b * 100).otherwise(F.lit(0.0))  # null while there is no After ticket
    one = users.sparkSession.range(1)
    return one.select(round_dec(F.coalesce(spend, F.lit(0.0)), 2).alias("total_spend"),
                      round_dec(pct, 1).alias("pct_improvement"),
                      F.coalesce(tokens, F.lit(0)).cast("bigint").alias("total_tokens"),
                      F.coalesce(high, F.lit(0)).cast("bigint").alias("high_risk_events"),
                      F.coalesce(matched, F.lit(0)).cast("bigint").alias("github_matched"))


def dept_benchmark(classified: DataFrame) -> DataFrame:
    """Department benchmark over the (classified) user summary."""
    g = (classified.where(F.col("department").isNotNull()).groupBy("department")
         .agg(F.count("user_id").alias("headcount"),
              exact_sum("total_cost", 6).alias("total_spend"),
              exact_mean("pct_improvement").alias("avg_pct_improvement"),
              # sums/means of arbitrary doubles are reported at 6 dp (engine-independent)
              round_dec(exact_sum("net_roi", 12, 30), 6).alias("total_net_roi"),
              round_dec(_mean12("hours_saved_per_ticket"), 6).alias("avg_hours_saved"),
              F.sum("tickets_closed").cast("bigint").alias("total_tickets"),
              F.sum("is_zombie").cast("bigint").alias("zombie_count")))
    return (g.withColumn("roi_per_dollar_spent",
                         round_dec(F.coalesce(safe_div(F.col("total_net_roi"), F.col("total_spend")), F.lit(0.0)), 3))
            .withColumn("zombie_pct", round_dec(F.col("zombie_count") / F.col("headcount") * 100, 1))
            .orderBy(F.col("avg_pct_improvement").desc(), "department"))
