"""Ticket operators: P8 cycle backfill, A4 department performance, A10
velocity and throughput delta, A11 priority breakdown, R1 resolution heatmap,
D8 mean cycle by period, D9 story points vs cycle OLS, D10 priority counts.

Before/After comparisons are conditional aggregates in one pass (one scan,
one shuffle of department-sized partials) instead of an outer join of two
filtered aggregates.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import params as P
from ..functions.numeric import clip0, exact_mean, round_dec, safe_div
from ..functions.pulls import ticket_cycle_backfill
from .stats import add_quantiles


def _b():
    return F.col("period") == "Before"


def _a():
    return F.col("period") == "After"


def _cyc():
    return F.col("cycle_time_hours")


def backfill_cycle(tickets: DataFrame) -> DataFrame:
    """cycle_time_hours == 0 -> (resolved - created) hours, NULL -> 0, floor 0."""
    return tickets.withColumn("cycle_time_hours",
                              ticket_cycle_backfill("cycle_time_hours", "created_at", "resolved_at"))


def dept_performance(tickets: DataFrame) -> DataFrame:
    """A4: Before/After mean, median and count of cycle time per department.

    A side with no tickets is NULL (outer-join semantics); hours saved are
    clipped at 0 but stay NULL when a side is missing; pct is 0 then. Medians
    are found by rank selection (``stats.exact_quantiles``).
    """
    def side(cond, name):
        x = F.when(cond, _cyc())
        n = F.count(x)
        return [exact_mean(x).alias(f"{name}_mean"), F.when(n > 0, n).alias(f"{name}_count")]

    rows = tickets.where(F.col("department").isNotNull() & F.col("period").isin("Before", "After"))
    g = rows.groupBy("department").agg(*side(_b(), "before"), *side(_a(), "after"))
    sides = rows.select("department", F.when(_b(), _cyc()).alias("before"), F.when(_a(), _cyc()).alias("after"))
    g = add_quantiles(g, sides, ["department"], {"before": [0.5], "after": [0.5]})
    g = g.select("department", "before_mean", F.col("before_q0").alias("before_median"), "before_count",
                 "after_mean", F.col("after_q0").alias("after_median"), "after_count")
    hs = clip0(F.col("before_mean") - F.col("after_mean"))
    return (g.withColumn("hours_saved_mean", hs)
            .withColumn("hours_saved_median", clip0(F.col("before_median") - F.col("after_median")))
            .withColumn("pct_improvement",
                        round_dec(F.coalesce(safe_div(F.col("hours_saved_mean"), F.col("before_mean")) * 100,
                                             F.lit(0.0)), 1)))


def velocity(tickets: DataFrame) -> DataFrame:
    """A10: tickets, story points and cycle statistics per department x period."""
    keys = ["department", "period"]
    rows = tickets.where(F.col("department").isNotNull() & F.col("period").isNotNull())
    g = rows.groupBy(*keys).agg(F.count("jira_issue_id").alias("total_tickets"),
                                F.sum("story_points").cast("bigint").alias("total_story_points"),
                                round_dec(exact_mean(_cyc()), 2).alias("avg_cycle_hours"))
    return add_quantiles(g, rows, keys, {"cycle_time_hours": [0.5, 0.9]}).select(
        *g.columns, round_dec("cycle_time_hours_q0", 2).alias("median_cycle_hours"),
        round_dec("cycle_time_hours_q1", 2).alias("p90_cycle_hours"))


def throughput_delta(vel: DataFrame) -> DataFrame:
    """A10 delta: per department, a missing period counts as 0."""
    def pick(cond, col):
        return F.coalesce(F.max(F.when(cond, F.col(col))), F.lit(0))

    g = vel.groupBy("department").agg(
        pick(_b(), "avg_cycle_hours").cast("double").alias("before_cycle"),
        pick(_a(), "avg_cycle_hours").cast("double").alias("after_cycle"),
        pick(_b(), "total_story_points").cast("bigint").alias("before_points"),
        pick(_a(), "total_story_points").cast("bigint").alias("after_points"))
    bc, ac = F.col("before_cycle"), F.col("after_cycle")
    bp, ap = F.col("before_points"), F.col("after_points")
    return (g.withColumn("cycle_improvement_pct",
                         round_dec(F.coalesce(safe_div(bc - ac, bc) * 100, F.lit(0.0)), 1))
            .withColumn("throughput_lift_pct",
                        round_dec(F.coalesce(safe_div((ap - bp).cast("double"), bp) * 100, F.lit(0.0)), 1))
            .orderBy(F.col("cycle_improvement_pct").desc(), "department"))


def priority_breakdown(tickets: DataFrame) -> DataFrame:
    """Ticket count per department x priority x period."""
    return (tickets.where(F.col("department").isNotNull() & F.col("priority").isNotNull()
                          & F.col("period").isNotNull())
            .groupBy("department", "priority", "period")
            .agg(F.count("jira_issue_id").alias("ticket_count")))


def resolution_heatmap(tickets: DataFrame, priorities=P.PRIORITY_ORDER) -> DataFrame:
    """Mean cycle, department x priority, missing cell -> 0, 2 dp.

    The priority domain is a fixed parameter, so the pivot needs no extra
    job to discover its values.
    """
    return (tickets.where(F.col("department").isNotNull())
            .groupBy("department").pivot("priority", list(priorities))
            .agg(exact_mean(_cyc()))
            .select("department", *[round_dec(F.coalesce(F.col(p), F.lit(0.0)), 2).alias(p)
                                    for p in priorities]))


def cycle_by_period(tickets: DataFrame) -> DataFrame:
    """Mean cycle per department x period, 1 dp."""
    return (tickets.where(F.col("department").isNotNull() & F.col("period").isNotNull())
            .groupBy("department", "period")
            .agg(round_dec(exact_mean(_cyc()), 1).alias("mean_hours")))


def points_vs_cycle(tickets: DataFrame) -> DataFrame:
    """OLS of cycle time on story points per period (rows with both > 0)."""
    x, y = F.col("story_points").cast("double"), _cyc()
    return (tickets.where((F.col("story_points") > 0) & (_cyc() > 0) & F.col("period").isNotNull())
            .groupBy("period")
            .agg(F.regr_count(y, x).alias("n"),
                 round_dec(F.regr_slope(y, x), 4).alias("slope"),
                 round_dec(F.regr_intercept(y, x), 4).alias("intercept"),
                 round_dec(F.regr_r2(y, x), 4).alias("r_squared")))


def priority_counts(tickets: DataFrame) -> DataFrame:
    """Tickets per priority x period, in Low..Critical order."""
    order = F.create_map(*[x for i, p in enumerate(P.PRIORITY_ORDER) for x in (F.lit(p), F.lit(i))])
    return (tickets.where(F.col("priority").isNotNull() & F.col("period").isNotNull())
            .groupBy("priority", "period").agg(F.count("jira_issue_id").alias("count"))
            .orderBy(F.coalesce(F.try_element_at(order, F.col("priority")), F.lit(len(P.PRIORITY_ORDER))),
                     "priority", "period"))
