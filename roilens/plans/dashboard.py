"""The dashboard's initial load: every summary it shows, computed from ONE
load of the four business tables.

The loaded tables (users, priced and scored prompts, tickets, enriched pull
requests), the user summary and its classification are each written once as
Parquet under the shared checkpoint folder and read back; every summary is
then planned on these small tables. This is the Spark counterpart of loading
the tables into memory once and deriving twenty frames: one job per table,
and short lineages (cheap to plan, cheap to recompute after an executor
loss) instead of re-deriving the inputs inside every output.

At cluster scale the batch jobs (``plans/jobs.py``) write these summaries as
tables instead; this module is the interactive, single-session path.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from ..operators import governance, licences, pulls, roi, stats, tickets, usage
from .inputs import Inputs


class DashboardLoad:
    def __init__(self, spark: SparkSession, sf_dir: str):
        from ..session import ensure_checkpoint_dir

        i = Inputs(spark, sf_dir)
        root = f"{ensure_checkpoint_dir(spark).rstrip('/')}/roilens-dashboard-{uuid.uuid4().hex}"

        self.timings: dict[str, float] = {}

        def hold(df: DataFrame, name: str) -> DataFrame:
            import time

            t0 = time.perf_counter()
            path = f"{root}/{name}"
            df.write.mode("overwrite").parquet(path)
            self.timings[name] = round(time.perf_counter() - t0, 3)
            return spark.read.parquet(path)

        self.root = root
        self.users = hold(i.users(), "users")
        # the prompt text is not shown by these summaries: keep the scored columns only
        self.logs = hold(i.logs().drop("prompt_text"), "logs")
        self.tickets = hold(i.tickets(), "tickets")
        # one PR table serves both: the summary reads only user_id, state, cycle and rework,
        # which the department/period enrichment does not change
        self.prs_enriched = hold(pulls.enrich_pull_requests(i.pull_requests(), i.c.repo_department()),
                                 "prs_enriched")
        self.enriched = usage.enrich_usage(self.logs, self.users)
        self.summary = hold(roi.user_summary(self.users, self.logs, self.tickets, self.prs_enriched), "summary")
        self.classified = hold(licences.classify_users(self.summary), "classified")

    def outputs(self) -> dict[str, DataFrame]:
        velocity = tickets.velocity(self.tickets)
        perf = pulls.pr_performance(self.prs_enriched)
        return {
            "enriched": self.enriched,
            "dept_performance": tickets.dept_performance(self.tickets),
            "user_summary": self.summary,
            "classified": self.classified,
            "optimisation_summary": licences.optimisation_summary(self.classified),
            "executive_kpis": roi.executive_kpis(self.logs, self.tickets, self.users),
            "monthly_trend": usage.monthly_trend(self.logs),
            "dept_benchmark": roi.dept_benchmark(self.classified),
            "ticket_velocity": velocity,
            "throughput_delta": tickets.throughput_delta(velocity),
            "correlations": stats.spend_vs_productivity(self.classified, with_p=True),
            "pr_performance": perf,
            "pr_delta": pulls.pr_delta(perf),
            "top_contributors": pulls.top_contributors(self.prs_enriched),
            "repo_breakdown": pulls.repo_breakdown(self.prs_enriched),
            "pr_velocity_monthly": pulls.pr_velocity_monthly(self.prs_enriched),
            "risk_rollup": governance.risk_rollup(self.enriched),
        }

    def release(self) -> None:
        """Nothing is cached in memory; the written tables stay under ``root``."""
