"""Loaded business tables for one data folder: the canonical tables plus the
derived columns the original load step stores (prompt cost, risk scan,
PR cycle/rework, contributor mapping).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..functions.risk import with_risk
from ..operators.pulls import enrich_pull_requests, map_contributors, pr_derived
from ..operators.usage import enrich_usage, with_prompt_cost
from ..sources.canonical import Canonical


class Inputs:
    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = spark
        self.c = Canonical(spark, sf_dir)

    def users(self) -> DataFrame:
        return self.c.users()

    def logs_raw(self) -> DataFrame:
        return self.c.logs()

    def logs_cost(self) -> DataFrame:
        """Usage logs with ``cost_usd`` (P10)."""
        return with_prompt_cost(self.c.logs(), self.c.model_rate())

    def logs(self, dedupe: bool = True) -> DataFrame:
        """Usage logs with cost and the stored risk columns (P10 + G6).

        ``dedupe`` scores each distinct prompt text once (prompts repeat) and
        joins the scores and texts back on a SHA-256 key; the shuffle that finds
        the distinct texts also spreads the CPU-bound scan over all tasks.
        """
        lc = self.logs_cost()
        if not dedupe:
            return with_risk(lc, types=False)
        from ..operators.governance import with_risk_deduped

        return with_risk_deduped(lc, types=False, id_col="prompt_id")

    def logs_enriched(self, texts: Callable[[DataFrame, str], DataFrame] | None = None) -> DataFrame:
        """``logs`` with user attributes and time features (J1 + P14 + P1): the rows meet their users without their texts.
        ``texts(frame, column)`` may change the distinct texts before the rows get them."""
        from ..operators.governance import with_risk_deduped

        out = with_risk_deduped(self.logs_cost(), types=False, id_col="prompt_id",
                                meanwhile=lambda rows: enrich_usage(rows, self.users()), texts=texts)
        return out.select("user_id", *[c for c in out.columns if c != "user_id"])  # the order of enrich_usage

    def logs_stored(self, path: str) -> DataFrame:
        """``logs`` without their texts, written to ``path`` and reread: for jobs that read the logs several times, each of which
        would else derive the logs and scan the texts again."""
        from ..sources.sinks import write_table

        write_table(self.logs().drop("prompt_text"), path)
        return self.spark.read.parquet(path)

    def tickets(self) -> DataFrame:
        return self.c.tickets()

    def pull_requests(self) -> DataFrame:
        """PR table as stored: user_id mapped (S13), cycle and rework derived."""
        return pr_derived(map_contributors(self.c.pull_requests(), self.users()))

    def pull_requests_enriched(self) -> DataFrame:
        """PR table after P4 department fill and P3 period backfill."""
        return enrich_pull_requests(self.pull_requests(), self.c.repo_department())

