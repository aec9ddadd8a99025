"""Batch jobs B1-B5: compositions of the operators, published by version
(``sources/versions.py``): a rerun yields the same rows, and a job that dies
half-way leaves the last version. Intermediate results reused by several outputs (the user summary) are
written once to the job's shared output folder and read back, which also cuts
the lineage.

    spark-submit -m roilens.plans.jobs --mode analyze --sf-dir /data/sf1 --out /shared/out
"""

from __future__ import annotations

import argparse
import datetime as _dt
import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import params as P
from .. import schemas
from ..operators.governance import apply_risk_update, redact_frame, scan_logs
from ..operators.licences import classify_users, optimisation_summary
from ..operators.pulls import department_fill, pr_delta, pr_performance, pr_sync_summary
from ..operators.roi import analytics_cache, executive_kpis, user_summary
from ..operators.tickets import dept_performance
from ..operators.usage import enrich_usage
from ..sources.ingest import ingest_pull_requests, quarantine, read_landed
from ..sources.sinks import export_bundle, privacy_projection, replace_repo, write_csv
from ..sources.versions import VersionedTable, read_table
from ..functions.pulls import ntz_literal, period_backfill
from .inputs import Inputs


class Tables:
    """Where the business tables come from: a folder of driver tables mapped
    through the canonical SQL (``sf_dir``) or stored business tables."""

    def __init__(self, spark: SparkSession, sf_dir: str | None = None, tables_dir: str | None = None):
        self.spark = spark
        self.i = Inputs(spark, sf_dir) if sf_dir else None
        self.tables_dir = tables_dir.rstrip("/") if tables_dir else None
        self.stored: dict[str, str] = {}

    def use(self, name: str, path: str) -> str:
        """From now on table ``name`` is what a stage wrote to ``path``."""
        self.stored[name] = path
        return path

    def _stored(self, name: str) -> DataFrame | None:
        from ..sources.tables import load
        return load(self.spark, self.stored[name], name) if name in self.stored else None

    def _load(self, name: str) -> DataFrame:
        from ..sources.tables import load
        return load(self.spark, f"{self.tables_dir}/{name}", name)

    def users(self):
        return self.i.users() if self.i else self._load("users_master")

    def logs(self):
        stored = self._stored("ai_usage_logs")
        if stored is not None:
            return stored
        return self.i.logs() if self.i else self._load("ai_usage_logs")

    def tickets(self):
        return self.i.tickets() if self.i else self._load("tickets")

    def pull_requests(self):
        stored = self._stored("pull_requests")
        if stored is not None:
            return stored
        return self.i.pull_requests() if self.i else self._load("pull_requests")

    def repo_department(self):
        return self.i.c.repo_department() if self.i else self._load("repo_department")


def run_scan(t: Tables, out: str) -> str:
    """B1: score every prompt (distinct texts once) and publish the log table, laid out by department,
    with updated risk columns."""
    logs = t.logs()
    upd = scan_logs(logs, dedupe=True).drop("pii_types")
    path = f"{out}/ai_usage_logs"
    VersionedTable(t.spark, path).replace(apply_risk_update(logs, upd), "department")
    return path


def run_pr_sync(t: Tables, raw_path: str, out: str, since: _dt.datetime | None = None, repo: str | None = None,
                cutoff: _dt.datetime = P.ADOPTION_CUTOFF) -> dict[str, DataFrame]:
    """B2: landed PR JSON -> S7 (unreadable lines to ``quarantine/``) -> P3/P4 -> replace (S10) -> A9/A7 reports and counts.
    ``since`` limits the sync to PRs created from then on, ``repo`` to one repository; what lies outside stays."""
    spark = t.spark
    raw, rejects = read_landed(spark, raw_path, schemas.RAW_PR)
    rejected = quarantine(spark, rejects, f"{out}/quarantine/pull_requests")
    prs = ingest_pull_requests(raw, t.users(), t.repo_department(), since, cutoff=cutoff)
    prs = department_fill(prs, t.repo_department()).withColumn(
        "period", period_backfill("period", "merged_at", cutoff))
    path = f"{out}/pull_requests"
    table = VersionedTable(spark, path)
    if since is not None and table.exists():  # the feed says nothing about older rows: they stay
        older = table.read() if repo is None else table.read([repo])
        prs = prs.unionByName(older.where(F.col("created_at").isNull() | (F.col("created_at") < ntz_literal(since))).select(*prs.columns))
    replace_repo(spark, prs, path, repo)  # a full sync replaces all: repositories that left the feed leave the table
    stored = table.read()
    counts = spark.createDataFrame([(stored.count(), rejected)], "stored long, rejected long")
    return {"sync_summary": pr_sync_summary(stored), "delta": pr_delta(pr_performance(stored)), "ingest_counts": counts}


def run_analytics(t: Tables, out: str, computed_at: str | None = None) -> dict[str, str]:
    """Summary -> classification -> cache, KPIs, optimisation, department performance, and the processed bundle
    (enriched logs with redacted texts, PRs without user ids), each published. The summary is written once and reused."""
    spark = t.spark
    users, logs, tickets, prs = t.users(), t.logs(), t.tickets(), t.pull_requests()
    paths = {k: f"{out}/{k}" for k in ("user_summary", "classified", "analytics_cache", "kpis", "optimisation",
                                       "dept_performance", "usage_logs_enriched", "github_pr_enriched")}

    def publish(name: str, df: DataFrame) -> DataFrame:
        table = VersionedTable(spark, paths[name])
        table.replace(df)
        return table.read()

    summary = publish("user_summary", user_summary(users, logs, tickets, prs))
    classified = publish("classified", classify_users(summary))
    enriched = enrich_usage(logs, users)
    publish("analytics_cache", analytics_cache(summary, enriched, computed_at))
    publish("kpis", executive_kpis(logs, tickets, users))
    publish("optimisation", optimisation_summary(classified))
    publish("dept_performance", dept_performance(tickets))
    publish("usage_logs_enriched", redact_frame(enriched, "prompt_text"))  # the processed bundle: texts redacted,
    publish("github_pr_enriched", privacy_projection(prs))  # no user ids
    return paths


def run_export(t: Tables, out: str, analytics: dict[str, str] | None = None) -> dict[str, str]:
    """Redacted logs, department performance, classified summary, PRs
    without user_id -- as CSV. Reuses B3's outputs when given."""
    spark = t.spark
    users, logs, tickets = t.users(), t.logs(), t.tickets()
    if analytics:
        dept = read_table(spark, analytics["dept_performance"])
        classified = read_table(spark, analytics["classified"])
    else:
        dept = dept_performance(tickets)
        classified = classify_users(user_summary(users, logs, tickets, t.pull_requests()))
    return export_bundle(f"{out}/export", enrich_usage(logs, users), dept, classified, t.pull_requests(),
                         fmt="csv")


MODES = {
    "synthetic": ("scan", "analytics", "export"),
    "live": ("scan", "sync", "analytics", "export"),
    "github-only": ("sync",),
    "analyze": ("analytics", "export"),
}


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> dict:
    """Mode switch with skip flags."""
    ap = argparse.ArgumentParser(prog="roilens-jobs")
    ap.add_argument("--mode", choices=sorted(MODES), default="synthetic")
    ap.add_argument("--sf-dir")
    ap.add_argument("--tables-dir")
    ap.add_argument("--out", required=True)
    ap.add_argument("--raw-prs")
    ap.add_argument("--since", default=None, help="sync only PRs created from this time on (the caller's choice)")
    ap.add_argument("--repo", default=None)
    ap.add_argument("--skip-scan", action="store_true")
    ap.add_argument("--skip-sync", action="store_true")
    ap.add_argument("--skip-export", action="store_true")
    a = ap.parse_args(argv)
    spark = spark or SparkSession.builder.getOrCreate()
    t = Tables(spark, a.sf_dir, a.tables_dir)
    out = a.out.rstrip("/")
    if out == t.tables_dir:  # a stage must not overwrite the table that it reads
        out = f"{out}/updated"
    done: dict = {}
    skipped = {s for s, skip in (("scan", a.skip_scan), ("sync", a.skip_sync), ("export", a.skip_export)) if skip}
    stages = [s for s in MODES[a.mode] if s not in skipped]
    for stage in stages:
        if stage == "scan":
            done["scan"] = t.use("ai_usage_logs", run_scan(t, out))
        elif stage == "sync":
            if not a.raw_prs:
                raise SystemExit("--raw-prs is required for the sync stage")
            reports = run_pr_sync(t, a.raw_prs, out, _dt.datetime.fromisoformat(a.since) if a.since else None, a.repo)
            for k, df in reports.items():
                write_csv(df, f"{out}/reports/{k}")
            done["sync"] = t.use("pull_requests", f"{out}/pull_requests")
        elif stage == "analytics":
            done["analytics"] = run_analytics(t, out)
        elif stage == "export":
            done["export"] = run_export(t, out, done.get("analytics"))
    print(json.dumps(done))
    return done


if __name__ == "__main__":
    main()
