"""Streaming scan on landed files, and the batch jobs end to end (rerun-stable)."""

import datetime as dt

from pyspark.sql import functions as F

from conftest import SF0001
from roilens import schemas
from roilens.plans.jobs import main
from roilens.sources.versions import read_table
from roilens.streaming.scan import start_scan


def test_streaming_scan(spark, scratch):
    src = f"{scratch}/landing"
    rows = [("P1", "U1", dt.datetime(2024, 1, 1), "D", "gpt-4.1-mini", "mail a@b.com", 1000),
            ("P2", "U2", dt.datetime(2024, 1, 2), "D", "error", "plain", 500)]
    cols = [f for f in schemas.USAGE_LOGS.fields if f.name not in ("cost_usd", "risk_flag", "risk_score",
                                                                    "risk_level")]
    from pyspark.sql import types as T
    spark.createDataFrame(rows, T.StructType(cols)).write.parquet(src)
    q = start_scan(spark, src, f"{scratch}/scored", f"{scratch}/ckpt")
    q.awaitTermination(120)
    out = {r["prompt_id"]: r for r in spark.read.parquet(f"{scratch}/scored").collect()}
    assert out["P1"]["risk_score"] == 25.0 and out["P1"]["pii_types"] == "REGEX:EMAIL"
    assert out["P1"]["cost_usd"] == 0.004 and out["P2"]["cost_usd"] == 0.0015


def test_jobs_synthetic_rerun_is_stable(spark, scratch):
    out = f"{scratch}/out"
    first = main(["--mode", "synthetic", "--sf-dir", SF0001, "--out", out], spark=spark)
    counts1 = {k: read_table(spark, v).count() for k, v in first["analytics"].items()}
    main(["--mode", "synthetic", "--sf-dir", SF0001, "--out", out], spark=spark)
    counts2 = {k: read_table(spark, v).count() for k, v in first["analytics"].items()}
    assert counts1 == counts2 and counts1["user_summary"] > 0
    exported = spark.read.option("header", True).csv(first["export"]["usage_logs"])
    assert exported.where(F.col("prompt_text").rlike(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}")).count() == 0
    prs = spark.read.option("header", True).csv(first["export"]["pull_requests"])
    assert "user_id" not in prs.columns
    scanned = read_table(spark, first["scan"])
    assert scanned.where("risk_score > 0").count() > 0


def test_pr_sync_job(spark, scratch):
    import json
    from conftest import SF0001
    raw = f"{scratch}/raw_prs.jsonl"
    with open(raw, "w") as fh:
        for n, (repo, merged) in enumerate([("Brand#11", "2023-01-02T00:00:00Z"), ("Brand#11", None),
                                            ("Brand#12", "2021-05-01T00:00:00Z")]):
            fh.write(json.dumps(dict(number=n, title="t", state="closed", created_at="2021-01-01T00:00:00Z",
                                     updated_at="2023-01-03T00:00:00Z", merged_at=merged, additions=4,
                                     deletions=1, review_comments=1, commits=1, user={"login": "dev5"},
                                     base={"repo": {"name": repo, "full_name": "org/" + repo}})) + "\n")
    with open(raw, "a") as fh:  # two lines that are no record, and a blank one
        fh.write('{"number": 9, "title": "cut of\n\n[1, 2]\n')
    out = f"{scratch}/out"
    done = main(["--mode", "github-only", "--sf-dir", SF0001, "--out", out, "--raw-prs", raw,
                 "--since", "2020-02-17T00:00:00"], spark=spark)
    prs = read_table(spark, done["sync"])
    got = {r["pr_id"]: r for r in prs.collect()}
    assert set(got) == {"Brand#11#0", "Brand#12#2"}
    assert got["Brand#11#0"]["period"] == "After" and got["Brand#12#2"]["period"] == "Before"
    assert got["Brand#11#0"]["department"] is not None
    assert spark.read.option("header", True).csv(f"{out}/reports/sync_summary").count() >= 1
    counts = spark.read.option("header", True).csv(f"{out}/reports/ingest_counts").first()
    assert (counts["stored"], counts["rejected"]) == ("2", "2")
    assert {r["line"] for r in read_table(spark, f"{out}/quarantine/pull_requests").collect()} == {
        '{"number": 9, "title": "cut of', "[1, 2]"}
    # a later window of one repository keeps its older rows, an emptied repository is cleared, others stay
    again = ["--mode", "github-only", "--sf-dir", SF0001, "--out", out, "--raw-prs", raw]
    main([*again, "--since", "2022-01-01T00:00:00", "--repo", "Brand#11"], spark=spark)
    assert read_table(spark, done["sync"]).count() == 2
    empty = f"{scratch}/empty.jsonl"
    open(empty, "w").write("\n")
    main([*again[:-1], empty, "--repo", "Brand#11"], spark=spark)
    assert [r["pr_id"] for r in read_table(spark, done["sync"]).collect()] == ["Brand#12#2"]


def test_dashboard_load_matches_registered_queries(spark):
    from conftest import SF0001
    from roilens.plans.catalog import QUERIES
    from roilens.plans.dashboard import DashboardLoad

    load = DashboardLoad(spark, SF0001)
    out = load.outputs()
    assert sorted(r for r in out["classified"].collect()) == sorted(r for r in QUERIES["classify_users"](spark, SF0001).collect())
    assert sorted(out["pr_delta"].collect()) == sorted(QUERIES["pr_delta"](spark, SF0001).collect())
    for name, df in out.items():
        df.write.format("noop").mode("overwrite").save()
