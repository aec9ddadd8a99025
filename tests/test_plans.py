"""Physical-plan properties: no Python in the governance scan, pushed filters,
one scan for the Before/After comparison, TakeOrderedAndProject for top-k,
no unpartitioned window over raw rows."""

import re

import pytest

from conftest import SF001
from roilens.plans.catalog import QUERIES


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", ["pii_detect", "keyword_scan", "prompt_risk", "scan_logs", "redact_text",
                                  "pseudonymise", "redact_frame"])
def test_governance_has_no_python(spark, name):
    plan = _plan(QUERIES[name](spark, SF001))
    assert "BatchEvalPython" not in plan and "ArrowEvalPython" not in plan and "PythonUDF" not in plan


@pytest.mark.parametrize("name", ["apply_risk_update", "csv_round_trip_text", "keyword_scan", "pii_detect", "prompt_risk",
                                  "redact_text", "scan_logs"])
def test_text_queries_run_with_shuffled_documents(spark, name):
    # where a join's exchange has a subquery in its key and the join itself is broadcast at run time, Spark fails
    # ("Subquery ... has not finished"): customers are broadcast, documents shuffled first
    kept = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "256k")
    try:
        assert len(QUERIES[name](spark, SF001).collect()) == 9994
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", kept)


def test_department_scan_pushdown(spark):
    plan = _plan(QUERIES["filter_departments"](spark, SF001))
    assert "PushedFilters" in plan and ("In(c_mktsegment" in plan or "BUILDING" in plan)


def test_before_after_one_scan(spark):
    plan = QUERIES["pr_delta_sql"](spark, SF001)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Relation [l_orderkey") == 1  # lineitem read once, no self-join


@pytest.mark.parametrize("name", ["top_contributors_sql", "worst_prompts", "top_contributors", "top_performers",
                                  "incident_log", "review_sample"])
def test_topk_is_take_ordered(spark, name):
    assert "TakeOrderedAndProject" in _plan(QUERIES[name](spark, SF001))


def test_no_global_window_over_raw_rows(spark):
    # the only unpartitioned windows are over monthly aggregates or bucket totals
    for name in ("monthly_trend", "spend_vs_productivity", "ingest_pull_requests"):
        df = QUERIES[name](spark, SF001)
        opt = df._jdf.queryExecution().optimizedPlan().toString()
        for line in opt.splitlines():
            if "Window [" in line and "windowspecdefinition(" in line:
                first = line.split("windowspecdefinition(")[1].split(",")[0]  # a partition key, or else an order
                if " ASC" in first or " DESC" in first:
                    assert "_b#" in first or "_range#" in first or "month_year#" in first, line


def test_window_group_limit_for_per_repo_cap(spark):
    plan = _plan(QUERIES["ingest_pull_requests"](spark, SF001))
    assert "WindowGroupLimit" in plan


def test_no_cross_joins_or_unexpected_python(spark):
    from conftest import SF0001
    import __spark_entry__ as E

    for name, q in E.queries().items():
        if name == "pipeline" or re.match(r"op\d+_", name):  # the training-data operators have tests of their own
            continue
        plan = _plan(q(spark, SF0001))
        assert "CartesianProduct" not in plan, name
        assert "BroadcastNestedLoopJoin" not in plan, name
        assert "ArrowEvalPython" not in plan and "BatchEvalPython" not in plan, name


GROUPED_QUANTILES = ("dept_performance", "ticket_velocity", "pr_performance", "repo_stats", "dept_risk", "token_median",
                     "user_summary", "classify_users")


@pytest.mark.parametrize("name", GROUPED_QUANTILES)
def test_quantiles_gather_no_group(spark, name):
    plan = _plan(QUERIES[name](spark, SF001)).lower()
    assert "percentile(" not in plan and "median(" not in plan


def test_ranks_join_nothing_by_value(spark):
    from roilens.operators.stats import spearman
    df = spark.range(300).selectExpr("cast(id % 7 as double) as x", "cast(id % 11 as double) as y")
    assert "Join" not in _plan(spearman(df, "x", "y"))


@pytest.mark.parametrize("name", ["classify_users", "spearman", "spend_vs_productivity", "user_summary", "analytics_cache"])
def test_building_a_query_runs_nothing(spark, name):
    spark.sparkContext.setJobGroup(f"build {name}", "build")
    try:
        QUERIES[name](spark, SF001)
        jobs = spark.sparkContext.statusTracker().getJobIdsForGroup(f"build {name}")
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert len(jobs) <= 9  # one to read the schema of each driver table, at each load


def test_read_cache_derives_the_logs_once(spark, monkeypatch):
    # events are read for the rows and for the distinct texts, not again for each use of the logs
    from roilens.sources import sinks
    plans, write = [], sinks.write_table
    monkeypatch.setattr(sinks, "write_table", lambda df, *a, **k: (
        plans.append(df._jdf.queryExecution().optimizedPlan().toString()), write(df, *a, **k)) and None)
    assert QUERIES["read_cache"](spark, SF001).count() == 7705
    assert sum(p.count("Relation [event_id") for p in plans) <= 3


def test_no_driver_fetch_in_operators():
    from pathlib import Path
    import roilens.operators
    for f in Path(roilens.operators.__file__).parent.glob("*.py"):
        assert not re.search(r"\.(first|collect|toPandas|head|take)\(\)", f.read_text()), f
