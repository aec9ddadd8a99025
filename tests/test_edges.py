"""Edge sets: empty inputs, null keys, zero denominators."""

import pytest
from pyspark.sql import functions as F

from conftest import SF0001
from roilens.operators import governance, licences, pulls, roi, stats, tickets, usage
from roilens.plans.inputs import Inputs


@pytest.fixture(scope="module")
def empty(spark):
    i = Inputs(spark, SF0001)
    return {
        "users": i.users().where("false"),
        "logs": i.logs().where("false"),
        "tickets": i.tickets().where("false"),
        "prs": i.pull_requests().where("false"),
        "prs_e": i.pull_requests_enriched().where("false"),
    }


def test_empty_inputs_give_empty_or_zero_results(spark, empty):
    u, lg, t, p, pe = (empty[k] for k in ("users", "logs", "tickets", "prs", "prs_e"))
    assert roi.user_roi(u, lg, t).count() == 0
    assert roi.dept_roi(u, lg, t).count() == 0
    summary = roi.user_summary(u, lg, t, p)
    assert summary.count() == 0
    classified = licences.classify_users(summary)
    assert classified.count() == 0
    opt = licences.optimisation_summary(classified).first()
    assert opt["total_users"] == 0 and opt["total_monthly_saving"] == 0.0
    assert [r["count"] for r in licences.category_distribution(classified).collect()] == [0] * 5
    for df in (tickets.dept_performance(t), tickets.velocity(t), tickets.throughput_delta(tickets.velocity(t)),
               pulls.pr_performance(pe), pulls.pr_delta(pulls.pr_performance(pe)), usage.monthly_trend(lg),
               usage.token_histogram(lg), governance.risk_rollup(lg)):
        assert df.count() == 0
    assert governance.corporate_risk(lg).first()[0] == 0.0
    k = roi.executive_kpis(lg, t, u).first()
    assert k["total_spend"] == 0.0 and k["pct_improvement"] == 0.0 and k["high_risk_events"] == 0
    assert [r["events"] for r in usage.weekday_volume(lg).collect()] == [0] * 7
    sp = stats.spend_vs_productivity(summary, with_p=True).collect()
    assert sp == []  # no pairs, no relationship rows


def test_null_keys_kept_by_sql_dropped_by_analysis(spark):
    prs = spark.createDataFrame(
        [("1", None, "After", "merged", 2.0, 0.1, 1, 1, 3, 1, "u", "r"),
         ("2", "A", "After", "merged", 4.0, 0.3, 1, 1, 3, 1, "v", "r")],
        "pr_id string, department string, period string, pr_state string, cycle_time_hours double, "
        "rework_ratio double, review_count long, commit_count long, lines_added long, lines_removed long, "
        "github_username string, repo_name string")
    sql_style = {r["department"] for r in pulls.pr_efficiency(prs).collect()}
    analysis_style = {r["department"] for r in pulls.pr_performance(prs).collect()}
    assert sql_style == {None, "A"} and analysis_style == {"A"}


def test_zero_denominators(spark):
    t = spark.createDataFrame([("1", "A", "Before", 0.0, 1), ("2", "A", "After", 0.0, 1)],
                              "jira_issue_id string, department string, period string, cycle_time_hours double, "
                              "story_points int")
    r = tickets.dept_performance(t).first()
    assert r["pct_improvement"] == 0.0
    d = tickets.throughput_delta(tickets.velocity(t)).first()
    assert d["cycle_improvement_pct"] == 0.0 and d["throughput_lift_pct"] == 0.0


def test_ties_in_top_k_are_deterministic(spark):
    rows = [(f"u{i}", "D", "R", "C", 10.0, 1, 1.0, 1.0, 1.0) for i in range(15)]
    df = spark.createDataFrame(rows, "user_id string, employee_name string, department string, role string, "
                                     "pct_improvement double, tickets_closed long, hours_saved_per_ticket double, "
                                     "net_roi double, total_cost double")
    a = [r["user_id"] for r in licences.top_performers(df.repartition(5)).collect()]
    b = [r["user_id"] for r in licences.top_performers(df.repartition(3)).collect()]
    assert a == b == sorted(a)


def test_every_customer_is_a_user(spark):
    from conftest import SF0001
    from roilens.plans.inputs import Inputs

    users = Inputs(spark, SF0001).users()
    assert users.count() == spark.read.parquet(f"{SF0001}/customer.parquet").count()


def test_no_after_rows_give_no_improvement(spark):
    from roilens.operators.pulls import pr_kpis

    prs = spark.createDataFrame([("merged", "Before", 10.0, 0.5, "a", "r")],
                                "pr_state string, period string, cycle_time_hours double, rework_ratio double, github_username string, repo_name string")
    row = pr_kpis(prs).first()
    assert row.prs_merged == 1 and row.cycle_improvement_pct is None and row.rework_improvement_pct is None


def test_csv_keeps_quotes_commas_and_line_breaks(spark, scratch):
    from roilens.sources.sinks import read_csv, write_csv

    texts = [(1, 'a "b", c\nd\r\ne'), (2, " led and trailed "), (3, "back\\slash\\"), (4, None)]
    df = spark.createDataFrame(texts, "id int, text string")
    write_csv(df, f"{scratch}/t")
    assert sorted((r.id, r.text) for r in read_csv(spark, f"{scratch}/t", df.schema).collect()) == texts
