"""Ticket and pull-request column rules, deltas with a missing period, and the
landed-JSON ingest fixtures."""

import datetime as dt
import json

from pyspark.sql import functions as F

from roilens.functions.pulls import period_backfill, rework_ratio, ticket_cycle_backfill
from roilens.operators.pulls import department_fill, pr_delta, pr_delta_sql, pr_performance
from roilens.operators.tickets import dept_performance, throughput_delta, velocity
from roilens.sources.ingest import ingest_pull_requests, ingest_tickets, read_raw_pull_requests, \
    read_raw_ticket_pages

CUT = dt.datetime(2022, 6, 21)


def test_period_backfill(spark):
    df = spark.createDataFrame([
        ("Before", dt.datetime(2023, 1, 1)), (None, dt.datetime(2023, 1, 1)), ("Unknown", dt.datetime(2021, 1, 1)),
        ("Unknown", None), (None, dt.datetime(2022, 6, 21)),
    ], "period string, merged_at timestamp_ntz")
    out = [r[0] for r in df.select(period_backfill("period", "merged_at", CUT)).collect()]
    assert out == ["Before", "After", "Before", "Unknown", "After"]


def test_department_fill(spark):
    prs = spark.createDataFrame([("a", "r1", None), ("b", "r1", ""), ("c", "r2", "Kept"), ("d", "zz", None)],
                                "pr_id string, repo_name string, department string")
    lk = spark.createDataFrame([("r1", "Eng"), ("r2", "Ops")], "repo_name string, department string")
    got = {r["pr_id"]: r["department"] for r in department_fill(prs, lk).collect()}
    assert got == {"a": "Eng", "b": "Eng", "c": "Kept", "d": None}


def test_rework_ratio(spark):
    df = spark.createDataFrame([(10, 5), (0, 5), (None, 3), (3, None)], "a long, r long")
    assert [x[0] for x in df.select(rework_ratio("a", "r")).collect()] == [0.5, 5.0, 3.0, 0.0]


def test_ticket_cycle_backfill(spark):
    t0 = dt.datetime(2024, 1, 1)
    df = spark.createDataFrame([(0.0, t0, t0 + dt.timedelta(hours=5)), (0.0, t0, None),
                                (0.0, t0, t0 - dt.timedelta(hours=2)), (7.5, t0, None)],
                               "c double, a timestamp_ntz, b timestamp_ntz")
    assert [x[0] for x in df.select(ticket_cycle_backfill("c", "a", "b")).collect()] == [5.0, 0.0, 0.0, 7.5]


def _tickets(spark, rows):
    return spark.createDataFrame(rows, "jira_issue_id string, department string, period string, "
                                       "cycle_time_hours double, story_points int")


def test_dept_performance_missing_side(spark):
    t = _tickets(spark, [("1", "A", "Before", 10.0, 1), ("2", "A", "After", 6.0, 2), ("3", "B", "After", 4.0, 3)])
    got = {r["department"]: r.asDict() for r in dept_performance(t).collect()}
    assert got["A"]["hours_saved_mean"] == 4.0 and got["A"]["pct_improvement"] == 40.0
    assert got["B"]["before_mean"] is None and got["B"]["before_count"] is None
    assert got["B"]["hours_saved_mean"] is None and got["B"]["pct_improvement"] == 0.0


def test_throughput_delta_missing_side(spark):
    t = _tickets(spark, [("1", "A", "Before", 10.0, 2), ("2", "A", "After", 5.0, 4), ("3", "B", "After", 4.0, 3)])
    got = {r["department"]: r.asDict() for r in throughput_delta(velocity(t)).collect()}
    assert got["A"]["cycle_improvement_pct"] == 50.0 and got["A"]["throughput_lift_pct"] == 100.0
    assert got["B"]["before_cycle"] == 0.0 and got["B"]["cycle_improvement_pct"] == 0.0


def _prs(spark, rows):
    return spark.createDataFrame(rows, "pr_id string, department string, period string, pr_state string, "
                                       "cycle_time_hours double, rework_ratio double, review_count long, "
                                       "commit_count long, lines_added long, lines_removed long, "
                                       "github_username string")


def test_pr_delta_outer_and_sql_inner(spark):
    p = _prs(spark, [("1", "A", "Before", "merged", 10.0, 0.2, 1, 1, 5, 1, "u"),
                     ("2", "A", "After", "merged", 8.0, 0.1, 1, 1, 5, 1, "v"),
                     ("3", "B", "After", "merged", 3.0, 0.5, 1, 1, 5, 1, "w")])
    outer = {r["department"]: r.asDict() for r in pr_delta(pr_performance(p)).collect()}
    assert set(outer) == {"A", "B"} and outer["B"]["before_avg"] == 0.0 and outer["B"]["hours_saved"] == 0.0
    assert outer["A"]["pct_improvement"] == 20.0 and outer["A"]["rework_improvement_pct"] == 50.0
    inner = pr_delta_sql(p).collect()
    assert [r["department"] for r in inner] == ["A"] and inner[0]["hours_saved"] == 2.0


def _write_lines(path, rows):
    with open(path, "w") as fh:
        for r in rows:
            fh.write(json.dumps(r) + "\n")


def test_ingest_pull_requests(spark, scratch):
    base = {"base": {"repo": {"name": "django", "full_name": "django/django"}}}
    rows = [
        dict(number=1, title="ok", state="closed", created_at="2023-01-01T00:00:00Z", updated_at="2023-01-03T00:00:00Z",
             merged_at="2023-01-02T12:00:00Z", additions=10, deletions=4, review_comments=2, commits=3,
             user={"login": "dev1"}, **base),
        dict(number=2, title="closed not merged", state="closed", created_at="2023-01-01T00:00:00Z",
             updated_at="2023-01-04T00:00:00Z", merged_at=None, additions=1, deletions=1, review_comments=0,
             commits=1, user={"login": "dev1"}, **base),
        dict(number=3, title="x" * 250, state="closed", created_at="2022-01-01T00:00:00Z",
             updated_at="2023-01-05T00:00:00Z", merged_at="2022-01-01T06:00:00Z", additions=None, deletions=None,
             review_comments=None, commits=None, user=None, **base),
        dict(number=4, title="too old", state="closed", created_at="2015-01-01T00:00:00Z",
             updated_at="2015-01-02T00:00:00Z", merged_at="2015-01-02T00:00:00Z", additions=1, deletions=0,
             review_comments=0, commits=1, user={"login": "dev2"}, **base),
    ]
    path = f"{scratch}/prs.jsonl"
    _write_lines(path, rows)
    users = spark.createDataFrame([("U1", "dev1")], "user_id string, github_username string")
    lk = spark.createDataFrame([("django", "Backend")], "repo_name string, department string")
    out = ingest_pull_requests(read_raw_pull_requests(spark, path), users, lk, since=dt.datetime(2023, 6, 1) - dt.timedelta(days=1200),
                               cutoff=CUT)
    got = {r["pr_id"]: r.asDict() for r in out.collect()}
    assert set(got) == {"django#1", "django#3"}
    a, c = got["django#1"], got["django#3"]
    assert a["cycle_time_hours"] == 36.0 and a["rework_ratio"] == 0.4 and a["period"] == "After"
    assert a["user_id"] == "U1" and a["department"] == "Backend"
    assert c["github_username"] == "unknown" and len(c["pr_title"]) == 250 and c["lines_added"] == 0
    assert c["rework_ratio"] == 0.0 and c["period"] == "Before" and c["user_id"] is None
    capped = ingest_pull_requests(read_raw_pull_requests(spark, path), None, None, since=dt.datetime(2023, 6, 1) - dt.timedelta(days=1200),
                                  max_per_repo=1, cutoff=CUT)
    assert [r["pr_id"] for r in capped.collect()] == ["django#3"]  # most recently updated kept


def test_ingest_tickets(spark, scratch):
    page = {"total": 4, "startAt": 0, "issues": [
        {"key": "ENG-1", "fields": {"created": "2024-01-01T10:00:00.000+0000",
                                    "resolutiondate": "2024-01-02T12:30:00.000+0000",
                                    "priority": {"name": "High"}, "story_points": 5.0, "status": {"name": "Done"}}},
        {"key": "ENG-2", "fields": {"created": "2024-01-05T10:00:00.000+0000",
                                    "resolutiondate": "2024-01-04T10:00:00.000+0000",
                                    "priority": None, "story_points": None, "status": {"name": "Done"}}},
        {"key": "ENG-3", "fields": {"created": "2024-01-05T10:00:00.000+0000", "resolutiondate": None,
                                    "priority": None, "story_points": None, "status": {"name": "In Progress"}}},
        {"key": "ENG-4", "fields": {"created": "2020-01-05T10:00:00.000+0000",
                                    "resolutiondate": "2020-01-06T10:00:00.000+0000",
                                    "priority": None, "story_points": 2.0, "status": {"name": "Done"}}},
    ]}
    path = f"{scratch}/tickets.jsonl"
    _write_lines(path, [page])
    out = ingest_tickets(read_raw_ticket_pages(spark, path), since=dt.datetime(2024, 3, 1) - dt.timedelta(days=180))
    got = {r["jira_issue_id"]: r.asDict() for r in out.collect()}
    assert set(got) == {"ENG-1", "ENG-2"}
    assert got["ENG-1"]["cycle_time_hours"] == 26.5 and got["ENG-1"]["story_points"] == 5
    assert got["ENG-1"]["created_at"] == dt.datetime(2024, 1, 1, 10, 0)
    assert got["ENG-2"]["cycle_time_hours"] == 0.0 and got["ENG-2"]["priority"] == "Medium"
    assert got["ENG-2"]["story_points"] == 1 and got["ENG-2"]["period"] == "After"
