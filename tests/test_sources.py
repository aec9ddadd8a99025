"""Sources and sinks: coercion, schema alignment, CSV round trip, partition
replace, cache read, constraint audit."""

import datetime as dt

from pyspark.sql import functions as F
from pyspark.sql import types as T

from roilens import schemas
from roilens.operators.quality import constraint_audit
from roilens.sources.sinks import read_csv, replace_repo, write_csv
from roilens.sources.versions import read_table
from roilens.sources.tables import align_pull_requests, coerce_types, read_cache, scan_department


def test_coerce_types(spark):
    df = spark.createDataFrame([("1.5", "2024-01-01 10:00:00", "x"), ("bad", "nope", "7")],
                               "a string, b string, c string")
    schema = T.StructType([T.StructField("a", T.DoubleType()), T.StructField("b", T.TimestampNTZType()),
                           T.StructField("c", T.LongType())])
    rows = coerce_types(df, schema).collect()
    assert rows[0]["a"] == 1.5 and rows[0]["b"] == dt.datetime(2024, 1, 1, 10) and rows[0]["c"] == 0
    assert rows[1]["a"] == 0.0 and rows[1]["b"] is None and rows[1]["c"] == 7


def test_coerce_utc(spark):
    df = spark.createDataFrame([("2024-01-01T10:00:00+02:00",)], "merged_at string")
    schema = T.StructType([T.StructField("merged_at", T.TimestampNTZType())])
    assert coerce_types(df, schema, utc_columns=("merged_at",)).first()[0] == dt.datetime(2024, 1, 1, 8)


def test_align_pull_requests(spark):
    df = spark.createDataFrame([("p1", "repo", None)], "pr_id string, repo_name string, period string")
    out = align_pull_requests(df)
    assert out.columns[:len(schemas.PULL_REQUESTS.fieldNames())] == schemas.PULL_REQUESTS.fieldNames()
    r = out.first()
    assert r["repo_full_name"] == "repo" and r["period"] == "Unknown" and r["lines_added"] is None


def test_scan_department_pushdown(spark, scratch):
    spark.createDataFrame([("a", "X"), ("b", "Y")], "id string, department string").write.parquet(scratch + "/t")
    df = spark.read.parquet(scratch + "/t")
    assert scan_department(df, "All").count() == 2 and scan_department(df, None).count() == 2
    q = scan_department(df, "X")
    assert q.count() == 1
    plan = q._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(department), EqualTo(department,X)]" in plan


def test_csv_round_trip(spark, scratch):
    t = spark.createDataFrame([("J1", "U1", "D", dt.datetime(2024, 1, 1), None, 1.25, 3, "High", "After", 0.0, 1)],
                              schemas.TICKETS)
    write_csv(t, scratch + "/csv")
    back = read_csv(spark, scratch + "/csv", "tickets")
    assert back.collect() == t.collect()


def test_csv_of_texts_is_read_back_from_zstd(spark, scratch):
    import random

    chars = random.Random(3)
    texts = [(1, 'a "b", c\nd\r\ne'), (2, " led and trailed "), (3, "back\\slash\\"), (4, None), (5, "\u00e9\u4e2d\U0001f600"),
             (6, "".join(chars.choices("abc \n\",", k=3_000_000)))]  # longer than the window in which zstd finds repeats
    df = spark.createDataFrame(texts, "id int, text string")
    write_csv(df, scratch + "/t", "zstd")
    back = read_csv(spark, scratch + "/t", df.schema)
    assert all(f.endswith(".csv.zstd") for f in back.inputFiles())
    assert sorted((r.id, r.text) for r in back.collect()) == texts


def test_csv_round_trip_text_takes_less_disk_than_its_texts(spark):
    import os
    from urllib.parse import urlparse

    from conftest import SF001
    from roilens.plans.catalog import QUERIES

    back = QUERIES["csv_round_trip_text"](spark, SF001)
    rows, text = back.agg(F.count(F.lit(1)), F.sum(F.octet_length("prompt_text"))).first()
    stored = sum(os.path.getsize(urlparse(f).path) for f in back.inputFiles())
    assert rows == 9994 and stored < text / 2  # each text is there with each of its rows


def test_replace_repo_idempotent(spark, scratch):
    prs = spark.createDataFrame([("a#1", "a", "merged"), ("a#2", "a", "closed"), ("b#1", "b", "merged")],
                                "pr_id string, repo_name string, pr_state string")
    path = scratch + "/prs"
    replace_repo(spark, prs, path)
    replace_repo(spark, prs.where("pr_state = 'merged'"), path, "a")
    replace_repo(spark, prs.where("pr_state = 'merged'"), path, "a")
    got = sorted(r["pr_id"] for r in read_table(spark, path).collect())
    assert got == ["a#1", "b#1"]
    replace_repo(spark, prs.limit(0), path, "a")
    assert [r["pr_id"] for r in read_table(spark, path).collect()] == ["b#1"]


def test_read_cache_missing_is_empty(spark, scratch):
    df = read_cache(spark, scratch + "/never_written")
    assert df.count() == 0 and df.schema == schemas.ANALYTICS_CACHE


def test_constraint_audit(spark):
    users = spark.createDataFrame([("U1", "A", "D", "g1"), ("U1", "B", "D", "g1"), ("U2", None, None, None)],
                                  "user_id string, employee_name string, department string, github_username string")
    logs = spark.createDataFrame([("L1", "U1", dt.datetime(2024, 1, 1)), ("L2", "U9", None)],
                                 "prompt_id string, user_id string, timestamp timestamp_ntz")
    tickets = spark.createDataFrame([("J1", "U1", "Before"), ("J1", "U2", "Later")],
                                    "jira_issue_id string, user_id string, period string")
    prs = spark.createDataFrame([("P1", None, "Unknown"), ("P2", "U7", None)],
                                "pr_id string, user_id string, period string")
    got = {(r["table_name"], r["rule"]): r["violations"]
           for r in constraint_audit(users, logs, tickets, prs).collect()}
    assert got[("users_master", "pk_user_id")] == 2
    assert got[("users_master", "unique_github_username")] == 2
    assert got[("users_master", "not_null_employee_name")] == 1
    assert got[("ai_usage_logs", "fk_user_id")] == 1 and got[("ai_usage_logs", "not_null_timestamp")] == 1
    assert got[("tickets", "pk_jira_issue_id")] == 2 and got[("tickets", "check_period")] == 1
    assert got[("pull_requests", "check_period")] == 1 and got[("pull_requests", "fk_user_id")] == 1
    assert got[("pull_requests", "pk_pr_id")] == 0


def test_time_functions_ignore_session_zone(spark):
    from roilens.functions.timecols import elapsed_micros, parse_utc_ntz

    prev = spark.conf.get("spark.sql.session.timeZone")
    try:
        for tz in ("America/New_York", "Asia/Kolkata", "UTC"):
            spark.conf.set("spark.sql.session.timeZone", tz)
            df = spark.createDataFrame([("2024-03-10T02:30:00Z", "1995-04-02 02:04:48", "1995-04-02 03:10:00.5")],
                                       "a string, b string, c string")
            r = df.select(parse_utc_ntz("a").alias("a"), parse_utc_ntz("b").alias("b"),
                          elapsed_micros(F.col("b").try_cast("timestamp_ntz"),
                                         F.col("c").try_cast("timestamp_ntz")).alias("e")).first()
            assert r["a"] == dt.datetime(2024, 3, 10, 2, 30)  # a wall time that does not exist in New York
            assert r["b"] == dt.datetime(1995, 4, 2, 2, 4, 48)
            assert r["e"] == 3912500000  # 1h05m12.5s, no DST shift
    finally:
        spark.conf.set("spark.sql.session.timeZone", prev)
