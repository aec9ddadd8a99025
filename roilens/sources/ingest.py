"""Landed-file ingest of pull requests (S7) and tickets.

The live REST clients of the original are network tools; here the pages are
assumed landed as JSON lines and are read with a declared nested schema (no
inference), filtered, and shaped into the business tables in one plan. Lines
that do not parse go to a quarantine table.
"""

from __future__ import annotations

import datetime as _dt

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import params as P
from .. import schemas
from ..functions.numeric import round_dec
from ..functions.pulls import hours_between, ntz_literal, period_label, rework_ratio, ticket_cycle_hours
from ..functions.timecols import parse_utc_ntz
from .versions import VersionedTable


def utc_ntz(text_col) -> "F.Column":
    """ISO-8601 text with a zone (``Z``, ``+00:00``) -> zone-free UTC timestamp;
    text without a zone is taken as UTC wall time."""
    return parse_utc_ntz(text_col)


CORRUPT = "_corrupt_record"


def read_landed(spark: SparkSession, path: str, schema: T.StructType) -> tuple[DataFrame, DataFrame]:
    """(records, rejects) of landed JSON lines. A line that is no JSON object, or in which a declared field has another
    type, is a reject -- with its file and text -- and no record; blank lines are neither."""
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file")).where(F.trim("value") != "")
    held = T.StructType([*schema.fields, T.StructField(CORRUPT, T.StringType())])
    parsed = lines.withColumn("r", F.from_json("value", held, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": CORRUPT}))
    bad = F.col("r").isNull() | F.col(f"r.{CORRUPT}").isNotNull() | ~F.ltrim("value").startswith("{")
    return parsed.where(~bad).select("r.*").drop(CORRUPT), parsed.where(bad).select("file", F.col("value").alias("line"))


def quarantine(spark: SparkSession, rejects: DataFrame, path: str) -> int:
    """Publishes the rejected lines (a rerun replaces them) and returns how many there are."""
    table = VersionedTable(spark, path)
    table.replace(rejects)
    return table.read().count()


def read_raw_pull_requests(spark: SparkSession, path: str) -> DataFrame:
    return read_landed(spark, path, schemas.RAW_PR)[0]


def ingest_pull_requests(raw: DataFrame, users: DataFrame | None, repo_department: DataFrame | None,
                         since: _dt.datetime | None = None, max_per_repo: int | None = None,
                         cutoff: _dt.datetime = P.ADOPTION_CUTOFF) -> DataFrame:
    """Merged PRs shaped into the PR table, one row per PR (of a PR that was
    landed more than once the latest update). ``since`` (creation time) and
    ``max_per_repo`` (most recently updated first) are the caller's choice; by
    default nothing is left out.

    The per-repository cap is ``row_number() <= n``; Spark plans it with a
    map-side WindowGroupLimit, so even a repository holding a third of all
    PRs ships at most n rows per input partition to the shuffle.
    """
    r = raw.select(
        F.col("number"), F.col("title"),
        utc_ntz("created_at").alias("created_at"),
        utc_ntz("updated_at").alias("updated_at"),
        utc_ntz("merged_at").alias("merged_at"),
        F.col("additions"), F.col("deletions"), F.col("review_comments"), F.col("commits"),
        F.col("user.login").alias("login"),
        F.col("base.repo.name").alias("repo_name"), F.col("base.repo.full_name").alias("repo_full_name"))
    r = r.where(F.col("merged_at").isNotNull())
    if since is not None:
        r = r.where(F.col("created_at") >= ntz_literal(since))
    landed = Window.partitionBy("repo_full_name", "number").orderBy(F.col("updated_at").desc_nulls_last())
    r = r.withColumn("_rn", F.row_number().over(landed)).where(F.col("_rn") == 1).drop("_rn")
    if max_per_repo is not None:
        w = Window.partitionBy("repo_full_name").orderBy(F.col("updated_at").desc_nulls_last(),
                                                        F.col("number").desc())
        r = r.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= max_per_repo).drop("_rn")
    out = r.select(
        F.concat(F.col("repo_name"), F.lit("#"), F.col("number").cast("string")).alias("pr_id"),
        F.col("login").alias("github_username"),
        "repo_name", "repo_full_name",
        F.coalesce(F.col("title"), F.lit("")).alias("pr_title"),
        F.lit("merged").alias("pr_state"), "created_at", "merged_at",
        round_dec(hours_between("created_at", "merged_at"), 2).alias("cycle_time_hours"),
        F.coalesce(F.col("additions"), F.lit(0)).alias("lines_added"),
        F.coalesce(F.col("deletions"), F.lit(0)).alias("lines_removed"),
        F.coalesce(F.col("review_comments"), F.lit(0)).alias("review_count"),
        F.coalesce(F.col("commits"), F.lit(0)).alias("commit_count"),
        rework_ratio("additions", "deletions").alias("rework_ratio"),
        period_label("merged_at", cutoff).alias("period"))
    if repo_department is not None:
        lk = repo_department.groupBy(F.col("repo_name").alias("_r")).agg(F.min("department").alias("department"))
        out = out.join(lk, out["repo_name"] == F.col("_r"), "left").drop("_r")
    else:
        out = out.withColumn("department", F.lit(None).cast("string"))
    if users is not None:
        from ..operators.pulls import map_contributors
        out = map_contributors(out, users)
    else:
        out = out.withColumn("user_id", F.lit(None).cast("string"))
    # a missing login is labelled after the mapping: it is nobody's, and no join key
    return out.withColumn("github_username", F.coalesce("github_username", F.lit("unknown")))


def read_raw_ticket_pages(spark: SparkSession, path: str) -> DataFrame:
    return read_landed(spark, path, schemas.RAW_TICKET_PAGE)[0]


TICKET_TS = "yyyy-MM-dd'T'HH:mm:ss.SSSXX"


def ingest_tickets(pages: DataFrame, since: _dt.datetime | None = None) -> DataFrame:
    """Issues of landed search pages -> ticket rows.

    Done issues with a resolution date (from ``since`` on, if given); ``+0000`` offsets are parsed (the
    intent of the original parser), cycle hours are 0 unless resolved >
    created, missing points default to 1 and missing priority to Medium.
    """
    iss = pages.select(F.explode("issues").alias("i")).select("i.*")

    def parse(c):
        return F.coalesce(parse_utc_ntz(c, TICKET_TS), parse_utc_ntz(c))

    t = iss.select(F.col("key").alias("jira_issue_id"),
                   parse(F.col("fields.created")).alias("created_at"),
                   parse(F.col("fields.resolutiondate")).alias("resolved_at"),
                   F.col("fields.story_points").alias("sp"),
                   F.col("fields.priority.name").alias("pr"),
                   F.col("fields.status.name").alias("status"))
    t = t.where((F.col("status") == "Done") & F.col("resolved_at").isNotNull())
    if since is not None:
        t = t.where(F.col("resolved_at") >= ntz_literal(since))
    cycle = ticket_cycle_hours("created_at", "resolved_at")
    sp = F.col("sp")
    return t.select(
        F.coalesce(F.col("jira_issue_id"), F.lit("")).alias("jira_issue_id"),
        F.lit(None).cast("string").alias("user_id"), F.lit(None).cast("string").alias("department"),
        "created_at", "resolved_at", cycle.alias("cycle_time_hours"),
        F.when(sp.isNull() | (sp == 0), F.lit(1)).otherwise(sp).cast("int").alias("story_points"),
        F.coalesce(F.col("pr"), F.lit("Medium")).alias("priority"),
        F.lit("After").alias("period"), F.lit(0.0).alias("avg_ticket_resolution_hours"),
        F.lit(1).alias("jira_tickets_closed"))
