"""Canonical input tables derived from the driver's parquet tables.

The engine works on four business tables (users, AI usage logs, tickets, pull
requests) plus two lookups. The test/bench data ships TPC-H-like tables
instead, so a fixed mapping derives the business tables from them. The mapping
is one SQL text with three dialect holes so that the Spark side and the DuckDB
oracle read *the same* rows; everything downstream is computed independently.

In Spark the SQL runs through ``spark.sql(text, **frames)``: the driver tables
are passed as DataFrames, so Catalyst sees one plan from the parquet scans on
(pushdown and pruning reach the files).
"""

from __future__ import annotations

from dataclasses import dataclass
from typing import Callable

from pyspark.sql import DataFrame, SparkSession

DRIVER_TABLES = ("events", "customer", "documents", "orders", "lineitem", "part")


@dataclass(frozen=True)
class Dialect:
    json_k: Callable[[str], str]
    months: Callable[[str, str], str]
    secs: Callable[[str], str]
    #: join key: (column that the derived table adds, key that the join names)
    key: Callable[[str], tuple[str, str]]


SPARK = Dialect(
    json_k=lambda c: f"get_json_object({c},'$.k')",
    months=lambda t, n: f"{t} + make_ym_interval(0, {n})",
    secs=lambda n: f"make_dt_interval(0,0,0,{n})",
    # a column of the derived table: with a subquery in the key of a shuffled join that AQE turns into a broadcast one, Spark
    # fails ("Subquery ... has not finished")
    key=lambda e: (f", {e} as join_key", "e.join_key"),
)

DUCKDB = Dialect(
    json_k=lambda c: f"json_extract_string({c},'$.k')",
    months=lambda t, n: f"{t} + to_months({n})",
    secs=lambda n: f"to_seconds({n})",
    key=lambda e: ("", f"e.{e}"),
)

CUTOFF_SQL = "timestamp '1998-01-01 00:00:00'"


def _model_rate(d: Dialect) -> str:
    return ("select * from (values ('view',cast(0.004 as double)),('click',cast(0.02 as double)),"
            "('signup',cast(0.015 as double)),('purchase',cast(0.008 as double))) as t(model_name, rate)")


def _repo_department(d: Dialect) -> str:
    return """select distinct p_brand as repo_name,
  case cast(substr(p_brand,7) as int)%5 when 0 then 'AUTOMOBILE' when 1 then 'BUILDING'
  when 2 then 'FURNITURE' when 3 then 'HOUSEHOLD' else 'MACHINERY' end as department
from {part}"""


def _users_master(d: Dialect) -> str:
    return """select 'USR'||cast(c_custkey as varchar(20)) as user_id, c_name as employee_name, c_mktsegment as department,
  'Role-'||cast(c_nationkey%3 as varchar(20)) as role,
  case when c_custkey%10<3 then 'Enterprise' when c_custkey%10<8 then 'Pro' else 'Free' end as license_type,
  35 + (c_custkey*37%10500)/cast(100 as double) as hourly_rate,
  case when c_custkey%20<17 then 'Active' when c_custkey%20<19 then 'Inactive' else 'On-Leave' end as employment_status,
  case when c_custkey%20<3 then null else 'dev'||cast(c_custkey as varchar(20)) end as github_username
from {customer}"""


def _ai_usage_logs(d: Dialect) -> str:
    column, key = d.key("event_id % (select count(*) from {documents})")
    return f"""select 'LOG'||cast(event_id as varchar(20)) as prompt_id, 'USR'||cast(e.user_key as varchar(20)) as user_id,
  {d.months('ts', 'k%12')} as timestamp, case when event_id%17=0 then null else c.c_mktsegment end as department,
  event_type as model_name, dd.text as prompt_text, cast(round(value*100) as bigint)+100 as token_count
from (select *, cast({d.json_k('props')} as int) as k, (user_id*10 + event_id%10) % (select count(*) from {{customer}}) + 1 as user_key{column} from {{events}}) e
join {{customer}} c on c.c_custkey=e.user_key
join {{documents}} dd on dd.doc_id = {key}"""


def _tickets(d: Dialect) -> str:
    return f"""select 'JIRA'||cast(o_orderkey as varchar(20)) as jira_issue_id, 'USR'||cast(o_custkey as varchar(20)) as user_id, department,
  o_orderdate as created_at,
  case when o_orderstatus='O' and o_orderkey%11=0 then null else o_orderdate + {d.secs('ch*36')} end as resolved_at,
  case when o_orderkey%11=0 then cast(0 as double) else ch/cast(100 as double) end as cycle_time_hours,
  case o_orderkey%6 when 0 then 1 when 1 then 2 when 2 then 3 when 3 then 5 when 4 then 8 else 13 end as story_points,
  case o_orderpriority when '1-URGENT' then 'Critical' when '2-HIGH' then 'High' when '3-MEDIUM' then 'Medium' else 'Low' end as priority,
  period,
  case when period='Before' or o_custkey%7=0 then 0 when o_custkey%7=1 then (case when o_orderkey%4=0 then 1 else 0 end) else 1+o_orderkey%3 end as jira_tickets_closed
from (select b.*, cast(case when period='After' then floor((100+o_orderkey*37%9000)*(4+o_custkey%9)/cast(10 as double)) else 100+o_orderkey*37%9000 end as int) as ch
      from (select o.*, c_mktsegment as department, case when o_orderdate >= {CUTOFF_SQL} then 'After' else 'Before' end as period
            from {{orders}} o join {{customer}} on c_custkey=o_custkey) b) x"""


def _pull_requests(d: Dialect) -> str:
    return f"""select g.repo_name||'#'||cast(g.ok as varchar(20))||'-'||cast(g.ln as varchar(20)) as pr_id, g.github_username, g.repo_name,
  'org/'||g.repo_name as repo_full_name, case when g.ln=1 then null when g.ln=2 then '' else r.department end as department,
  'fix: '||g.repo_name as pr_title, g.pr_state, g.closed_at - {d.secs('g.ch*36')} as created_at,
  case when g.pr_state='merged' then g.closed_at end as merged_at, g.lines_added, g.lines_removed, g.ln as review_count, g.commit_count,
  case when g.ok%10=0 then null when g.ok%10=1 or g.pr_state<>'merged' then 'Unknown'
       when g.closed_at >= {CUTOFF_SQL} then 'After' else 'Before' end as period
from (select l_orderkey as ok, l_linenumber as ln, 'dev'||cast(min(l_suppkey) as varchar(20)) as github_username, min(p_brand) as repo_name,
        case when max(l_returnflag)='N' then 'closed' else 'merged' end as pr_state, min(l_shipdate) as closed_at,
        cast(sum(l_quantity) as bigint) as lines_added, cast(floor(sum(cast(l_quantity as bigint)*cast(round(l_discount*100) as bigint))*8/cast(100 as double)) as bigint) as lines_removed,
        count(*) as commit_count, cast((l_orderkey*131+l_linenumber*1717)%9600+100 as int) as ch
      from {{lineitem}} join {{part}} on p_partkey=l_partkey group by l_orderkey, l_linenumber) g
join {{repo_department}} r on r.repo_name=g.repo_name"""


# name -> (template, canonical/driver tables it reads)
CANONICAL: dict[str, tuple[Callable[[Dialect], str], tuple[str, ...]]] = {
    "model_rate": (_model_rate, ()),
    "repo_department": (_repo_department, ("part",)),
    "users_master": (_users_master, ("customer",)),
    "ai_usage_logs": (_ai_usage_logs, ("events", "customer", "documents")),
    "tickets": (_tickets, ("orders", "customer")),
    "pull_requests": (_pull_requests, ("lineitem", "part", "repo_department")),
}


def canonical_sql(name: str, dialect: Dialect) -> str:
    template, _ = CANONICAL[name]
    return template(dialect)


def duckdb_ctes(names: list[str]) -> str:
    """``with a as (...), b as (...)`` for the oracle, dependencies first."""
    ordered: list[str] = []

    def visit(n: str) -> None:
        if n in ordered or n not in CANONICAL:
            return
        for dep in CANONICAL[n][1]:
            visit(dep)
        ordered.append(n)

    for n in names:
        visit(n)
    parts = []
    for n in ordered:
        _, deps = CANONICAL[n]
        sql = canonical_sql(n, DUCKDB).format(**{t: t for t in deps})
        parts.append(f"{n} as ({sql})")
    return "with " + ",\n".join(parts) + "\n"


class Canonical:
    """Lazily derived canonical tables for one driver folder."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = spark
        self.sf_dir = sf_dir.rstrip("/")
        self._cache: dict[str, DataFrame] = {}

    def driver(self, name: str) -> DataFrame:
        key = "driver:" + name
        if key not in self._cache:
            self._cache[key] = self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")
        return self._cache[key]

    def table(self, name: str) -> DataFrame:
        if name not in self._cache:
            _, deps = CANONICAL[name]
            frames = {d: (self.table(d) if d in CANONICAL else self.driver(d)) for d in deps}
            self._cache[name] = self.spark.sql(canonical_sql(name, SPARK), **frames)
        return self._cache[name]

    # convenience accessors
    def users(self) -> DataFrame:
        return self.table("users_master")

    def logs(self) -> DataFrame:
        return self.table("ai_usage_logs")

    def tickets(self) -> DataFrame:
        return self.table("tickets")

    def pull_requests(self) -> DataFrame:
        return self.table("pull_requests")

    def model_rate(self) -> DataFrame:
        return self.table("model_rate")

    def repo_department(self) -> DataFrame:
        return self.table("repo_department")
