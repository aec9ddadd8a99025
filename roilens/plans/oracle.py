"""DuckDB oracle SQL building blocks.

Each oracle is written directly in SQL from the operator's definition; the
only text shared with the Spark side is the canonical-table mapping (the
``with`` clause). Helpers mirror the numeric conventions of
``functions.numeric`` (decimal sums, decimal rounding).
"""

from __future__ import annotations

from ..sources.canonical import CANONICAL, DUCKDB, canonical_sql


def ES(x: str, s: int) -> str:
    return f"cast(sum(cast({x} as decimal(18,{s}))) as double)"


def EM(x: str, s: int) -> str:
    """Mean of the values as they are printed (every digit of a double counts), divided once."""
    return f"(cast(cast(sum(cast(cast({x} as varchar) as decimal(38,12))) as varchar) as double)/count({x}))"


def RD(x: str, n: int) -> str:
    return f"cast(round(cast({x} as decimal(28,8)),{n}) as double)"


def _risk_sql() -> str:
    from .. import params as P

    t = "prompt_text"
    regex = " + ".join(f"(case when regexp_matches({t}, '{pat}') then {P.PII_WEIGHTS[n]} else 0 end)"
                       for n, pat in P.PII_PATTERNS)
    kw = " + ".join(f"(case when contains(lower({t}), '{k}') then 1 else 0 end)" for k in P.SENSITIVE_KEYWORDS)
    return f"""case when {t} is null or {t} = '' then 0.0
  else least({RD(f'cast(({regex}) + least(20*({kw}), 40) as double)', 1)}, 100.0) end"""


def pii_types_sql(t: str = "prompt_text", sep: str = "|") -> str:
    from .. import params as P

    parts = [f"case when regexp_matches({t}, '{pat}') then 'REGEX:{n.upper()}' end" for n, pat in P.PII_PATTERNS]
    kwlist = "[" + ", ".join(f"'{k}'" for k in P.SENSITIVE_KEYWORDS) + "]"
    parts.append(f"""case when len(list_filter({kwlist}, lambda k: contains(lower({t}), k))) > 0
      then 'KEYWORD:' || array_to_string(list_filter({kwlist}, lambda k: contains(lower({t}), k)), ',') end""")
    return f"case when {t} is null or {t} = '' then '' else concat_ws('{sep}', {', '.join(parts)}) end"


def level_sql(s: str) -> str:
    return (f"case when {s} >= 75 then 'Critical' when {s} >= 50 then 'High' "
            f"when {s} >= 25 then 'Medium' else 'Low' end")


# Derived oracle tables: name -> (sql, dependencies)
DERIVED: dict[str, tuple[str, tuple[str, ...]]] = {
    "logs_c": (f"""select l.*, {RD('l.token_count/1000*coalesce(r.rate, 0.003)', 6)} as cost_usd
  from ai_usage_logs l left join model_rate r on r.model_name = l.model_name""",
               ("ai_usage_logs", "model_rate")),
    "logs_s0": (f"select *, {_risk_sql()} as risk_score from logs_c", ("logs_c",)),
    "logs_s": (f"select *, {level_sql('risk_score')} as risk_level, "
               f"cast(risk_score >= 25 as integer) as risk_flag from logs_s0", ("logs_s0",)),
    "prs": (f"""select p.*, u.user_id,
  {RD('date_diff(' + "'microsecond'" + ', p.created_at, p.merged_at)/3600000000', 2)} as cycle_time_hours,
  {RD('coalesce(p.lines_removed,0)/greatest(coalesce(nullif(p.lines_added,0),1),1)', 3)} as rework_ratio
  from pull_requests p left join (select github_username, user_id from users_master
     where github_username is not null and github_username <> '') u on u.github_username = p.github_username""",
            ("pull_requests", "users_master")),
    "prs_e": ("""select p.* replace (
     case when p.department is null or p.department = '' then rd.department else p.department end as department,
     case when p.period is null or p.period = 'Unknown' then
        case when p.merged_at is null then 'Unknown' when p.merged_at >= timestamp '1998-01-01 00:00:00' then 'After' else 'Before' end
     else p.period end as period)
  from prs p left join repo_department rd on rd.repo_name = p.repo_name""", ("prs", "repo_department")),
}


def M12(x: str) -> str:
    return EM(x, 12)


def _summary_sql() -> dict[str, tuple[str, tuple[str, ...]]]:
    return {
        "logs_e": ("""select l.* replace (coalesce(l.department, u.department) as department),
    u.employee_name, u.role, u.license_type, u.hourly_rate, u.github_username
  from logs_s l left join users_master u on u.user_id = l.user_id""", ("logs_s", "users_master")),
        "us0": (f"""select u.*, coalesce(c.total_cost, 0.0) as total_cost, coalesce(c.total_tokens, 0) as total_tokens,
    coalesce(c.prompt_count, 0) as prompt_count, coalesce(jb.c, 0.0) as avg_cycle_before, coalesce(ja.c, 0.0) as avg_cycle_after,
    cast(coalesce(ja.n, 0) as bigint) as tickets_closed, coalesce(gh.prs_merged, 0) as prs_merged,
    coalesce(gh.avg_pr_cycle, 0.0) as avg_pr_cycle, coalesce(gh.avg_rework, 0.0) as avg_rework
  from users_master u
  left join (select user_id, {ES('cost_usd', 6)} as total_cost, cast(sum(token_count) as bigint) as total_tokens,
             count(prompt_id) as prompt_count from logs_c group by user_id) c on c.user_id = u.user_id
  left join (select user_id, {EM('cycle_time_hours', 2)} as c from tickets where period = 'Before' group by user_id) jb
     on jb.user_id = u.user_id
  left join (select user_id, {EM('cycle_time_hours', 2)} as c, sum(jira_tickets_closed) as n from tickets
             where period = 'After' group by user_id) ja on ja.user_id = u.user_id
  left join (select user_id, count(pr_id) as prs_merged, {EM('cycle_time_hours', 2)} as avg_pr_cycle,
             {EM('rework_ratio', 3)} as avg_rework from prs where pr_state = 'merged' and user_id is not null
             group by user_id) gh on gh.user_id = u.user_id""", ("users_master", "logs_c", "tickets", "prs")),
        "us1": ("""select *, greatest(avg_cycle_before - avg_cycle_after, 0.0) as hours_saved_per_ticket from us0""",
                ("us0",)),
        "us2": ("""select *, coalesce(hours_saved_per_ticket * tickets_closed * hourly_rate, 0.0) as dollar_value_saved
  from us1""", ("us1",)),
        "us3": (f"""select *, coalesce(dollar_value_saved - total_cost, 0.0) as net_roi,
    {RD('coalesce(hours_saved_per_ticket / nullif(avg_cycle_before, 0) * 100, 0.0)', 1)} as pct_improvement from us2""",
                ("us2",)),
        "us": ("""select *, cast(coalesce(total_cost > (select median(total_cost) from us3) and tickets_closed = 0
    and prs_merged = 0 and total_cost > 0, false) as integer) as is_zombie from us3""", ("us3",)),
        "cl": ("""select us.* replace (cast(category = 'Zombie' as integer) as is_zombie) from (
  select us.*, case
    when total_cost > th.cost_hi and tickets_closed = 0 then 'Zombie'
    when total_cost >= th.cost_hi and tickets_closed <= th.out_lo and tickets_closed > 0 then 'At-Risk'
    when pct_improvement >= th.impr_hi and net_roi > 0 then 'Champion'
    when total_cost <= th.cost_lo and tickets_closed <= th.out_mid then 'Underutilized'
    else 'Healthy' end as category,
  case when total_tokens >= 50000 or prompt_count >= 50 or tickets_closed >= 5 then 'Enterprise'
       when total_tokens >= 10000 or prompt_count >= 10 or tickets_closed >= 1 then 'Pro' else 'Free' end as recommended_tier
  from us, (select quantile_cont(total_cost, 0.6) as cost_hi, quantile_cont(total_cost, 0.4) as cost_lo,
                   quantile_cont(tickets_closed, 0.3) as out_lo, quantile_cont(tickets_closed, 0.4) as out_mid,
                   quantile_cont(pct_improvement, 0.7) as impr_hi from us) th) us""", ("us",)),
        "classified": ("""select *, greatest(current_licence_cost - recommended_licence_cost, 0.0) as potential_saving from (
  select *, case license_type when 'Enterprise' then 30.0 when 'Pro' then 20.0 when 'Free' then 0.0 else 0.0 end::double
              as current_licence_cost,
            case recommended_tier when 'Enterprise' then 30.0 when 'Pro' then 20.0 else 0.0 end::double
              as recommended_licence_cost from cl)""", ("cl",)),
    }


DERIVED.update(_summary_sql())


def with_tables(names) -> str:
    ordered: list[str] = []

    def deps(n):
        if n in DERIVED:
            return DERIVED[n][1]
        if n in CANONICAL:
            return CANONICAL[n][1]
        return ()

    def visit(n):
        if n in ordered:
            return
        for d in deps(n):
            visit(d)
        if n in DERIVED or n in CANONICAL:
            ordered.append(n)

    for n in names:
        visit(n)
    parts = []
    for n in ordered:
        if n in DERIVED:
            sql = DERIVED[n][0]
        else:
            sql = canonical_sql(n, DUCKDB).format(**{t: t for t in CANONICAL[n][1]})
        parts.append(f"{n} as ({sql})")
    return ("with " + ",\n".join(parts) + "\n") if parts else ""


def oracle(tables, body: str) -> str:
    return with_tables(tables) + body
