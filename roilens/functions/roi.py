"""ROI and licence Column factories."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import params as P
from .numeric import _c, clip0, round_dec, safe_div


def prompt_cost(tokens, rate) -> Column:
    """P10: tokens / 1000 * rate, rounded to 6 dp."""
    return round_dec(_c(tokens) / 1000 * _c(rate), 6)


def roi_columns(before, after, tickets, rate, cost, clip: bool = True) -> dict[str, Column]:
    """The ROI formula as named Column expressions.

    hours = max(0, before - after) (clip=True) or before - after (clip=False)
    dollars = hours * tickets * rate; net = dollars - cost
    pct = hours / before * 100 (0 when before <= 0 / NULL when clip=False)
    """
    before, after, tickets, rate, cost = map(_c, (before, after, tickets, rate, cost))
    diff = before - after
    hours = clip0(diff) if clip else diff
    dollars = hours * tickets * rate
    net = dollars - cost
    if clip:
        pct = F.when(before > 0, hours / before * 100).otherwise(F.lit(0.0))
    else:
        pct = safe_div(hours, before) * 100
    return {
        "hours_saved_per_ticket": round_dec(hours, 2),
        "dollar_value_saved": round_dec(dollars, 2),
        "net_roi": round_dec(net, 2),
        "pct_improvement": round_dec(pct, 1),
        "roi_positive": net > 0,
    }


def licence_cost(tier) -> Column:
    """Monthly cost of a licence tier, 0 for unknown tiers."""
    m = F.create_map(*[x for k, v in P.LICENCE_COSTS.items() for x in (F.lit(k), F.lit(float(v)))])
    return F.coalesce(F.try_element_at(m, _c(tier)), F.lit(0.0))


def recommend_tier(tokens, prompts, tickets) -> Column:
    """First tier (Enterprise -> Pro -> Free) whose ANY minimum is met."""
    tokens, prompts, tickets = map(_c, (tokens, prompts, tickets))
    expr = F.lit("Free")
    for tier, min_tok, min_prompts, min_tickets in reversed(P.TIER_MINIMA):
        cond = (tokens >= min_tok) | (prompts >= min_prompts) | (tickets >= min_tickets)
        expr = F.when(cond, F.lit(tier)).otherwise(expr)
    return expr
