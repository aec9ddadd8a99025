"""Pull-request and ticket Column factories."""

from __future__ import annotations

import datetime as _dt

from pyspark.sql import Column
from pyspark.sql import functions as F

from .numeric import _c, round_dec


def ntz_literal(ts: _dt.datetime) -> Column:
    """A zone-free timestamp literal (no session/host time zone involved)."""
    return F.lit(ts.strftime("%Y-%m-%d %H:%M:%S")).cast("timestamp_ntz")


def period_label(ts, cutoff: _dt.datetime) -> Column:
    """After when ts >= cutoff, else Before (NULL ts -> NULL)."""
    t = _c(ts)
    return F.when(t >= ntz_literal(cutoff), F.lit("After")).when(
        t.isNotNull(), F.lit("Before"))


def period_backfill(period, merged_at, cutoff: _dt.datetime) -> Column:
    """Only NULL/'Unknown' periods are recomputed from merged_at;
    a missing merged_at gives 'Unknown'."""
    p, m = _c(period), _c(merged_at)
    needs = p.isNull() | (p == "Unknown")
    return F.when(needs, F.coalesce(period_label(m, cutoff), F.lit("Unknown"))).otherwise(p)


def short_repo_name(full_name) -> Column:
    """P5: 'owner/repo' -> 'repo' (a name without '/' is returned as is)."""
    return F.element_at(F.split(_c(full_name), "/", 2), -1)


def hours_between(start, end) -> Column:
    """Exact elapsed hours between two timestamps (microsecond precision,
    independent of the session time zone)."""
    from .timecols import elapsed_micros

    return elapsed_micros(start, end) / 3_600_000_000


def pr_cycle_hours(created, merged) -> Column:
    """(merged - created) in hours, 2 dp."""
    return round_dec(hours_between(created, merged), 2)


def rework_ratio(added, removed) -> Column:
    """Removed / max(added or 1, 1), 3 dp; missing counts are 0."""
    a = F.coalesce(F.nullif(_c(added), F.lit(0)), F.lit(1))
    return round_dec(F.coalesce(_c(removed), F.lit(0)) / F.greatest(a, F.lit(1)), 3)


def ticket_cycle_hours(created, resolved) -> Column:
    """Elapsed hours when resolved > created, else 0 (2 dp)."""
    c, r = _c(created), _c(resolved)
    return F.when(c.isNotNull() & r.isNotNull() & (r > c), round_dec(hours_between(c, r), 2)).otherwise(F.lit(0.0))


def ticket_cycle_backfill(cycle, created, resolved) -> Column:
    """Where cycle == 0 use (resolved - created) hours, NULL -> 0, floor at 0."""
    cy = _c(cycle)
    delta = F.greatest(F.coalesce(hours_between(created, resolved), F.lit(0.0)), F.lit(0.0))
    return F.when(cy == 0, delta).otherwise(cy)
