"""Numeric helpers that make floating results reproducible across engines.

* ``exact_sum``: sums through DECIMAL so the result does not depend on row
  order (partition layout, shuffle order).
* ``round_dec``: rounds half away from zero on the decimal form of the value,
  which is what SQL ROUND means for these inputs on every engine.
* ``safe_div``: x / y with y == 0 -> NULL (SQL NULLIF semantics), never raises
  under ANSI mode.
* ``clip0``: max(x, 0) keeping NULL as NULL (``greatest`` would skip NULLs).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def exact_sum(x, scale: int = 12, precision: int = 38) -> Column:
    """Order-independent sum: doubles are added in their (shortest) decimal form, digits beyond ``scale`` rounded off, and
    become a double once, at the end."""
    return F.sum(_c(x).cast(f"decimal({precision},{scale})")).cast("double")


def exact_mean(x) -> Column:
    """Order-independent mean of the non-null values of x (NULL if none); no value is rounded first (12 decimals kept)."""
    return exact_sum(x) / F.count(_c(x))


def round_dec(x, digits: int) -> Column:
    """Half-away-from-zero rounding of the decimal form of x, as double."""
    return F.round(_c(x).cast("decimal(28,8)"), digits).cast("double")


def safe_div(num, den) -> Column:
    """num / den, NULL when den is 0 or NULL."""
    return F.try_divide(_c(num), F.nullif(_c(den), F.lit(0)))


def clip0(x) -> Column:
    """Clip below at 0; NULL stays NULL."""
    x = _c(x)
    return F.when(x.isNull(), F.lit(None)).otherwise(F.greatest(x, F.lit(0.0)))
