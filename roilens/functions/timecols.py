"""Time Column factories.

Timestamps stay TIMESTAMP_NTZ: ``hour``/``date_format``/``weekofyear`` on NTZ
values ignore the session time zone, so results do not move with it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .numeric import _c


def month_key(ts) -> Column:
    """``yyyy-MM`` month key; NULL timestamp -> NULL month."""
    return F.date_format(_c(ts), "yyyy-MM")


def time_features(df: DataFrame, ts: str = "timestamp") -> DataFrame:
    """Date, hour, day_name, ISO week, month_year."""
    t = F.col(ts)
    return df.select("*",
                     F.to_date(t).alias("date"),
                     F.hour(t).alias("hour"),
                     F.date_format(t, "EEEE").alias("day_name"),
                     F.weekofyear(t).alias("week"),
                     month_key(t).alias("month_year"))


def utc_normalise(df: DataFrame, candidates=("timestamp", "created_at", "merged_at", "date")) -> DataFrame:
    """The first present date column becomes a zone-free UTC ``ts_utc``.

    Zoned TIMESTAMP values are converted to UTC wall time; NTZ values are
    already zone-free and are kept; strings are parsed leniently.
    """
    from pyspark.sql import types as T

    fields = {f.name: f.dataType for f in df.schema.fields}
    col = next((c for c in candidates if c in fields), None)
    if col is None:
        return df.withColumn("ts_utc", F.lit(None).cast("timestamp_ntz"))
    dt = fields[col]
    c = F.col(col)
    if isinstance(dt, T.TimestampNTZType):
        e = c
    elif isinstance(dt, T.TimestampType):
        e = instant_to_utc_ntz(c)
    elif isinstance(dt, T.DateType):
        e = c.cast("timestamp_ntz")
    else:
        e = parse_utc_ntz(c)
    return df.withColumn("ts_utc", e)


_EPOCH = "1970-01-01 00:00:00"
_ZONED = r"(Z|[+-]\d{2}:?\d{2})$"


def instant_to_utc_ntz(ts) -> Column:
    """A zoned TIMESTAMP (an instant) -> its UTC wall time as TIMESTAMP_NTZ.

    Built from epoch microseconds, so no session time zone is involved (a
    cast from TIMESTAMP to TIMESTAMP_NTZ would apply the session zone).
    """
    micros = F.unix_micros(_c(ts))
    day = 86_400_000_000
    days = F.floor(micros / day).cast("int")
    rem = micros - days.cast("bigint") * day  # < one day: exact in a double
    return F.lit(_EPOCH).cast("timestamp_ntz") + F.make_dt_interval(
        days, F.lit(0), F.lit(0), (rem / 1_000_000).cast("decimal(18,6)"))


def parse_utc_ntz(text, fmt: str | None = None) -> Column:
    """ISO-8601 text -> zone-free UTC timestamp. Text with an offset (``Z``,
    ``+00:00``, ``+0000``) is converted to UTC; text without one is taken as
    UTC wall time. Unparseable text -> NULL (ANSI-safe)."""
    t = _c(text).cast("string")
    zoned = F.try_to_timestamp(t, F.lit(fmt)) if fmt else F.try_to_timestamp(t)
    return F.when(t.rlike(_ZONED), instant_to_utc_ntz(zoned)).otherwise(t.try_cast("timestamp_ntz"))


def elapsed_micros(start, end) -> Column:
    """Exact elapsed microseconds between two timestamps, computed on the
    interval ``end - start`` (TIMESTAMP_NTZ arithmetic has no time zone)."""
    secs = (_c(end) - _c(start)).cast("interval second").cast("decimal(18,6)")
    return (secs * 1_000_000).cast("bigint")
