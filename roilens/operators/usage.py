"""Usage-log operators: P10 prompt cost, J1/P14 enrichment, P1 time features,
A12 monthly department trend, N1 month-over-month trend, D1-D7 and D18-D19
dashboard aggregates.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import params as P
from ..functions.numeric import exact_sum, round_dec
from ..functions.roi import prompt_cost
from ..functions.timecols import time_features
from .stats import exact_quantiles


def rate_table(spark: SparkSession, rates: dict[str, float] | None = None) -> DataFrame:
    """The model -> USD/1k-token parameter table as a DataFrame."""
    rates = P.MODEL_RATES if rates is None else rates
    schema = T.StructType([T.StructField("model_name", T.StringType()),
                           T.StructField("rate", T.DoubleType())])
    return spark.createDataFrame([(k, float(v)) for k, v in rates.items()], schema)


def with_prompt_cost(logs: DataFrame, rates: DataFrame,
                     default_rate: float = P.DEFAULT_MODEL_RATE) -> DataFrame:
    """P10: add ``cost_usd`` = tokens/1000 x rate(model), default rate for unknown models.

    The rate table is one row per model -- a parameter table whose size does
    not grow with the data -- so it is broadcast (no shuffle of the logs).
    """
    r = rates.select(F.col("model_name").alias("_m"), F.col("rate").alias("_rate"))
    joined = logs.join(F.broadcast(r), logs["model_name"] == F.col("_m"), "left")
    return (joined.withColumn("cost_usd", prompt_cost("token_count",
                                                      F.coalesce(F.col("_rate"), F.lit(default_rate))))
            .drop("_m", "_rate"))


USER_COLUMNS = ("employee_name", "department", "role", "license_type", "hourly_rate", "github_username")


def enrich_usage(logs: DataFrame, users: DataFrame) -> DataFrame:
    """J1 + P14 + P1: left join user attributes, fill a missing log department
    from the user master, add date/hour/day_name/week/month_year.

    The user dimension is joined on user_id; the planner broadcasts it when
    its runtime size is under the broadcast threshold (AQE), else shuffles.
    """
    u = users.select("user_id", *[F.col(c).alias(f"{c}_user") for c in USER_COLUMNS])
    j = logs.join(u, "user_id", "left")
    out = j.withColumn("department", F.coalesce(F.col("department"), F.col("department_user")))
    for c in USER_COLUMNS:
        if c == "department":
            continue
        if c in logs.columns:
            out = out.drop(f"{c}_user")
        else:
            out = out.withColumnRenamed(f"{c}_user", c)
    out = out.drop("department_user")
    return time_features(out, "timestamp")


def monthly_dept_trend(logs: DataFrame) -> DataFrame:
    """Month x department prompts, tokens, cost (4 dp), active users,
    flagged prompts. SQL grouping: NULL department/month groups are kept."""
    return (logs.groupBy(F.date_format("timestamp", "yyyy-MM").alias("month_year"), "department")
            .agg(F.count("prompt_id").alias("prompt_count"),
                 F.sum("token_count").alias("total_tokens"),
                 round_dec(exact_sum("cost_usd", 6), 4).alias("total_cost"),
                 F.countDistinct("user_id").alias("active_users"),
                 F.sum("risk_flag").cast("bigint").alias("pii_violations"))
            .orderBy("month_year", "department"))


def monthly_trend(logs: DataFrame) -> DataFrame:
    """Month-over-month cost/tokens/users/prompts with cost % change (1 dp).

    The window runs over the *monthly* aggregate -- one row per month, a
    bounded handful -- so an unpartitioned ordered window is safe here.
    """
    from pyspark.sql import Window

    m = (logs.withColumn("month_year", F.date_format("timestamp", "yyyy-MM"))
         .where(F.col("month_year").isNotNull())
         .groupBy("month_year")
         .agg(exact_sum("cost_usd", 6).alias("total_cost"),
              F.sum("token_count").alias("total_tokens"),
              F.countDistinct("user_id").alias("active_users"),
              F.count("prompt_id").alias("prompt_count")))
    prev = F.lag("total_cost").over(Window.orderBy("month_year"))
    return (m.withColumn("cost_mom_pct",
                         round_dec(F.try_divide(F.col("total_cost") - prev, F.nullif(prev, F.lit(0.0))) * 100, 1))
            .orderBy("month_year"))


def daily_trend(logs: DataFrame) -> DataFrame:
    """Cost and tokens per calendar day."""
    return (logs.where(F.col("timestamp").isNotNull())
            .groupBy(F.to_date("timestamp").alias("date"))
            .agg(exact_sum("cost_usd", 6).alias("cost"), F.sum("token_count").alias("tokens"))
            .orderBy("date"))


def dept_spend(logs: DataFrame) -> DataFrame:
    """Spend per department (ascending)."""
    return (logs.where(F.col("department").isNotNull()).groupBy("department")
            .agg(exact_sum("cost_usd", 6).alias("cost_usd"))
            .orderBy("cost_usd", "department"))


def weekday_volume(logs: DataFrame) -> DataFrame:
    """D3: prompts per weekday, all seven days present (zero filled).

    The seven-row day dimension is a constant, broadcast by construction.
    """
    spark = logs.sparkSession
    days = spark.createDataFrame([(i, d) for i, d in enumerate(P.WEEKDAY_ORDER)], "day_idx int, day string")
    counts = (logs.where(F.col("timestamp").isNotNull())
              .groupBy(F.date_format("timestamp", "EEEE").alias("day"))
              .agg(F.count("prompt_id").alias("events")))
    return (F.broadcast(days).join(counts, "day", "left")
            .select("day", F.coalesce(F.col("events"), F.lit(0)).alias("events"), "day_idx")
            .orderBy("day_idx").drop("day_idx"))


def active_users(logs: DataFrame, approx: bool = False) -> DataFrame:
    """Distinct users per department (``approx`` -> HyperLogLog++)."""
    agg = F.approx_count_distinct("user_id") if approx else F.countDistinct("user_id")
    return (logs.where(F.col("department").isNotNull()).groupBy("department")
            .agg(agg.alias("active_users")))


def day_hour_heatmap(logs: DataFrame) -> DataFrame:
    """Prompts per weekday x hour (columns h00..h23, zero filled).

    The 24 hour values are given to ``pivot`` so no extra job discovers them.
    """
    g = (logs.where(F.col("timestamp").isNotNull())
         .select(F.date_format("timestamp", "EEEE").alias("day_name"), F.hour("timestamp").alias("hour"))
         .groupBy("day_name").pivot("hour", list(range(24))).count())
    return g.select("day_name", *[F.coalesce(F.col(str(h)), F.lit(0)).alias(f"h{h:02d}") for h in range(24)])


def model_usage(logs: DataFrame) -> DataFrame:
    """Requests and cost per model."""
    return (logs.where(F.col("model_name").isNotNull()).groupBy("model_name")
            .agg(F.count("prompt_id").alias("requests"), exact_sum("cost_usd", 6).alias("total_cost"))
            .orderBy(F.col("requests").desc(), "model_name"))


def dept_model_cost(logs: DataFrame) -> DataFrame:
    """Cost per department x model."""
    return (logs.where(F.col("department").isNotNull() & F.col("model_name").isNotNull())
            .groupBy("department", "model_name").agg(exact_sum("cost_usd", 6).alias("cost_usd")))


def token_histogram(logs: DataFrame, bins: int = 40) -> DataFrame:
    """Equal-width histogram of token counts (> 0) between min and max.

    Bounds are scalar subqueries over the same input (executed once each,
    no join); the maximum falls into the last bin.
    """
    tk = logs.where(F.col("token_count") > 0).select(F.col("token_count").cast("double").alias("t"))
    bounds = tk.agg(F.struct(F.min("t").alias("lo"), F.max("t").alias("hi"))).scalar()
    lo, hi = bounds["lo"], bounds["hi"]
    w = (hi - lo) / bins
    b = F.when(hi == lo, F.lit(0)).otherwise(F.least(F.floor((F.col("t") - lo) / w).cast("int"), F.lit(bins - 1)))
    counts = tk.groupBy(b.alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    every = logs.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin"))  # empty bins stay in the picture
    return (every.join(counts, "bin", "left").where(lo.isNotNull()).withColumn("count", F.coalesce("n", F.lit(0)))
            .select("bin", (lo + F.col("bin") * (hi - lo) / bins).alias("bin_start"),
                    (lo + (F.col("bin") + 1) * (hi - lo) / bins).alias("bin_end"), "count")
            .orderBy("bin"))


def token_median(logs: DataFrame) -> DataFrame:
    """Median token count of requests with tokens > 0."""
    return exact_quantiles(logs.where(F.col("token_count") > 0), {"token_count": [0.5]}).select(
        F.col("token_count_q0").alias("median_tokens"))


def usage_header(logs: DataFrame) -> DataFrame:
    """Number of usage events and distinct active users."""
    return logs.agg(F.count(F.lit(1)).alias("usage_events"), F.countDistinct("user_id").alias("active_users"))


def department_domain(users: DataFrame) -> DataFrame:
    """Sorted distinct non-null departments."""
    return users.where(F.col("department").isNotNull()).select("department").distinct().orderBy("department")
