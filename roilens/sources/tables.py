"""Table sources: S1 load, S2 department scan, S3 lenient coercion, S4
schema alignment, S5/S16 existence-checked reads.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import schemas
from ..functions.timecols import parse_utc_ntz
from .sinks import CSV, read_csv
from .versions import read_table


def _exists(spark: SparkSession, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    hpath = jvm.org.apache.hadoop.fs.Path(path)
    fs = hpath.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return fs.exists(hpath)


def empty(spark: SparkSession, schema: T.StructType) -> DataFrame:
    return spark.createDataFrame([], schema)


def load(spark: SparkSession, path: str, table: str | None = None, fmt: str = "parquet",
         missing_ok: bool = False) -> DataFrame:
    """Read a table with its declared schema (no inference).

    ``missing_ok`` returns an empty frame of the declared schema when the
    path does not exist (S16: the analytics cache before its first write).
    """
    schema = schemas.TABLES.get(table) if table else None
    if missing_ok and not _exists(spark, path):
        if schema is None:
            raise ValueError("an empty result needs a declared table schema")
        return empty(spark, schema)
    if fmt == "parquet":
        df = read_table(spark, path)
    elif fmt == "csv" and schema is not None:
        df = read_csv(spark, path, schema)
    else:
        reader = spark.read.format(fmt)
        if fmt == "csv":
            reader = reader.options(multiLine=True, **CSV)
        df = (reader if schema is None else reader.schema(schema)).load(path)
    if schema is not None and fmt == "parquet":
        df = align_schema(df, schema)
    return df


def read_cache(spark: SparkSession, path: str) -> DataFrame:
    """The analytics cache, or an empty frame if it was never written."""
    return load(spark, path, "analytics_cache", missing_ok=True)


def scan_department(df: DataFrame, department: str | None) -> DataFrame:
    """``None``/``"All"`` -> no filter; otherwise equality on ``department``
    (pushed into the Parquet scan; prunes partitions when laid out by department)."""
    if department is None or department == "All":
        return df
    return df.where(F.col("department") == F.lit(department))


def _lenient(c: Column, dt: T.DataType) -> Column:
    if isinstance(dt, (T.IntegerType, T.LongType, T.DoubleType, T.FloatType, T.ShortType, T.DecimalType)):
        return F.coalesce(c.cast("string").try_cast(dt), F.lit(0).cast(dt))
    if isinstance(dt, T.TimestampNTZType):
        return c.cast("string").try_cast("timestamp_ntz")
    if isinstance(dt, T.TimestampType):
        return F.try_to_timestamp(c.cast("string"))
    if isinstance(dt, T.DateType):
        return c.cast("string").try_cast("date")
    return c.cast(dt)


def coerce_types(df: DataFrame, schema: T.StructType, utc_columns: tuple[str, ...] = ()) -> DataFrame:
    """S3: bad numbers -> 0, bad timestamps -> NULL (ANSI-safe ``try_*``).

    ``utc_columns`` hold zoned text (e.g. ``...Z`` / ``+00:00``): they are
    parsed as instants and stored as zone-free UTC wall time.
    """
    out = []
    present = set(df.columns)
    for f in schema.fields:
        if f.name not in present:
            continue
        c = F.col(f.name)
        if f.name in utc_columns:
            e = parse_utc_ntz(c)
        else:
            e = _lenient(c, f.dataType)
        out.append(e.alias(f.name))
    return df.select(*out, *[c for c in df.columns if c not in {f.name for f in schema.fields}])


def align_schema(df: DataFrame, schema: T.StructType, defaults: dict | None = None) -> DataFrame:
    """Add missing columns (typed NULL or a default), cast present ones,
    keep the declared order, then any extra columns."""
    defaults = defaults or {}
    names = set(df.columns)
    cols = []
    for f in schema.fields:
        if f.name in names:
            cols.append(F.col(f.name).cast(f.dataType).alias(f.name))
        else:
            cols.append(F.lit(defaults.get(f.name)).cast(f.dataType).alias(f.name))
    extra = [c for c in df.columns if c not in {f.name for f in schema.fields}]
    return df.select(*cols, *extra)


def with_missing(df: DataFrame, columns: list[str], value: float = 0.0) -> DataFrame:
    """``df`` with those of ``columns`` that it lacks, each a constant."""
    return df.withColumns({c: F.lit(value) for c in columns if c not in df.columns})


def align_pull_requests(prs: DataFrame) -> DataFrame:
    """S4 for PRs: schema + ``repo_full_name`` backfilled from ``repo_name`` +
    NULL period -> 'Unknown'."""
    out = align_schema(prs, schemas.PULL_REQUESTS)
    return (out.withColumn("repo_full_name", F.coalesce(F.col("repo_full_name"), F.col("repo_name")))
            .withColumn("period", F.coalesce(F.col("period"), F.lit("Unknown"))))
