"""Sinks: S6 CSV, S9 full replace, S10 replace one repository, S14/S15
privacy projection and the processed-bundle export.

Tables that others read while they are rewritten are published by version (``versions.py``); exports are plain folders,
overwritten as a whole. Paths must be on shared storage.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .. import schemas
from ..session import shuffles_dropped
from .versions import VersionedTable

#: One format for both ways: quotes are doubled, so texts with quotes, commas and line breaks read back as they were.
CSV = {"header": True, "quote": '"', "escape": '"', "ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False}
#: Spark's text readers know zstd by a file's ending, its writers only by the class, which Parquet brings along.
CSV_CODECS = {"zstd": "org.apache.parquet.hadoop.codec.ZstandardCodec"}


def write_table(df: DataFrame, path: str, fmt: str = "parquet", partition_by: list[str] | None = None,
                compression: str | None = None) -> None:
    """Full replace. The shuffle files behind it go as soon as it is written."""
    w = df.write.mode("overwrite").format(fmt)
    if compression:
        w = w.option("compression", CSV_CODECS.get(compression, compression) if fmt == "csv" else compression)
    if fmt == "csv":
        w = w.options(**CSV)
    if partition_by:
        w = w.partitionBy(*partition_by)
    with shuffles_dropped(df.sparkSession):
        w.save(path)


def write_csv(df: DataFrame, path: str, compression: str | None = None) -> None:
    """CSV with a header row. Compressed files lose no splits: a file of texts with line breaks is read as a whole anyway."""
    write_table(df, path, "csv", compression=compression)


def read_csv(spark: SparkSession, path: str, table: str | StructType) -> DataFrame:
    """CSV read back with the declared schema of a table, or the given one (no inference)."""
    return spark.read.schema(schemas.TABLES[table] if isinstance(table, str) else table).options(multiLine=True, **CSV).csv(path)


def replace_repo(spark: SparkSession, prs: DataFrame, path: str, repo_name: str | None = None) -> int:
    """A published table laid out by ``repo_name``: replaced as a whole, or (``repo_name``) the rows of one repository,
    which is cleared if ``prs`` has none of it. Other repositories keep their files. Returns the version."""
    table = VersionedTable(spark, path)
    if repo_name is None or not table.exists():
        return table.replace(prs if repo_name is None else prs.where(F.col("repo_name") == repo_name), "repo_name")
    return table.replace_partitions(prs, [repo_name])


def privacy_projection(prs: DataFrame) -> DataFrame:
    """Drop the internal identity mapping from PR exports."""
    return prs.drop("user_id")


def export_bundle(out_dir: str, enriched_logs: DataFrame | Callable[[Callable[[DataFrame, str], DataFrame]], DataFrame], dept_perf: DataFrame, user_summary: DataFrame,
                  prs: DataFrame | None = None, fmt: str = "parquet") -> dict[str, str]:
    """Write the four processed datasets; prompt text is redacted
    and PR rows lose ``user_id`` (S14).

    ``enriched_logs`` may be a function instead: it is given the redaction of
    distinct texts, ``texts(frame, column)``, and returns the logs with texts
    so redacted, as ``Inputs.logs_enriched`` does in its one pass over texts.
    Rows of one text are written side by side, which zstd stores once.
    """
    from ..operators.governance import redact_frame

    out_dir = out_dir.rstrip("/")
    ext = "csv" if fmt == "csv" else "parquet"
    paths = {
        "usage_logs": f"{out_dir}/usage_logs_enriched.{ext}",
        "dept_performance": f"{out_dir}/dept_performance.{ext}",
        "user_summary": f"{out_dir}/user_summary.{ext}",
    }
    if callable(enriched_logs):
        logs = enriched_logs(lambda texts, column: redact_frame(texts, column, distinct=True))
    else:
        logs = redact_frame(enriched_logs, "prompt_text")
    write_table(logs, paths["usage_logs"], fmt, compression="zstd" if ext == "parquet" else None)
    write_table(dept_perf, paths["dept_performance"], fmt)
    write_table(user_summary, paths["user_summary"], fmt)
    if prs is not None:
        paths["pull_requests"] = f"{out_dir}/github_pr_enriched.{ext}"
        write_table(privacy_projection(prs), paths["pull_requests"], fmt)
    return paths
