"""Small helpers shared by the operators."""

from __future__ import annotations

from uuid import uuid4

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def cut(df: DataFrame) -> DataFrame:
    """Cut the lineage with a reliable checkpoint in the shared folder."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint()


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as Parquet to the shared folder and reread: cuts the lineage, and readers take only their columns."""
    path = f"{ensure_checkpoint_dir(df.sparkSession).rstrip('/')}/{name}-{uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def fresh(df: DataFrame, base: str) -> str:
    """A column name that ``df`` does not have (names compare without case)."""
    taken = {c.lower() for c in df.columns}
    while base.lower() in taken:
        base = "_" + base
    return base


def id_remainder(doc_id: Column, parts: int) -> Column:
    """crc32 of the id written as text, modulo ``parts``; a null id counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % parts


def by_hash(df: DataFrame, key: Column, rows: int) -> DataFrame:
    """At most about ``rows`` rows: those whose key hash is smallest.

    The cut is found from the key alone, so a wide column (a text) is read only
    for rows that stay. Rows with equal keys share their fate: ties at the cut
    are cut by a final limit."""
    h = F.xxhash64(key)
    smallest = df.select(h.alias("h")).orderBy("h").limit(rows).agg(F.max("h")).first()[0]
    if smallest is None:
        return df.limit(0)
    return df.where(h <= F.lit(smallest)).orderBy(h).limit(rows)
