"""Published tables: versioned folders and a manifest that is swapped last.

A table is a folder with data folders (``data/<id>``, one for each write) and
manifests (``manifests/<number>.json``). A manifest names the data folders that
make up one version; readers take the manifest with the highest number. A write
first puts all its files into a new data folder and then creates the next
manifest, in one step that fails if another writer took the number. So

* a writer that dies half-way leaves a folder that no manifest names: readers
  keep the last version,
* readers that began on an older version keep its files (``vacuum`` removes what
  no kept manifest names),
* a rerun publishes the same rows again as a new version.

A table may be laid out by a column (``partition_by``): its manifest then names a
folder for each value, and a write can replace some values only -- also by no
rows, which clears them -- without touching a file of the others. Manifests are
as large as there are values, not as there are rows. The folder must be on
storage that all executors and the driver share.
"""

from __future__ import annotations

import json
import urllib.parse
import uuid
from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

PART = "_part"
#: The name that Spark gives the folder of a null value (also of an empty string).
NULL_FOLDER = "__HIVE_DEFAULT_PARTITION__"


class VersionConflict(Exception):
    """Another writer published the version that this write was based on."""


class VersionedTable:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self._jvm = spark.sparkContext._jvm
        self._fs = self._hadoop(self.path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    # ---------------------------------------------------------------- files

    def _hadoop(self, path: str):
        return self._jvm.org.apache.hadoop.fs.Path(path)

    def _names(self, path: str) -> list[str]:
        at = self._hadoop(path)
        return [s.getPath().getName() for s in self._fs.listStatus(at)] if self._fs.exists(at) else []

    def _manifest(self, number: int) -> str:
        return f"{self.path}/manifests/{number:010d}.json"

    def _numbers(self) -> list[int]:
        return sorted(int(n[:-5]) for n in self._names(f"{self.path}/manifests") if n.endswith(".json"))

    # ---------------------------------------------------------------- reading

    def exists(self) -> bool:
        return bool(self._numbers())

    def current(self) -> dict:
        """The newest manifest: ``version``, ``partition_by``, ``schema``, ``folders`` (partition value -> data folders)."""
        numbers = self._numbers()
        if not numbers:
            raise FileNotFoundError(f"no published version in {self.path}")
        stream = self._fs.open(self._hadoop(self._manifest(numbers[-1])))
        try:
            return json.loads(bytes(self._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)))
        finally:
            stream.close()

    def read(self, values: Iterable[str | None] | None = None) -> DataFrame:
        """The newest version, or only the partitions of ``values`` (other folders are not even listed)."""
        now = self.current()
        keys = None if values is None else {self._key(v) for v in values}
        folders = [f"{self.path}/data/{f}" for k, f in sorted(now["folders"].items()) if keys is None or k in keys]
        schema = T.StructType.fromJson(now["schema"])
        if not folders:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*folders)

    # ---------------------------------------------------------------- writing

    @staticmethod
    def _key(value: str | None) -> str:
        return NULL_FOLDER if value is None or value == "" else str(value)

    def _put(self, df: DataFrame, partition_by: str | None) -> dict[str, str]:
        """Writes a data folder that no manifest names yet; its folders by partition value."""
        folder = uuid.uuid4().hex
        path = f"{self.path}/data/{folder}"
        if partition_by is None:
            df.write.parquet(path)
            return {"": folder}
        df.withColumn(PART, F.col(partition_by).cast("string")).write.partitionBy(PART).parquet(path)
        return {urllib.parse.unquote(n.partition("=")[2]): f"{folder}/{n}" for n in self._names(path)
                if n.startswith(f"{PART}=")}

    def _publish(self, number: int, partition_by: str | None, schema: T.StructType, folders: dict[str, str]) -> int:
        body = json.dumps({"version": number, "partition_by": partition_by, "schema": schema.jsonValue(), "folders": folders})
        draft = self._hadoop(f"{self.path}/drafts/{uuid.uuid4().hex}")
        stream = self._fs.create(draft, False)
        try:
            stream.write(bytearray(body.encode()))
        finally:
            stream.close()
        target = self._hadoop(self._manifest(number))
        self._fs.mkdirs(target.getParent())
        if self._fs.exists(target) or not self._fs.rename(draft, target):
            raise VersionConflict(f"version {number} of {self.path} was published by another writer")
        return number

    def _next(self) -> int:
        return (self._numbers() or [0])[-1] + 1

    def replace(self, df: DataFrame, partition_by: str | None = None) -> int:
        """The table is ``df`` from now on (which may read the table itself). Returns the version."""
        number, schema = self._next(), df.schema
        return self._publish(number, partition_by, schema, self._put(df, partition_by))

    def replace_partitions(self, df: DataFrame, values: Iterable[str | None]) -> int:
        """The partitions of ``values`` are those rows of ``df`` that have one of them -- none, if ``df`` has none."""
        now, keys = self.current(), {self._key(v) for v in values}
        column = now["partition_by"]
        if column is None:
            raise ValueError("the table is not laid out by a column")
        schema = T.StructType.fromJson(now["schema"])
        part = F.coalesce(F.nullif(F.col(column).cast("string"), F.lit("")), F.lit(NULL_FOLDER))
        rows = df.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in schema]).where(part.isin(sorted(keys)))
        new = self._put(rows, column)
        kept = {k: f for k, f in now["folders"].items() if k not in keys}
        return self._publish(now["version"] + 1, column, schema, kept | new)

    def update(self, updates: DataFrame, key: str, columns: list[str]) -> int:
        """``columns`` of the rows whose ``key`` is in ``updates`` take the new values (a null keeps the old one).

        Copy on write: only partitions that hold an updated key are read in full and rewritten; of all others the key column
        is read, once, and their files stay. ``updates`` has one row a key.
        """
        now = self.current()
        column = now["partition_by"]
        new = updates.select(F.col(key).alias("_key"), *[F.col(c).alias(f"_new_{c}") for c in columns])
        if column is None:
            values, rows = None, self.read()
        else:
            held = self.read().join(new, F.col(key) == F.col("_key"), "left_semi").select(F.col(column).cast("string"))
            values = [r[0] for r in held.distinct().collect()]  # partition values, not rows
            if not values:
                return now["version"]
            rows = self.read(values)
        joined = rows.join(new, F.col(key) == F.col("_key"), "left")
        done = joined.select(*[F.coalesce(F.col(f"_new_{c}"), F.col(c)).cast(rows.schema[c].dataType).alias(c)
                               if c in columns else F.col(c) for c in rows.columns])
        return self.replace(done) if values is None else self.replace_partitions(done, values)

    def vacuum(self, keep: int = 1) -> int:
        """Removes the data of all but the newest ``keep`` versions, and of writes that died. No writer may be at work.
        Returns how many data folders went."""
        numbers = self._numbers()
        used = set()
        for n in numbers[-keep:]:
            stream = self._fs.open(self._hadoop(self._manifest(n)))
            try:
                used |= {f.partition("/")[0] for f in json.loads(bytes(
                    self._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)))["folders"].values()}
            finally:
                stream.close()
        for n in numbers[:-keep]:
            self._fs.delete(self._hadoop(self._manifest(n)), False)
        gone = [f for f in self._names(f"{self.path}/data") if f not in used]
        for f in gone:
            self._fs.delete(self._hadoop(f"{self.path}/data/{f}"), True)
        return len(gone)


def read_table(spark: SparkSession, path: str) -> DataFrame:
    """A published table, or else a plain Parquet folder."""
    table = VersionedTable(spark, path)
    return table.read() if table.exists() else spark.read.parquet(path)
