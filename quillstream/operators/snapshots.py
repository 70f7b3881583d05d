"""A table in buckets of its key, with versions: a merge reads and writes only the buckets that its batch touches.

``data/<commit>/bucket=<n>`` holds rows, ``manifest`` (partitioned by version) says which directories make up a
version: those of untouched buckets are carried from the version before by path. A version is there once its
manifest rows are: Spark moves them in at the end of the write, so a merge that breaks leaves the version
before as it was, and older versions stay readable. One writer at a time; a second one for the same version
is refused where its rows meet the first one's.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_MANIFEST = "bucket int, path string, commit string, v int"


class Snapshot:
    """The table under ``path``; ``key`` may be several columns; the number of buckets is fixed when it is created."""

    def __init__(self, spark: SparkSession, path: str, key: list[str], buckets: int):
        self.spark, self.path, self.key, self.buckets = spark, path.rstrip("/"), key, buckets

    @classmethod
    def create(cls, rows: DataFrame, path: str, key: list[str], buckets: int) -> Snapshot:
        made = cls(rows.sparkSession, path, key, buckets)
        made._commit(made._put(rows), 0, [])
        return made

    def bucket(self) -> F.Column:
        return F.pmod(F.xxhash64(*self.key), F.lit(self.buckets)).cast("int")

    def _put(self, rows: DataFrame) -> str:
        commit = uuid.uuid4().hex
        placed = rows.withColumn("__bucket", self.bucket())
        placed.repartition(self.buckets, "__bucket").withColumnRenamed("__bucket", "bucket_").write.partitionBy("bucket_").parquet(f"{self.path}/data/{commit}")
        return commit

    def _commit(self, commit: str, version: int, carried: list[tuple[int, str]]) -> None:
        """Write a version's manifest: at most one row a bucket."""
        # The rows just written tell their buckets; their footers alone are read.
        schema = "bucket_ int"
        own = [r[0] for r in self.spark.read.schema(schema).parquet(f"{self.path}/data/{commit}").select("bucket_").distinct().collect()]
        rows = [(b, f"data/{commit}/bucket_={b}", commit, version) for b in sorted(own)] + [(b, p, commit, version) for b, p in carried]
        if not rows:
            rows = [(-1, None, commit, version)]
        self.spark.createDataFrame(rows, _MANIFEST).coalesce(1).write.mode("append").partitionBy("v").parquet(f"{self.path}/manifest")
        if len({r["commit"] for r in self._manifest(version)}) > 1:
            raise RuntimeError(f"another writer made version {version}")

    def _manifest(self, version: int | None = None):
        rows = self.spark.read.schema(_MANIFEST).parquet(f"{self.path}/manifest")
        if version is None:
            version = rows.agg(F.max("v")).first()[0]
        return rows.filter(F.col("v") == version).collect()

    def version(self) -> int:
        return self._manifest()[0]["v"]

    def _read(self, paths: list[str], schema) -> DataFrame:
        if not paths:
            return self.spark.createDataFrame([], schema)
        # Files are named, not directories, whose names would be read as a column.
        return self.spark.read.schema(schema).parquet(*(f"{self.path}/{p}/*.parquet" for p in paths))

    def read(self, schema, version: int | None = None) -> DataFrame:
        """All rows of a version (the newest by default) in the given schema."""
        return self._read([r["path"] for r in self._manifest(version) if r["path"]], schema)

    def merge(self, batch: DataFrame, schema, rule: Callable[[DataFrame, DataFrame], DataFrame]) -> int:
        """The next version: ``rule(current rows of the touched buckets, batch)`` replaces these; its number is returned.

        The touched buckets are told to the driver: at most as many as the table has.
        """
        before = self._manifest()
        touched = {r[0] for r in batch.select(self.bucket()).distinct().collect()}
        current = self._read([r["path"] for r in before if r["path"] and r["bucket"] in touched], schema)
        commit = self._put(rule(current, batch).select(*(F.col(f"`{f.name}`") for f in schema.fields)))
        version = before[0]["v"] + 1
        self._commit(commit, version, [(r["bucket"], r["path"]) for r in before if r["path"] and r["bucket"] not in touched])
        return version
