"""A small table replaced as a whole by each micro-batch.

Version ``n`` is written to its own folder and counts only once Spark has put its
success marker there, so readers never see half a version and a replayed batch
rewrites its own version from the one before it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from skysift.sources import files

KEPT = 2


class VersionedTable:
    def __init__(self, spark: SparkSession, path: str, schema):
        self.spark, self.path, self.schema = spark, path.rstrip("/"), schema

    def _folder(self, version: int) -> str:
        return f"{self.path}/v={version}"

    def versions(self) -> list[int]:
        found = [int(n[2:]) for n in files.children(self.spark, self.path) if n.startswith("v=")]
        return sorted(v for v in found if files.exists(self.spark, f"{self._folder(v)}/_SUCCESS"))

    def read(self, before: int | None = None) -> DataFrame:
        """The newest complete version, or the newest one below ``before``; empty if there is none."""
        usable = [v for v in self.versions() if before is None or v < before]
        if not usable:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(self._folder(usable[-1]))

    def write(self, df: DataFrame, version: int) -> None:
        df.write.mode("overwrite").parquet(self._folder(version))
        for old in [v for v in self.versions() if v < version][:-KEPT]:
            files.remove(self.spark, self._folder(old))
