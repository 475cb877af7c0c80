"""Tables that change in one step: data of a version is written first, then one row of a manifest makes it the one that is read."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class Manifest:
    """The versions of what lies in one folder. A version nobody committed is never read, and is written over by the next try."""

    def __init__(self, spark: SparkSession, path: str, columns: str):
        self.spark, self.path = spark, path.rstrip("/")
        self.schema = f"version int, {columns}"

    def latest(self) -> dict | None:
        try:
            rows = self.spark.read.schema(self.schema).parquet(f"{self.path}/manifest").orderBy(F.desc("version")).limit(1).collect()
        except Exception as e:  # nothing was committed yet
            if "PATH_NOT_FOUND" not in str(e):
                raise
            return None
        return rows[0].asDict() if rows else None

    def commit(self, version: int, *values) -> None:
        self.spark.createDataFrame([(version, *values)], self.schema).coalesce(1).write.mode("append").parquet(f"{self.path}/manifest")

    def table(self, name: str, schema: str, version: int | None = None) -> DataFrame:
        """The table ``name`` as of a version; empty if there is none."""
        if version is None:
            row = self.latest()
            version = row["version"] if row else None
        if version is None:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(f"{self.path}/{name}/version={version}")

    def write(self, name: str, version: int, rows: DataFrame) -> DataFrame:
        """``rows`` as the table ``name`` of a version to come."""
        at = f"{self.path}/{name}/version={version}"
        rows.write.mode("overwrite").parquet(at)
        return self.spark.read.schema(rows.schema).parquet(at)
