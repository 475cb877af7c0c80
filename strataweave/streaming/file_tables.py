"""Parsed rows of files that come, change and go, kept by version: a batch takes effect as one step, or not at all.

Rows of a batch's new and changed files are written under the batch; ``files`` says for every file that is there which batch holds
its rows. A deleted file leaves ``files``, and with it go its rows. The last batch taken in stands in the manifest, so a batch that comes
again changes nothing.

Defined results: paths are blind to case; of several rows for one path in a batch the one with the greatest ``seq`` counts (without
such a column any, a deletion last); a null content without deletion is an empty file; null paths are left out; an empty batch only
moves the version.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources import xml_config
from ..sources.versions import Manifest

FILES = "key string, path string, hash string, batch long"


class FileTables:
    """Rows that ``parse`` (path, content -> rows with a path) makes of the files taken in so far."""

    def __init__(self, spark: SparkSession, path: str, parse: Callable[[DataFrame], DataFrame] = xml_config.config_rows, schema: str = xml_config.SCHEMA):
        self.spark, self.path, self.parse, self.schema = spark, path.rstrip("/"), parse, schema
        self.manifest = Manifest(spark, path, "batch long")

    def files(self) -> DataFrame:
        return self.manifest.table("files", FILES)

    def apply(self, batch: int, files: DataFrame, whole: bool = False) -> DataFrame | None:
        """Take in a batch of files (path, content; deleted and seq if there); ``whole``: what it doesn't name is deleted.

        Gives path and action (added, changed, removed, unchanged) of its files; None for a batch taken in before.
        """
        last = self.manifest.latest()
        if last is not None and batch <= last["batch"]:
            return None
        version = last["version"] + 1 if last else 1
        deleted = F.coalesce(F.col("deleted"), F.lit(False)) if "deleted" in files.columns else F.lit(False)
        given = files.filter("path is not null").select(
            F.lower("path").alias("key"), "path", F.coalesce("content", F.lit("")).alias("content"), deleted.alias("deleted"), (F.col("seq") if "seq" in files.columns else F.lit(0)).alias("seq"),
        )
        given = given.withColumn("hash", F.sha2(F.col("content").cast("binary"), 256))
        latest = given.groupBy("key").agg(F.max(F.struct("seq", "deleted", "hash", "path")).alias("x")).select("key", "x.path", "x.hash", "x.deleted")
        held = self.files().select("key", F.col("path").alias("old_path"), F.col("hash").alias("old"), "batch")
        gone = F.col("deleted") | (F.col("hash").isNull() & F.lit(whole))
        action = (
            F.when(F.col("hash").isNull() & ~F.lit(whole), "kept").when(gone & F.col("old").isNull(), "absent").when(gone, "removed")
            .when(F.col("old").isNull(), "added").when(F.col("old") != F.col("hash"), "changed").otherwise("unchanged")
        )
        joined = latest.join(held, "key", "full_outer").withColumn("deleted", F.coalesce("deleted", F.lit(False)))
        change = self.manifest.write("changes", version, joined.select("key", F.coalesce("path", "old_path").alias("path"), "hash", "old", "batch", action.alias("action")))
        new = change.filter("action in ('added', 'changed')")
        texts = given.filter("not deleted").join(new.select("key", "path", "hash"), ["key", "path", "hash"], "left_semi").dropDuplicates(["key"])
        self.parse(texts.select("path", "content")).write.mode("overwrite").parquet(f"{self.path}/rows/batch={batch}")
        kept = change.filter("action in ('kept', 'unchanged')").select("key", "path", F.col("old").alias("hash"), "batch")
        self.manifest.write("files", version, kept.unionByName(new.select("key", "path", "hash", F.lit(batch).cast("long").alias("batch"))))
        self.manifest.commit(version, batch)
        return change.filter("action not in ('kept', 'absent')").select("path", "action")

    def rows(self) -> DataFrame:
        """Parsed rows of all files that are there."""
        last = self.manifest.latest()
        if last is None:
            return self.spark.createDataFrame([], self.schema)
        held = self.spark.read.schema(f"{self.schema}, batch long").parquet(f"{self.path}/rows")
        live = self.files().select(F.lower("path").alias("__key"), F.col("batch").alias("__batch"))
        return held.join(live, (F.lower(held["path"]) == F.col("__key")) & (held["batch"] == F.col("__batch")), "left_semi").drop("batch")

    def follow(self, source: str, checkpoint: str, once: bool = True):
        """Take in JSON lines (path, content, deleted, seq) below ``source`` as they come; every micro-batch is one step."""
        stream = self.spark.readStream.schema("path string, content string, deleted boolean, seq long").json(source)
        writer = stream.writeStream.foreachBatch(lambda rows, batch: self.apply(batch, rows)).option("checkpointLocation", checkpoint)
        return (writer.trigger(availableNow=True) if once else writer).start()
