"""Tables as they are kept: bulk writes, merges, rebuilds, guarded copies, cleanups and times as text."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..model import Model, n, query
from ..session import shared_dir
from ..sources import sinks


@query("snk_01_bulk_write", """
    SELECT 'xml_definitions' AS table_name, count(*) AS n, count(DISTINCT id) AS ids FROM xml_definitions UNION ALL SELECT 'xml_properties', count(*), count(DISTINCT id) FROM xml_properties
    UNION ALL SELECT 'xml_references', count(*), count(DISTINCT id) FROM xml_references UNION ALL SELECT 'xml_stats', count(DISTINCT definition_type), count(DISTINCT definition_type) FROM xml_definitions""")  # fmt: skip
def bulk_write(m: Model) -> DataFrame:
    """Definitions, properties, references and their numbers, written and read back."""
    stats = m.xml_definitions.groupBy("definition_type").agg(n().alias("count")).select(F.col("definition_type").alias("id"), "count")
    tables = {"xml_definitions": m.xml_definitions, "xml_properties": m.xml_properties, "xml_references": m.xml_references, "xml_stats": stats}
    counted = [sinks.stored(t, name).agg(n().alias("n"), F.countDistinct("id").alias("ids")).select(F.lit(name).alias("table_name"), "n", "ids") for name, t in tables.items()]
    return reduce(DataFrame.unionByName, counted)


@query("snk_03_keep_first", """
    SELECT id, full_name, coalesce(base_type, 'Base' || id) AS base_type, assembly FROM types UNION ALL SELECT id + 1000, 'New.' || full_name, 'Base' || id, 'late' FROM types""")  # fmt: skip
def keep_first(m: Model) -> DataFrame:
    """A second load of types: what is known stands, gaps are filled, new names are added."""
    base = F.concat(F.lit("Base"), F.col("id").cast("string"))
    old = m.types.select("id", "full_name", "base_type", "assembly")
    again = old.select("id", "full_name", base.alias("base_type"), F.lit("late").alias("assembly"))
    added = again.select((F.col("id") + 1000).alias("id"), F.concat(F.lit("New."), "full_name").alias("full_name"), "base_type", "assembly")
    later = again.withColumn("base_type", F.lit("too late"))
    rows = again.withColumn("turn", F.lit(1)).unionByName(added.withColumn("turn", F.lit(1))).unionByName(later.withColumn("turn", F.lit(2)))
    return sinks.keep_first(old, rows, ["full_name"], order="turn")


@query("snk_04_insert_or_replace", "SELECT class_name, arg_max(severity, id) AS severity, max(id) AS id FROM game_code_analysis GROUP BY 1")
def insert_or_replace(m: Model) -> DataFrame:
    """Of findings for one class the last written stands."""
    return sinks.last_wins(m.game_code_analysis.select("class_name", "severity", "id"), ["class_name"], "id")


@query("snk_05_insert_or_ignore", "SELECT DISTINCT caller_id, callee_id FROM calls")
def insert_or_ignore(m: Model) -> DataFrame:
    """Calls inserted into a table that holds a part of them: each pair of methods stays single."""
    pairs = m.calls.select("caller_id", "callee_id")
    held = m.calls.filter("call_type = 'direct'").select("caller_id", "callee_id").distinct()
    return sinks.insert_or_ignore(held, pairs, ["caller_id", "callee_id"])


@query("snk_06_delete_then_rebuild", """
    SELECT id, mod_id, patch_class FROM harmony_patches WHERE mod_id % 2 = 0 UNION ALL SELECT id, mod_id, 'rebuilt' FROM harmony_patches WHERE mod_id % 2 = 1""")  # fmt: skip
def delete_then_rebuild(m: Model) -> DataFrame:
    """Patches of changed mods (odd ids stand for them) are dropped and written anew, the rest stays."""
    old = m.harmony_patches.select("id", "mod_id", "patch_class")
    changed = m.mods.filter("id % 2 = 1").select(F.col("id").alias("mod_id"))
    fresh = old.join(changed, "mod_id", "left_semi").select("id", "mod_id", F.lit("rebuilt").alias("patch_class"))
    return sinks.rebuild(fresh, _path(m, "patches"), old, changed, ["mod_id"])


def _path(m: Model, name: str) -> str:
    import uuid

    return f"{shared_dir(m.spark)}/tables/{name}-{uuid.uuid4().hex}"


@query("snk_08_json_rows", "SELECT '{\"id\":' || id || ',\"name\":\"' || name || '\"' || CASE WHEN extends IS NULL THEN '' ELSE ',\"extends\":\"' || extends || '\"' END || '}' AS json FROM xml_definitions")
def json_rows(m: Model) -> DataFrame:
    """Definitions as JSON objects, nulls left out."""
    return sinks.as_json(m.xml_definitions.select("id", "name", "extends"))


@query("src_26_guarded_copy", "SELECT count(*) AS n, true AS first_copied, false AS same_copied, true AS changed_copied FROM methods")
def guarded_copy(m: Model) -> DataFrame:
    """A table copied, met again unchanged, then changed."""
    source, key = m.methods.select("id", "name", "signature"), ["id", "name", "signature"]
    first, made = sinks.copy_if_changed(source, None, _path(m, "methods"), key)
    _, again = sinks.copy_if_changed(source, first, _path(m, "methods"), key)
    changed = source.withColumn("signature", F.when(F.col("id") == 1, "()").otherwise(F.col("signature")))
    _, anew = sinks.copy_if_changed(changed, first, _path(m, "methods"), key)
    return first.agg(n().alias("n")).select("n", F.lit(made).alias("first_copied"), F.lit(again).alias("same_copied"), F.lit(anew).alias("changed_copied"))


@query("inc_10_stale_signatures", "SELECT me.id, me.name FROM methods me WHERE me.file_path IN (SELECT name || '.cs' FROM types WHERE assembly <> 'Asm0')")
def stale_signatures(m: Model) -> DataFrame:
    """Signatures whose file is still there; files of one assembly stand for those that are gone."""
    gone = m.types.filter("assembly = 'Asm0'").select(F.concat("name", F.lit(".cs")).alias("file_path"))
    return sinks.delete_by_file(m.methods, gone).select("id", "name")


@query("scl_25_times_as_text", "SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S') AS iso, strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') AS stored FROM orders")
def times_as_text(m: Model) -> DataFrame:
    """Times as ISO-8601 text and as they are stored."""
    at = F.col("o_orderdate")
    rows = m.spark.read.parquet(f"{m.sf_dir}/orders.parquet")
    return rows.select("o_orderkey", F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss").alias("iso"), F.date_format(at, "yyyy-MM-dd HH:mm:ss").alias("stored"))
