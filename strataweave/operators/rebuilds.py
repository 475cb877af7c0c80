"""What has to be done again when something changed: files, mods and the enrichment of findings."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..model import Model, n, query
from ..session import shared_dir
from ..sources import xml_config
from ..sources.versions import Manifest
from ..streaming.file_tables import FileTables

_DOCUMENT = """SELECT p_partkey AS k, p_size AS z, CASE WHEN p_partkey % 9 = 0 THEN 'gone' WHEN p_partkey % 10 = 3 THEN 'new' WHEN p_partkey % 4 = 1 THEN 'changed' ELSE 'same' END AS state FROM part"""


def _documents(m: Model, size: Column) -> DataFrame:
    k = F.col("p_partkey").cast("string")
    items = F.concat(F.lit('<items>\n<item name="i'), k, F.lit('"><property name="Size" value="'), size.cast("string"), F.lit('"/></item>\n<item name="j'), k, F.lit('"/>\n</items>'))
    return m.spark.read.parquet(f"{m.sf_dir}/part.parquet").select("p_partkey", F.concat(F.lit("F"), k, F.lit(".xml")).alias("path"), items.alias("content"))


def _tables(m: Model) -> FileTables:
    """Three batches: most files; some new, changed or deleted; the second once more."""
    tables = FileTables(m.spark, f"{shared_dir(m.spark)}/file-tables/{uuid.uuid4().hex}")
    key = F.col("p_partkey")
    tables.apply(0, _documents(m, F.col("p_size")).filter(key % 10 != 3))
    changed = _documents(m, F.col("p_size") + 100).withColumn("deleted", key % 9 == 0).withColumn("path", F.lower("path"))
    second = changed.filter((key % 9 == 0) | (key % 10 == 3) | (key % 4 == 1))
    tables.apply(1, second)
    assert tables.apply(1, second.limit(0)) is None  # a batch that comes again
    return tables


@query("inc_04_rebuilt_definitions", f"""
    WITH d AS ({_DOCUMENT}), f AS (SELECT *, CASE WHEN state = 'same' THEN 'F' ELSE 'f' END || CAST(k AS VARCHAR) || '.xml' AS path FROM d WHERE state <> 'gone')
    SELECT row_number() OVER (ORDER BY path, line) AS id, path AS file_path, name || CAST(k AS VARCHAR) AS name, line AS line_number, size FROM (
      SELECT path, k, 'i' AS name, 2 AS line, CAST(z + CASE WHEN state = 'same' THEN 0 ELSE 100 END AS VARCHAR) AS size FROM f UNION ALL SELECT path, k, 'j', 3, NULL FROM f) t""")  # fmt: skip
def rebuilt_definitions(m: Model) -> DataFrame:
    """Definitions after files changed, came and went: as if all had been read anew."""
    rows = _tables(m).rows()
    defs = xml_config.definitions(rows)
    size = xml_config.properties(rows, defs).select(F.col("definition_id").alias("id"), F.col("property_value").alias("size"))
    return defs.join(size, "id", "left").select("id", "file_path", "name", F.col("line_number").cast("int").alias("line_number"), "size")


@query("inc_04_file_versions", f"""
    SELECT lower('F' || CAST(k AS VARCHAR) || '.xml') AS key, CASE WHEN state = 'same' THEN 0 ELSE 1 END AS batch FROM ({_DOCUMENT}) d WHERE state <> 'gone'""")  # fmt: skip
def file_versions(m: Model) -> DataFrame:
    """Which batch holds the rows of each file that is there."""
    return _tables(m).files().select("key", F.col("batch").cast("int").alias("batch"))


def order_free(rows: DataFrame, key: list[str], of: Column, name: str) -> DataFrame:
    """key -> the sum of the first 48 bits of SHA-256 of ``of`` over its rows, and how many: equal for equal sets of rows in any order,
    summed before the shuffle, so that a large group is no single string."""
    number = F.conv(F.substring(F.sha2(of.cast("binary"), 256), 1, 12), 16, 10).cast("decimal(38,0)")
    return rows.groupBy(*key).agg(F.concat_ws(":", F.sum(number).cast("string"), n().cast("string")).alias(name))


_MOD_SQL = """SELECT mod_id, CAST(sum(CAST(('0x' || substr(sha256(xpath_hash || operation || coalesce(new_value, '') || {more}), 1, 12)) AS HUGEINT)) AS VARCHAR) || ':' || CAST(count(*) AS VARCHAR) AS mod_hash FROM mod_xml_operations GROUP BY 1"""


@query("inc_05_mod_rebuild", "WITH now AS (" + _MOD_SQL.format(more="''") + """)
    SELECT now.mod_id, mod_hash, CASE WHEN now.mod_id % 3 = 0 AND EXISTS (SELECT 1 FROM mod_xml_operations o WHERE o.mod_id = now.mod_id AND o.operation = 'set') THEN 'rebuild' WHEN now.mod_id % 7 = 0 THEN 'new' ELSE 'load order only' END AS action FROM now""")  # fmt: skip
def mod_rebuild(m: Model) -> DataFrame:
    """One hash over all changes of a mod decides whether it is analysed again or only moved in the load order; before, some mods
    set other values, and some weren't there."""
    ops = m.mod_xml_operations
    value = F.coalesce("new_value", F.lit(""))
    old = ops.filter(~((F.col("mod_id") % 7 == 0) & (F.col("mod_id") % 3 != 0))).withColumn("new_value", F.when((F.col("mod_id") % 3 == 0) & (F.col("operation") == "set"), F.concat(value, F.lit("x"))).otherwise(F.col("new_value")))
    seal = lambda rows, name: order_free(rows, ["mod_id"], F.concat("xpath_hash", "operation", value), name)
    both = seal(ops, "mod_hash").join(seal(old, "was"), "mod_id", "left")
    action = F.when(F.col("was").isNull(), "new").when(F.col("was") != F.col("mod_hash"), "rebuild").otherwise("load order only")
    return both.select("mod_id", "mod_hash", action.alias("action"))


def finding_keys(m: Model) -> DataFrame:
    """id, key: a hash of each finding and of all that its enrichment reads: calls of methods of its name, patches of its class,
    changes that name it. The parts are summed where they lie and joined along the edges, so any change below changes the key."""
    g = m.game_code_analysis
    methods = m.methods.select(F.col("id").alias("callee_id"), F.col("name").alias("method_name"))
    calls = order_free(m.calls.join(methods, "callee_id"), ["method_name"], F.concat_ws("|", "caller_id", "callee_id", "call_type"), "calls")
    patches = order_free(m.harmony_patches, ["target_class"], F.concat_ws("|", "mod_id", "target_method", "patch_type"), "patches").withColumnRenamed("target_class", "class_name")
    changes = order_free(m.mod_xml_operations.filter("target_name is not null"), ["target_name"], F.concat_ws("|", "mod_id", "xpath_hash", "operation", "new_value"), "changes").withColumnRenamed("target_name", "class_name")
    rows = g.join(calls, "method_name", "left").join(patches, "class_name", "left").join(changes, "class_name", "left")
    own = F.concat_ws("\x01", *(F.coalesce(F.col(c).cast("string"), F.lit("\x02")) for c in (*g.columns, "calls", "patches", "changes")))
    return rows.select("id", F.sha2(own.cast("binary"), 256).alias("key"))


class EnrichmentCache:
    """Enrichment of findings (id, key, json) on disk; one version at a time is read."""

    SCHEMA = "id long, key string, json string"

    def __init__(self, spark, path: str):
        self.manifest = Manifest(spark, path, "n long")

    def all(self) -> DataFrame:
        return self.manifest.table("rows", self.SCHEMA)

    def get(self, ids: DataFrame) -> DataFrame:
        """Cached rows of the findings in ``ids`` (id)."""
        return self.all().join(ids.select("id").distinct(), "id", "left_semi")

    def put(self, rows: DataFrame, keep: DataFrame | None = None) -> None:
        """``rows`` (id, key, json) over what is held; with ``keep`` (id) only these findings stay."""
        old = self.all().join(rows.select("id"), "id", "left_anti")
        old = old if keep is None else old.join(keep.select("id"), "id", "left_semi")
        last = self.manifest.latest()
        version = last["version"] + 1 if last else 1
        written = self.manifest.write("rows", version, old.select("id", "key", "json").unionByName(rows.select("id", "key", "json")))
        self.manifest.commit(version, written.count())

    def bulk(self, m: Model, enrich) -> DataFrame:
        """Bring all findings up to date: ``enrich(m, ids)`` (id -> id, json) is asked for those only whose key is not held. Their ids."""
        keys = finding_keys(m)
        last = self.manifest.latest()
        version = last["version"] + 1 if last else 1
        missing = self.manifest.write("missing", version, keys.join(self.all().select("id", "key"), ["id", "key"], "left_anti"))
        self.put(enrich(m, missing.select("id")).join(missing, "id").select("id", "key", "json"), keys)
        return missing.select("id")


@query("inc_08_enrichment_cache", """
    WITH changed AS (
      SELECT g.id, 'method' AS why FROM game_code_analysis g WHERE EXISTS (SELECT 1 FROM calls c JOIN methods me ON me.id = c.callee_id WHERE me.name = g.method_name AND c.caller_id % 50 = 0)
      UNION ALL SELECT g.id, 'severity' FROM game_code_analysis g WHERE g.id % 40 = 7 AND g.severity <> 'BUG')
    SELECT 1 AS step, 'recomputed' AS what, count(*) AS n FROM game_code_analysis UNION ALL SELECT 2, 'recomputed', 0
    UNION ALL SELECT 3, 'recomputed', count(DISTINCT id) FROM changed WHERE id % 13 <> 0 UNION ALL SELECT 4, 'held', count(*) FROM game_code_analysis WHERE id % 13 <> 0""")  # fmt: skip
def cached_enrichment(m: Model) -> DataFrame:
    """Findings enriched at first, again with nothing changed, and with calls and severities changed and some findings gone."""
    cache = EnrichmentCache(m.spark, f"{shared_dir(m.spark)}/enrichment/{uuid.uuid4().hex}")
    usage = lambda model, ids: model.game_code_analysis.join(ids, "id", "left_semi").select("id", F.to_json(F.struct("method_name", "severity")).alias("json"))
    step = lambda k, what, rows: rows.agg(n().cast("long").alias("n")).select(F.lit(k).alias("step"), F.lit(what).alias("what"), "n")
    out = [step(1, "recomputed", cache.bulk(m, usage)), step(2, "recomputed", cache.bulk(m, usage))]
    severity = F.when(F.col("id") % 40 == 7, "BUG").otherwise(F.col("severity")).alias("severity")
    tables = {t: getattr(m, t) for t in ("methods", "harmony_patches", "mod_xml_operations")}
    findings = m.game_code_analysis.filter("id % 13 <> 0").withColumn("severity", severity)
    later = Model(m.spark, tables=tables | {"calls": m.calls.filter("caller_id % 50 <> 0"), "game_code_analysis": findings})
    out += [step(3, "recomputed", cache.bulk(later, usage)), step(4, "held", cache.all())]
    return out[0].unionByName(out[1]).unionByName(out[2]).unionByName(out[3])
