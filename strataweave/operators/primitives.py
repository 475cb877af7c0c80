"""The relational primitives by themselves: sorts, limits, sets, grouped lists, outer joins."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as tx
from ..functions import types as ty
from ..model import Model, csv, n, query, total, with_mod


@query("jon_04_composite_key", "SELECT r.id, d.id AS target_id FROM xml_references r JOIN xml_definitions d ON r.target_name = d.name AND r.target_type = d.definition_type")
def composite_key(m: Model) -> DataFrame:
    defs = m.xml_definitions.select(F.col("id").alias("target_id"), F.col("name").alias("target_name"), F.col("definition_type").alias("target_type"))
    return m.xml_references.join(defs, ["target_name", "target_type"]).select("id", "target_id")


@query("jon_05_unordered_pairs", """
    SELECT a.xpath_hash, a.mod_id AS mod1, b.mod_id AS mod2, count(*) AS n FROM mod_xml_operations a JOIN mod_xml_operations b ON a.xpath_hash = b.xpath_hash AND a.mod_id < b.mod_id AND a.new_value <> b.new_value GROUP BY 1, 2, 3""")  # fmt: skip
def unordered_pairs(m: Model) -> DataFrame:
    """Pairs of mods with different values for one path."""
    # Equal rows are counted before the pairs are made, so that a hot path is quadratic in its values, not in its rows.
    sides = m.mod_xml_operations.groupBy("xpath_hash", "mod_id", "new_value").agg(n().alias("times"))
    a = sides.select("xpath_hash", F.col("mod_id").alias("mod1"), F.col("new_value").alias("v1"), F.col("times").alias("n1"))
    b = sides.select("xpath_hash", F.col("mod_id").alias("mod2"), F.col("new_value").alias("v2"), F.col("times").alias("n2"))
    return a.join(b, "xpath_hash").filter("mod1 < mod2 and v1 <> v2").groupBy("xpath_hash", "mod1", "mod2").agg(F.sum(F.col("n1") * F.col("n2")).alias("n"))


@query("jon_06_other_patches", "SELECT a.id, g.n - 1 AS others FROM harmony_patches a JOIN (SELECT target_class, target_method, count(*) AS n FROM harmony_patches GROUP BY 1, 2) g ON a.target_class = g.target_class AND a.target_method = g.target_method WHERE g.n > 1")
def other_patches(m: Model) -> DataFrame:
    """How many other patches share each patch's method: one window instead of a self-join."""
    w = Window.partitionBy("target_class", "target_method")
    return m.harmony_patches.select("id", (F.count(F.lit(1)).over(w) - 1).alias("others")).filter("others > 0")


@query("jon_12_removed_dependencies", """
    SELECT DISTINCT c.id, o.mod_id AS remover FROM csharp_deps c JOIN mod_xml_operations o ON o.target_name = c.dependency_name AND o.target_type = c.dependency_type WHERE o.operation = 'remove' AND o.mod_id <> c.mod_id""")  # fmt: skip
def removed_dependencies(m: Model) -> DataFrame:
    deps = m.csharp_deps.select("id", F.col("dependency_name").alias("target_name"), F.col("dependency_type").alias("target_type"), F.col("mod_id").alias("own"))
    gone = m.mod_xml_operations.filter("operation = 'remove'").select("target_name", "target_type", F.col("mod_id").alias("remover"))
    return deps.join(gone, ["target_name", "target_type"]).filter("own <> remover").select("id", "remover").distinct()


@query("agg_06_pivoted_counts", """
    SELECT mod_id, CAST(sum(CASE WHEN operation = 'set' THEN 1 ELSE 0 END) AS BIGINT) AS sets, CAST(sum(CASE WHEN operation = 'append' THEN 1 ELSE 0 END) AS BIGINT) AS appends, CAST(sum(CASE WHEN operation = 'remove' THEN 1 ELSE 0 END) AS BIGINT) AS removals FROM mod_xml_operations GROUP BY 1""")  # fmt: skip
def pivoted_counts(m: Model) -> DataFrame:
    op = F.col("operation")
    return m.mod_xml_operations.groupBy("mod_id").agg(total(op == "set").alias("sets"), total(op == "append").alias("appends"), total(op == "remove").alias("removals"))


@query("agg_07_joined_lists", "SELECT target_class, string_agg(DISTINCT target_method, '|' ORDER BY target_method) AS methods, string_agg(DISTINCT patch_type, ', ' ORDER BY patch_type) AS kinds FROM harmony_patches GROUP BY 1")
def joined_lists(m: Model) -> DataFrame:
    return m.harmony_patches.groupBy("target_class").agg(csv(F.col("target_method"), "|").alias("methods"), csv(F.col("patch_type"), ", ").alias("kinds"))


@query("agg_08_composite_lists", "SELECT o.target_name, string_agg(DISTINCT m.name || '=' || coalesce(o.new_value, '?'), ',' ORDER BY m.name || '=' || coalesce(o.new_value, '?')) AS entries FROM mod_xml_operations o JOIN mods m ON o.mod_id = m.id GROUP BY 1")
def composite_lists(m: Model) -> DataFrame:
    rows = with_mod(m, m.mod_xml_operations, mod="name")
    return rows.groupBy("target_name").agg(csv(F.concat("mod", F.lit("="), F.coalesce("new_value", F.lit("?")))).alias("entries"))


@query("agg_09_having", "SELECT target_name, count(DISTINCT mod_id) AS mod_count FROM mod_xml_operations GROUP BY 1 HAVING count(DISTINCT mod_id) > 5")
def having(m: Model) -> DataFrame:
    return m.mod_xml_operations.groupBy("target_name").agg(F.countDistinct("mod_id").alias("mod_count")).filter("mod_count > 5")


@query("agg_10_greatest_load_order", "SELECT o.xpath_hash, max(m.load_order) AS top FROM mod_xml_operations o JOIN mods m ON o.mod_id = m.id GROUP BY 1")
def greatest_load_order(m: Model) -> DataFrame:
    return with_mod(m, m.mod_xml_operations, load_order="load_order").groupBy("xpath_hash").agg(F.max("load_order").alias("top"))


@query("agg_11_bare_columns", "SELECT xpath_hash, min(target_type) AS target_type, min(target_name) AS target_name FROM mod_xml_operations GROUP BY 1")
def bare_columns(m: Model) -> DataFrame:
    return m.mod_xml_operations.groupBy("xpath_hash").agg(F.min("target_type").alias("target_type"), F.min("target_name").alias("target_name"))


@query("agg_12_distinct_tuples", "SELECT DISTINCT mod_id, operation, target_type FROM mod_xml_operations")
def distinct_tuples(m: Model) -> DataFrame:
    return m.mod_xml_operations.select("mod_id", "operation", "target_type").distinct()


@query("agg_17_weighted_severity", "SELECT class_name, CAST(sum(CASE severity WHEN 'BUG' THEN 40 WHEN 'WARNING' THEN 25 WHEN 'INFO' THEN 10 ELSE 0 END) AS BIGINT) AS weight FROM game_code_analysis GROUP BY 1")
def weighted_severity(m: Model) -> DataFrame:
    s = F.col("severity")
    return m.game_code_analysis.groupBy("class_name").agg(F.sum(F.when(s == "BUG", 40).when(s == "WARNING", 25).when(s == "INFO", 10).otherwise(0)).alias("weight"))


@query("srt_01_multi_key_sort", "SELECT definition_type, name FROM xml_definitions ORDER BY definition_type DESC, name")
def multi_key_sort(m: Model) -> DataFrame:
    return m.xml_definitions.select("definition_type", "name").orderBy(F.desc("definition_type"), "name")


@query("srt_03_top_k", "SELECT callee_id, count(*) AS n FROM calls GROUP BY 1 ORDER BY n DESC, callee_id LIMIT 25")
def top_k(m: Model) -> DataFrame:
    return m.calls.groupBy("callee_id").agg(n().alias("n")).orderBy(F.desc("n"), "callee_id").limit(25)


@query("srt_05_sort_by_subquery", "SELECT d.id, (SELECT count(*) FROM xml_references r WHERE r.source_def_id = d.id) AS refs FROM xml_definitions d ORDER BY refs DESC, d.id")
def sort_by_count(m: Model) -> DataFrame:
    refs = m.xml_references.groupBy(F.col("source_def_id").alias("id")).agg(n().alias("refs"))
    rows = m.xml_definitions.select("id").join(refs, "id", "left").select("id", F.coalesce("refs", F.lit(0).cast("long")).alias("refs"))
    return rows.orderBy(F.desc("refs"), "id")


@query("set_01_union_all", "SELECT caller_id, 'inner' AS kind FROM calls UNION ALL SELECT caller_id, 'outer' FROM external_calls")
def union_all(m: Model) -> DataFrame:
    return m.calls.select("caller_id", F.lit("inner").alias("kind")).unionByName(m.external_calls.select("caller_id", F.lit("outer").alias("kind")))


@query("set_03_set_difference", "SELECT lower(file_path) AS path FROM current_hashes EXCEPT SELECT lower(file_path) FROM stored_hashes")
def set_difference(m: Model) -> DataFrame:
    return m.current_hashes.select(F.lower("file_path").alias("path")).subtract(m.stored_hashes.select(F.lower("file_path").alias("path")))


@query("snk_02_upserted_hashes", """
    SELECT lower(file_path) AS file_path, content_hash FROM current_hashes UNION ALL SELECT lower(file_path), content_hash FROM stored_hashes WHERE lower(file_path) NOT IN (SELECT lower(file_path) FROM current_hashes)""")  # fmt: skip
def upserted_hashes(m: Model) -> DataFrame:
    from ..sources.sinks import upsert

    low = lambda rows: rows.select(F.lower("file_path").alias("file_path"), "content_hash")
    return upsert(low(m.stored_hashes), low(m.current_hashes), ["file_path"])


@query("snk_07_deleted_by_file", "SELECT id FROM xml_definitions WHERE file_path NOT IN ('brand1.xml', 'brand2.xml')")
def deleted_by_file(m: Model) -> DataFrame:
    from ..sources.sinks import delete_by_file

    paths = m.spark.createDataFrame([("brand1.xml",), ("brand2.xml",)], "file_path string")
    return delete_by_file(m.xml_definitions, paths).select("id")


@query("scl_14_token_similarity")
def token_similarities(m: Model) -> DataFrame:
    """How well the tokens of each name find a match in the name it extends."""
    e = m.xml_definitions.select(F.col("name").alias("extends"), "definition_type")
    rows = m.xml_definitions.join(e, ["extends", "definition_type"])
    return rows.select("id", F.round(tx.token_similarity(tx.name_tokens(F.col("name")), tx.name_tokens(F.col("extends"))), 6).alias("similarity"))


@query("scl_20_resolved_types", """
    SELECT id, CASE json_extract_string(target_arg_types, '$[0]') WHEN 'int' THEN 'System.Int32' END AS first_type, CAST(json_array_length(target_arg_types) AS BIGINT) AS n FROM harmony_patches""")  # fmt: skip
def resolved_types(m: Model) -> DataFrame:
    """Full names of patched parameter types."""
    names = F.from_json("target_arg_types", "array<string>")
    return m.harmony_patches.select("id", ty.resolved(F.get(names, F.lit(0))).alias("first_type"), F.size(names).cast("long").alias("n"))


@query("cod_36_overload_matches", "SELECT a.id, g.n - 1 AS same_overload FROM harmony_patches a JOIN (SELECT target_class, target_method, target_arg_types, count(*) AS n FROM harmony_patches GROUP BY 1, 2, 3) g USING (target_class, target_method, target_arg_types) WHERE g.n > 1")
def overload_matches(m: Model) -> DataFrame:
    """How many other patches aim at the same overload."""
    w = Window.partitionBy("target_class", "target_method", "target_arg_types")
    return m.harmony_patches.select("id", (F.count(F.lit(1)).over(w) - 1).alias("same_overload")).filter("same_overload > 0")
