"""Lookups and joins behind the commands: lists, searches, references, callers and callees."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..model import Model, n, query


@query("flt_01_list_by_type", "SELECT id, name, file_path, line_number FROM xml_definitions WHERE definition_type = 'item' ORDER BY name, id")
def list_by_type(m: Model, kind: str = "item") -> DataFrame:
    return m.xml_definitions.filter(F.col("definition_type") == kind).select("id", "name", "file_path", "line_number").orderBy("name", "id")


@query("flt_02_search", "SELECT definition_type, name, file_path FROM xml_definitions WHERE name ILIKE '%red%' ORDER BY definition_type, name LIMIT 100")
def search(m: Model, pattern: str = "red", limit: int = 100) -> DataFrame:
    """Names that contain a text, in any case; the first hundred by type and name."""
    return m.xml_definitions.filter(F.lower("name").contains(pattern.lower())).select("definition_type", "name", "file_path").orderBy("definition_type", "name").limit(limit)


@query("flt_03_references_to", """
    SELECT r.id, r.source_type, d.name AS source_name, r.reference_context, r.file_path, r.line_number, r.target_name FROM xml_references r JOIN xml_definitions d ON r.source_def_id = d.id WHERE r.target_type = 'buff'""")  # fmt: skip
def references_to(m: Model, kind: str = "buff", name: str | None = None) -> DataFrame:
    """References to entities of a type (and name), with their sources."""
    refs = m.xml_references.filter(F.col("target_type") == kind)
    refs = refs if name is None else refs.filter(F.col("target_name") == name)
    sources = m.xml_definitions.select(F.col("id").alias("source_def_id"), F.col("name").alias("source_name"))
    return refs.join(sources, "source_def_id").select("id", "source_type", "source_name", "reference_context", "file_path", "line_number", "target_name")


@query("flt_04_resolve_methods", """
    SELECT me.id, t.full_name || '.' || me.name AS full_name, me.signature, me.file_path, me.line_number FROM methods me JOIN types t ON me.type_id = t.id
    WHERE me.name = 'Update' AND (t.name = 'Type3' OR t.full_name = 'Type3' OR t.name ILIKE '%Type3')""")  # fmt: skip
def resolve_methods(m: Model, name: str = "Type3.Update") -> DataFrame:
    """Methods that ``Type.Method`` or a bare method name may mean."""
    owner, _, method = name.rpartition(".")
    types = m.types.select(F.col("id").alias("type_id"), F.col("name").alias("type_name"), F.col("full_name").alias("type_full"))
    rows = m.methods.filter(F.col("name") == method).join(types, "type_id")
    if owner:
        rows = rows.filter((F.col("type_name") == owner) | (F.col("type_full") == owner) | F.lower("type_name").endswith(owner.lower()))
    return rows.select("id", F.concat_ws(".", "type_full", "name").alias("full_name"), "signature", "file_path", "line_number")


@query("flt_05_ambiguous_names", "SELECT name, count(*) AS matches, count(*) > 1 AS ambiguous FROM methods GROUP BY 1")
def ambiguous_names(m: Model) -> DataFrame:
    """Bare names that stand for more than one method."""
    return m.methods.groupBy("name").agg(n().alias("matches")).withColumn("ambiguous", F.col("matches") > 1)


@query("flt_07_like_rules", """
    SELECT id, name ILIKE 'player%' OR name ILIKE 'zombie%' AS living, name ILIKE '%red%' AS has_red, name ILIKE '%_1' AS ends_one FROM xml_definitions""")  # fmt: skip
def like_rules(m: Model) -> DataFrame:
    """Prefix, contains and suffix rules, blind to case; an underscore stands for any character."""
    name = F.col("name")
    return m.xml_definitions.select("id", (name.ilike("player%") | name.ilike("zombie%")).alias("living"), name.ilike("%red%").alias("has_red"), name.ilike("%_1").alias("ends_one"))


@query("flt_08_in_lists", "SELECT id, operation IN ('set', 'append') AS edits, operation NOT IN ('remove', 'removeattribute') AS keeps FROM mod_xml_operations")
def in_lists(m: Model) -> DataFrame:
    op = F.col("operation")
    return m.mod_xml_operations.select("id", op.isin("set", "append").alias("edits"), (~op.isin("remove", "removeattribute")).alias("keeps"))


@query("flt_10_removed_and_touched", """
    SELECT DISTINCT target_type, target_name FROM mod_xml_operations o WHERE o.operation = 'remove' AND EXISTS (SELECT 1 FROM mod_xml_operations x WHERE x.target_type = o.target_type AND x.target_name = o.target_name AND x.mod_id <> o.mod_id AND x.operation <> 'remove')""")  # fmt: skip
def removed_and_touched(m: Model) -> DataFrame:
    """Entities that one mod removes and another touches: a pre-aggregation instead of a correlated search."""
    removal = F.col("operation") == "remove"
    key = ["target_type", "target_name"]
    per = m.mod_xml_operations.groupBy(*key).agg(F.collect_set(F.when(removal, F.col("mod_id"))).alias("removers"), F.collect_set(F.when(~removal, F.col("mod_id"))).alias("others"))
    lone = (F.size("removers") == 1) & (F.size("others") == 1) & (F.get("removers", F.lit(0)) == F.get("others", F.lit(0)))
    return per.filter((F.size("removers") > 0) & (F.size("others") > 0) & ~lone).select(*key)


@query("flt_11_without_reference", "SELECT d.id, d.name FROM xml_definitions d LEFT JOIN xml_references r ON r.target_name = d.name AND r.target_type = d.definition_type WHERE r.id IS NULL")
def without_reference(m: Model) -> DataFrame:
    """Definitions that nothing refers to."""
    refs = m.xml_references.select(F.col("target_name").alias("name"), F.col("target_type").alias("definition_type"))
    return m.xml_definitions.join(refs, ["name", "definition_type"], "left_anti").select("id", "name")


@query("flt_12_null_tests", "SELECT id, property_name IS NOT NULL AS has_property, coalesce(new_value, '') AS value, property_name IS NOT DISTINCT FROM 'prop1' AS is_first FROM mod_xml_operations")
def null_tests(m: Model) -> DataFrame:
    prop = F.col("property_name")
    return m.mod_xml_operations.select("id", prop.isNotNull().alias("has_property"), F.coalesce("new_value", F.lit("")).alias("value"), prop.eqNullSafe("prop1").alias("is_first"))


@query("flt_13_mod_details", """
    SELECT m.name AS mod, 'xml' AS kind, o.operation AS what, o.target_name AS target, o.line_number FROM mods m JOIN mod_xml_operations o ON o.mod_id = m.id WHERE m.name ILIKE '%1%'
    UNION ALL SELECT m.name, 'code', c.dependency_type, c.dependency_name, c.line_number FROM mods m JOIN csharp_deps c ON c.mod_id = m.id WHERE m.name ILIKE '%1%'""")  # fmt: skip
def mod_details(m: Model, pattern: str = "%1%") -> DataFrame:
    """What the mods of a name change and need."""
    mods = m.mods.filter(F.col("name").ilike(pattern)).select(F.col("id").alias("mod_id"), F.col("name").alias("mod"))
    ops = m.mod_xml_operations.select("mod_id", F.lit("xml").alias("kind"), F.col("operation").alias("what"), F.col("target_name").alias("target"), "line_number")
    deps = m.csharp_deps.select("mod_id", F.lit("code").alias("kind"), F.col("dependency_type").alias("what"), F.col("dependency_name").alias("target"), "line_number")
    return ops.unionByName(deps).join(mods, "mod_id").drop("mod_id")


@query("flt_14_definition_properties", """
    SELECT d.name, p.property_name, p.property_value, coalesce(p.property_class, '') AS property_class FROM xml_definitions d JOIN xml_properties p ON p.definition_id = d.id """)  # fmt: skip
def definition_properties(m: Model, condition: str = "true") -> DataFrame:
    defs = m.xml_definitions.filter(condition).select(F.col("id").alias("definition_id"), "name")
    return m.xml_properties.join(defs, "definition_id").select("name", "property_name", "property_value", F.coalesce("property_class", F.lit("")).alias("property_class"))


def _named_methods(m: Model, id_as: str, name_as: str) -> DataFrame:
    types = m.types.select(F.col("id").alias("type_id"), F.col("name").alias("__type"))
    return m.methods.join(types, "type_id").select(F.col("id").alias(id_as), F.concat_ws(".", "__type", "name").alias(name_as))


@query("jon_01_named_calls", """
    SELECT ta.name || '.' || a.name AS caller, tb.name || '.' || b.name AS callee, c.line_number, c.call_type FROM calls c JOIN methods a ON c.caller_id = a.id JOIN types ta ON a.type_id = ta.id
    JOIN methods b ON c.callee_id = b.id JOIN types tb ON b.type_id = tb.id""")  # fmt: skip
def named_calls(m: Model) -> DataFrame:
    """All call edges by name."""
    return m.calls.join(_named_methods(m, "caller_id", "caller"), "caller_id").join(_named_methods(m, "callee_id", "callee"), "callee_id").select("caller", "callee", "line_number", "call_type")


@query("jon_02_callers", """
    SELECT DISTINCT t.name || '.' || me.name AS caller, c.line_number FROM calls c JOIN methods me ON c.caller_id = me.id JOIN types t ON me.type_id = t.id WHERE c.callee_id = 5 ORDER BY 1, 2 LIMIT 50""")  # fmt: skip
def callers(m: Model, method_id: int = 5, limit: int = 50) -> DataFrame:
    return m.calls.filter(F.col("callee_id") == method_id).join(_named_methods(m, "caller_id", "caller"), "caller_id").select("caller", "line_number").distinct().orderBy("caller", "line_number").limit(limit)


@query("jon_03_callees", """
    SELECT 'internal' AS kind, t.name || '.' || me.name AS callee, c.line_number FROM calls c JOIN methods me ON c.callee_id = me.id JOIN types t ON me.type_id = t.id 
    UNION ALL SELECT 'external', target_type || '.' || target_method, line_number FROM external_calls""")  # fmt: skip
def callees(m: Model, condition: str = "true") -> DataFrame:
    """What the chosen methods call, inside and outside."""
    inner = m.calls.filter(condition).join(_named_methods(m, "callee_id", "callee"), "callee_id").select(F.lit("internal").alias("kind"), "callee", "line_number")
    outer = m.external_calls.filter(condition).select(F.lit("external").alias("kind"), F.concat_ws(".", "target_type", "target_method").alias("callee"), "line_number")
    return inner.unionByName(outer)


@query("jon_08_operations_per_mod", "SELECT m.name, count(o.id) AS operations FROM mods m LEFT JOIN mod_xml_operations o ON o.mod_id = m.id GROUP BY 1")
def operations_per_mod(m: Model) -> DataFrame:
    """Operations of each mod, mods without any included; counted before the join."""
    counts = m.mod_xml_operations.groupBy(F.col("mod_id").alias("id")).agg(n().alias("operations"))
    return m.mods.join(counts, "id", "left").select("name", F.coalesce("operations", F.lit(0).cast("long")).alias("operations"))


@query("jon_09_degrees", """
    SELECT d.id, coalesce(o.n, 0) AS out_degree, coalesce(i.n, 0) AS in_degree FROM xml_definitions d LEFT JOIN (SELECT source_def_id AS id, count(*) AS n FROM xml_references GROUP BY 1) o ON o.id = d.id
    LEFT JOIN (SELECT target_type, target_name, count(*) AS n FROM xml_references GROUP BY 1, 2) i ON i.target_type = d.definition_type AND i.target_name = d.name""")  # fmt: skip
def degrees(m: Model) -> DataFrame:
    """References out of and into each entity."""
    zero = F.lit(0).cast("long")
    out = m.xml_references.groupBy(F.col("source_def_id").alias("id")).agg(n().alias("out_degree"))
    into = m.xml_references.groupBy(F.col("target_type").alias("definition_type"), F.col("target_name").alias("name")).agg(n().alias("in_degree"))
    rows = m.xml_definitions.join(out, "id", "left").join(into, ["definition_type", "name"], "left")
    return rows.select("id", F.coalesce("out_degree", zero).alias("out_degree"), F.coalesce("in_degree", zero).alias("in_degree"))


@query("jon_10_type_suffix_join", "SELECT p.id AS patch_id, t.id AS type_id FROM harmony_patches p JOIN types t ON t.name ILIKE '%' || replace(p.target_class, 'Class', 'Type')")
def type_suffix_join(m: Model) -> DataFrame:
    """Types whose name ends in a patch's class name; distinct class names are matched with the few types first."""
    wanted = m.harmony_patches.select("target_class").distinct().withColumn("tail", F.lower(F.regexp_replace("target_class", "Class", "Type")))
    pairs = wanted.join(m.types.select(F.col("id").alias("type_id"), F.lower("name").alias("__name")), F.col("__name").endswith(F.col("tail")))
    return m.harmony_patches.join(pairs, "target_class").select(F.col("id").alias("patch_id"), "type_id")


@query("jon_11_delegating_overloads", """
    SELECT DISTINCT a.id AS method_id, b.id AS delegate_id FROM methods a JOIN calls c ON c.caller_id = a.id JOIN methods b ON b.id = c.callee_id AND b.name = a.name AND b.id <> a.id""")  # fmt: skip
def delegating_overloads(m: Model) -> DataFrame:
    """Methods that call another method of their own name."""
    a = m.methods.select(F.col("id").alias("caller_id"), F.col("name").alias("a"))
    b = m.methods.select(F.col("id").alias("callee_id"), F.col("name").alias("b"))
    rows = m.calls.select("caller_id", "callee_id").distinct().join(a, "caller_id").join(b, "callee_id")
    return rows.filter("a = b and caller_id <> callee_id").select(F.col("caller_id").alias("method_id"), F.col("callee_id").alias("delegate_id"))


@query("jon_15_case_blind_lookup", """
    SELECT c.id, min(d.id) AS entity_id FROM csharp_deps c JOIN xml_definitions d ON lower(d.name) = lower(c.dependency_name) GROUP BY c.id""")  # fmt: skip
def case_blind_lookup(m: Model) -> DataFrame:
    """The entity a code dependency names, whatever its case; of several the least id."""
    names = m.xml_definitions.groupBy(F.lower("name").alias("k")).agg(F.min("id").alias("entity_id"))
    return m.csharp_deps.select("id", F.lower("dependency_name").alias("k")).join(names, "k").select("id", "entity_id")


@query("jon_13_patch_call_operations", """
    SELECT DISTINCT p.id AS patch_id, o.id AS operation_id, CASE WHEN o.operation = 'remove' THEN 'HIGH' ELSE 'MEDIUM' END AS severity FROM harmony_patches p JOIN csharp_deps c ON c.mod_id = p.mod_id
    JOIN mod_xml_operations o ON o.target_name = c.dependency_name AND o.mod_id <> p.mod_id WHERE o.operation IN ('remove', 'set') AND p.returns_bool""")  # fmt: skip
def patch_call_operations(m: Model) -> DataFrame:
    """Patches of a mod whose code needs an entity that another mod sets or removes."""
    patches = m.harmony_patches.filter("returns_bool").select(F.col("id").alias("patch_id"), F.col("mod_id").alias("p"))
    deps = m.csharp_deps.select(F.col("mod_id").alias("p"), F.col("dependency_name").alias("target_name")).distinct()
    ops = m.mod_xml_operations.filter("operation in ('remove', 'set')").select(F.col("id").alias("operation_id"), "target_name", F.col("mod_id").alias("o"), F.when(F.col("operation") == "remove", "HIGH").otherwise("MEDIUM").alias("severity"))
    return patches.join(deps, "p").join(ops, "target_name").filter("p <> o").select("patch_id", "operation_id", "severity").distinct()


@query("agg_01_table_counts", """
    SELECT 'types' AS what, count(*) AS n FROM types UNION ALL SELECT 'methods', count(*) FROM methods UNION ALL SELECT 'calls', count(*) FROM calls UNION ALL SELECT 'external_calls', count(*) FROM external_calls
    UNION ALL SELECT 'xml_definitions', count(*) FROM xml_definitions UNION ALL SELECT 'mods', count(*) FROM mods""")  # fmt: skip
def table_counts(m: Model) -> DataFrame:
    out = None
    for name in ("types", "methods", "calls", "external_calls", "xml_definitions", "mods"):
        part = getattr(m, name).agg(n().alias("n")).select(F.lit(name).alias("what"), "n")
        out = part if out is None else out.unionByName(part)
    return out


@query("agg_02_group_counts", "SELECT operation AS k, count(*) AS n FROM mod_xml_operations GROUP BY 1 ORDER BY n DESC, k")
def group_counts(m: Model) -> DataFrame:
    return m.mod_xml_operations.groupBy(F.col("operation").alias("k")).agg(n().alias("n")).orderBy(F.desc("n"), "k")


@query("agg_03_top_external_targets", "SELECT target_type || '.' || target_method AS target, count(*) AS n FROM external_calls GROUP BY 1 ORDER BY n DESC, target LIMIT 10")
def top_external_targets(m: Model) -> DataFrame:
    return m.external_calls.groupBy(F.concat_ws(".", "target_type", "target_method").alias("target")).agg(n().alias("n")).orderBy(F.desc("n"), "target").limit(10)


@query("agg_04_distinct_counts", "SELECT count(DISTINCT mod_id) AS mods, count(DISTINCT target_name) AS targets, count(DISTINCT new_value) AS new_values FROM mod_xml_operations")
def distinct_counts(m: Model) -> DataFrame:
    return m.mod_xml_operations.agg(F.countDistinct("mod_id").alias("mods"), F.countDistinct("target_name").alias("targets"), F.countDistinct("new_value").alias("new_values"))


@query("agg_05_mods_by_operation", """
    SELECT target_type, count(DISTINCT CASE WHEN operation = 'set' THEN mod_id END) AS setting, count(DISTINCT CASE WHEN operation = 'remove' THEN mod_id END) AS removing FROM mod_xml_operations GROUP BY 1""")  # fmt: skip
def mods_by_operation(m: Model) -> DataFrame:
    of = lambda op: F.countDistinct(F.when(F.col("operation") == op, F.col("mod_id")))
    return m.mod_xml_operations.groupBy("target_type").agg(of("set").alias("setting"), of("remove").alias("removing"))


@query("agg_13_patches_per_mod", "SELECT m.name, (SELECT count(*) FROM harmony_patches p WHERE p.mod_id = m.id) AS patches FROM mods m")
def patches_per_mod(m: Model) -> DataFrame:
    counts = m.harmony_patches.groupBy(F.col("mod_id").alias("id")).agg(n().alias("patches"))
    return m.mods.join(counts, "id", "left").select("name", F.coalesce("patches", F.lit(0).cast("long")).alias("patches"))


@query("agg_14_call_stats", "SELECT count(*) AS total, count(DISTINCT callee_id) AS targets, count(DISTINCT caller_id) AS sources FROM calls")
def call_stats(m: Model) -> DataFrame:
    return m.calls.agg(n().alias("total"), F.countDistinct("callee_id").alias("targets"), F.countDistinct("caller_id").alias("sources"))


@query("agg_18_caller_categories", """
    SELECT CASE WHEN t.assembly = 'Asm0' THEN 'core' WHEN me.name IN ('Update', 'LateUpdate') THEN 'engine' WHEN t.base_type IS NULL THEN 'root' ELSE 'other' END AS category, count(*) AS n
    FROM calls c JOIN methods me ON c.caller_id = me.id JOIN types t ON me.type_id = t.id GROUP BY 1""")  # fmt: skip
def caller_categories(m: Model) -> DataFrame:
    types = m.types.select(F.col("id").alias("type_id"), "assembly", "base_type")
    rows = m.calls.join(m.methods.select(F.col("id").alias("caller_id"), "type_id", "name"), "caller_id").join(types, "type_id")
    category = F.when(F.col("assembly") == "Asm0", "core").when(F.col("name").isin("Update", "LateUpdate"), "engine").when(F.col("base_type").isNull(), "root").otherwise("other")
    return rows.groupBy(category.alias("category")).agg(n().alias("n"))


@query("set_02_union_of_entities", """
    SELECT target_type, target_name FROM mod_xml_operations WHERE operation = 'remove' UNION SELECT target_type, target_name FROM mod_xml_operations WHERE operation = 'set' AND property_name IS NOT NULL""")  # fmt: skip
def union_of_entities(m: Model) -> DataFrame:
    return m.mod_xml_operations.filter("operation = 'remove' or (operation = 'set' and property_name is not null)").select("target_type", "target_name").distinct()


@query("srt_02_ranked_severities", """
    SELECT id, severity FROM game_code_analysis ORDER BY CASE severity WHEN 'BUG' THEN 1 WHEN 'WARNING' THEN 2 WHEN 'INFO' THEN 3 ELSE 4 END, id""")  # fmt: skip
def ranked_severities(m: Model) -> DataFrame:
    s = F.col("severity")
    return m.game_code_analysis.select("id", "severity").orderBy(F.when(s == "BUG", 1).when(s == "WARNING", 2).when(s == "INFO", 3).otherwise(4), "id")


@query("cod_34_largest_hot_methods", """
    SELECT me.id, length(b.body) AS body_length, (SELECT count(*) FROM calls c WHERE c.caller_id = me.id) AS inner_calls, (SELECT count(*) FROM external_calls e WHERE e.caller_id = me.id) AS outer_calls
    FROM methods me JOIN method_bodies b ON b.method_id = me.id WHERE me.name IN ('Update', 'LateUpdate') ORDER BY body_length DESC, id LIMIT 15""")  # fmt: skip
def largest_hot_methods(m: Model) -> DataFrame:
    """The fifteen longest methods that run every frame, with their calls."""
    zero = F.lit(0).cast("long")
    bodies = m.method_bodies.select(F.col("method_id").alias("id"), F.length("body").cast("long").alias("body_length"))
    top = m.methods.filter(F.col("name").isin("Update", "LateUpdate")).select("id").join(bodies, "id").orderBy(F.desc("body_length"), "id").limit(15)
    per = lambda rows, name: rows.groupBy(F.col("caller_id").alias("id")).agg(n().alias(name))
    out = top.join(per(m.calls, "inner_calls"), "id", "left").join(per(m.external_calls, "outer_calls"), "id", "left")
    return out.select("id", "body_length", F.coalesce("inner_calls", zero).alias("inner_calls"), F.coalesce("outer_calls", zero).alias("outer_calls"))


@query("cod_35_costly_calls", """
    SELECT CASE WHEN target_method ILIKE 'GetComponent%' THEN 'getcomponent' WHEN target_method ILIKE 'FindObject%' THEN 'find' WHEN target_type = 'String' THEN 'strings' ELSE 'linq' END AS category, t.name AS type_name, count(*) AS n
    FROM external_calls e JOIN methods me ON e.caller_id = me.id JOIN types t ON me.type_id = t.id GROUP BY 1, 2""")  # fmt: skip
def costly_calls(m: Model) -> DataFrame:
    """Calls that cost much in hot code, by kind and type."""
    method = F.col("target_method")
    category = F.when(method.ilike("GetComponent%"), "getcomponent").when(method.ilike("FindObject%"), "find").when(F.col("target_type") == "String", "strings").otherwise("linq")
    owners = m.methods.join(m.types.select(F.col("id").alias("type_id"), F.col("name").alias("type_name")), "type_id").select(F.col("id").alias("caller_id"), "type_name")
    return m.external_calls.join(owners, "caller_id").groupBy(category.alias("category"), "type_name").agg(n().alias("n"))
