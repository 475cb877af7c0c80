"""The whole of mods and entities: contested entities, health, superlatives, behaviour, exports, stats."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..model import REGISTRY, REMOVALS, Model, csv, n, query, total, with_mod
from .graph import CLOSURE_SQL, reach

def zero() -> Column:
    return F.lit(0).cast("long")

ENTITY = ["target_type", "target_name"]


@query("cnf_41_contested_report", """
    WITH r AS (SELECT target_type, target_name FROM mod_xml_operations GROUP BY 1, 2 HAVING count(DISTINCT CASE WHEN operation = 'remove' THEN mod_id END) > 0 AND count(DISTINCT mod_id) > 1 AND sum(CASE WHEN operation <> 'remove' THEN 1 ELSE 0 END) > 0),
    p AS (SELECT target_type, target_name FROM mod_xml_operations WHERE operation = 'set' AND property_name IS NOT NULL GROUP BY target_type, target_name, property_name HAVING count(DISTINCT mod_id) > 1 AND count(DISTINCT new_value) > 1)
    SELECT target_type, target_name, CASE WHEN (target_type, target_name) IN (SELECT (target_type, target_name) FROM r) THEN 'High' ELSE 'Medium' END AS severity FROM (SELECT * FROM r UNION SELECT * FROM p) u""")  # fmt: skip
def contested_report(m: Model) -> DataFrame:
    """Entities removed by one mod while others touch them (High), or set to different values (Medium)."""
    removal = F.col("operation") == "remove"
    ops = m.mod_xml_operations
    removed = ops.groupBy(*ENTITY).agg(total(removal).alias("r"), total(~removal).alias("o"), F.countDistinct("mod_id").alias("mods")).filter("r > 0 and o > 0 and mods > 1").select(*ENTITY, F.lit("High").alias("severity"))
    values = ops.filter("operation = 'set' and property_name is not null").groupBy(*ENTITY, "property_name").agg(F.countDistinct("mod_id").alias("mods"), F.countDistinct("new_value").alias("v"))
    differing = values.filter("mods > 1 and v > 1").select(*ENTITY, F.lit("Medium").alias("severity"))
    return removed.unionByName(differing).groupBy(*ENTITY).agg(F.min("severity").alias("severity"))


@query("cnf_42_property_conflicts", """
    SELECT o.target_type, o.target_name, o.property_name, string_agg(DISTINCT m.name || ':' || o.new_value, '|' ORDER BY m.name || ':' || o.new_value) AS setters
    FROM mod_xml_operations o JOIN mods m ON o.mod_id = m.id WHERE o.operation = 'set' AND o.property_name IS NOT NULL GROUP BY 1, 2, 3 HAVING count(DISTINCT o.mod_id) > 1 AND count(DISTINCT o.new_value) > 1""")  # fmt: skip
def property_conflicts(m: Model) -> DataFrame:
    """Properties that mods set to different values, with who sets what."""
    rows = with_mod(m, m.mod_xml_operations.filter("operation = 'set' and property_name is not null"), mod="name")
    grouped = rows.groupBy(*ENTITY, "property_name").agg(csv(F.concat("mod", F.lit(":"), "new_value"), "|").alias("setters"), F.countDistinct("mod_id").alias("mods"), F.countDistinct("new_value").alias("v"))
    return grouped.filter("mods > 1 and v > 1").drop("mods", "v")


def _names(m: Model, rows: DataFrame, key: list[str], alias: str) -> DataFrame:
    return with_mod(m, rows, mod="name").groupBy(*key).agg(csv(F.col("mod"), ", ").alias(alias))


@query("cnf_43_ecosystem_entities", """
    WITH t AS (SELECT o.target_type, o.target_name, string_agg(DISTINCT CASE WHEN o.operation <> 'remove' THEN m.name END, ', ' ORDER BY CASE WHEN o.operation <> 'remove' THEN m.name END) AS modified_by,
        string_agg(DISTINCT CASE WHEN o.operation = 'remove' THEN m.name END, ', ' ORDER BY CASE WHEN o.operation = 'remove' THEN m.name END) AS removed_by FROM mod_xml_operations o JOIN mods m ON o.mod_id = m.id GROUP BY 1, 2),
    c AS (SELECT c.dependency_name, string_agg(DISTINCT m.name, ', ' ORDER BY m.name) AS depended_on_by FROM csharp_deps c JOIN mods m ON c.mod_id = m.id GROUP BY 1)
    SELECT d.id, coalesce(t.modified_by, '') AS modified_by, coalesce(t.removed_by, '') AS removed_by, coalesce(c.depended_on_by, '') AS depended_on_by, CASE WHEN t.removed_by IS NOT NULL THEN 'removed' ELSE 'active' END AS status
    FROM xml_definitions d LEFT JOIN t ON t.target_type = d.definition_type AND t.target_name = d.name LEFT JOIN c ON c.dependency_name = d.name""")  # fmt: skip
def ecosystem_entities(m: Model) -> DataFrame:
    """Each definition with the mods that change it, remove it and need it."""
    gone = F.col("operation") == "remove"
    rows = with_mod(m, m.mod_xml_operations, mod="name").groupBy(F.col("target_type").alias("definition_type"), F.col("target_name").alias("name")).agg(csv(F.when(~gone, F.col("mod")), ", ").alias("modified_by"), csv(F.when(gone, F.col("mod")), ", ").alias("removed_by"))
    needed = _names(m, m.csharp_deps.withColumnRenamed("dependency_name", "name"), ["name"], "depended_on_by")
    out = m.xml_definitions.join(rows, ["definition_type", "name"], "left").join(needed, "name", "left")
    out = out.select("id", *(F.coalesce(c, F.lit("")).alias(c) for c in ("modified_by", "removed_by", "depended_on_by")))
    return out.withColumn("status", F.when(F.col("removed_by") != "", "removed").otherwise("active"))


@query("cnf_44_ecosystem_stats", """
    WITH r AS (SELECT DISTINCT target_type, target_name FROM mod_xml_operations WHERE operation = 'remove'), t AS (SELECT DISTINCT target_type, target_name FROM mod_xml_operations WHERE operation <> 'remove'), c AS (SELECT DISTINCT dependency_name FROM csharp_deps)
    SELECT CAST(sum(CASE WHEN r.target_name IS NULL THEN 1 ELSE 0 END) AS BIGINT) AS active, CAST(sum(CASE WHEN t.target_name IS NOT NULL THEN 1 ELSE 0 END) AS BIGINT) AS modified, CAST(sum(CASE WHEN r.target_name IS NOT NULL THEN 1 ELSE 0 END) AS BIGINT) AS removed,
      CAST(sum(CASE WHEN c.dependency_name IS NOT NULL THEN 1 ELSE 0 END) AS BIGINT) AS depended_on, CAST(sum(CASE WHEN r.target_name IS NOT NULL AND c.dependency_name IS NOT NULL THEN 1 ELSE 0 END) AS BIGINT) AS danger
    FROM xml_definitions d LEFT JOIN r ON r.target_type = d.definition_type AND r.target_name = d.name LEFT JOIN t ON t.target_type = d.definition_type AND t.target_name = d.name LEFT JOIN c ON c.dependency_name = d.name""")  # fmt: skip
def ecosystem_stats(m: Model) -> DataFrame:
    """How many entities are active, changed, removed, needed, and both removed and needed."""
    rows = ecosystem_entities(m)
    removed, needed = F.col("removed_by") != "", F.col("depended_on_by") != ""
    return rows.agg(total(~removed).alias("active"), total(F.col("modified_by") != "").alias("modified"), total(removed).alias("removed"), total(needed).alias("depended_on"), total(removed & needed).alias("danger"))


def impact_class(operation: Column, known: Column, refs: Column) -> Column:
    """How dangerous an operation on an entity is that ``refs`` references aim at."""
    gone = operation == "remove"
    return F.when(~known, "Safe").when(gone & (refs > 0), "Conflict").when(gone | (refs > 5), "Caution").otherwise("Safe")


@query("cnf_45_xpath_impact", """
    SELECT o.id, CASE WHEN d.id IS NULL THEN 'Safe' WHEN o.operation = 'remove' AND coalesce(r.n, 0) > 0 THEN 'Conflict' WHEN o.operation = 'remove' OR coalesce(r.n, 0) > 5 THEN 'Caution' ELSE 'Safe' END AS status
    FROM mod_xml_operations o LEFT JOIN xml_definitions d ON d.definition_type = o.target_type AND d.name = o.target_name
    LEFT JOIN (SELECT target_type, target_name, count(*) AS n FROM xml_references GROUP BY 1, 2) r ON r.target_type = o.target_type AND r.target_name = o.target_name""")  # fmt: skip
def xpath_impact(m: Model) -> DataFrame:
    """How dangerous each operation is, by what it does and how much refers to its entity."""
    refs = m.xml_references.groupBy(*ENTITY).agg(n().alias("refs"))
    defs = m.xml_definitions.select(F.col("definition_type").alias("target_type"), F.col("name").alias("target_name"), F.lit(True).alias("known"))
    rows = m.mod_xml_operations.join(defs, ENTITY, "left").join(refs, ENTITY, "left")
    return rows.select("id", impact_class(F.col("operation"), F.col("known").isNotNull(), F.coalesce("refs", F.lit(0))).alias("status"))


@query("cnf_46_mod_health", f"""
    WITH x AS ({REGISTRY["cnf_45_xpath_impact"][1]}),
    o AS (SELECT o.mod_id, count(*) AS ops, count(*) FILTER (WHERE operation = 'remove') AS removes, count(*) FILTER (WHERE operation IN ('set', 'setattribute')) AS sets, count(*) FILTER (WHERE operation IN ('append', 'insertBefore', 'insertAfter')) AS appends,
      count(DISTINCT target_name) AS entities, count(*) FILTER (WHERE x.status = 'Conflict') AS conflicts FROM mod_xml_operations o JOIN x ON x.id = o.id GROUP BY 1),
    d AS (SELECT mod_id, count(*) AS deps FROM csharp_deps GROUP BY 1),
    j AS (SELECT m.name, m.has_xml, m.has_dll, m.load_order, coalesce(ops, 0) AS ops, coalesce(removes, 0) AS removes, coalesce(sets, 0) AS sets, coalesce(appends, 0) AS appends, coalesce(entities, 0) AS entities, coalesce(conflicts, 0) AS conflicts, coalesce(deps, 0) AS deps
      FROM mods m LEFT JOIN o ON o.mod_id = m.id LEFT JOIN d ON d.mod_id = m.id)
    SELECT name, load_order, ops AS operations, deps AS dependencies, removes AS removals, CASE WHEN has_xml AND has_dll THEN 'Hybrid' WHEN has_xml THEN 'XML' WHEN has_dll THEN 'C#' ELSE 'Config' END AS kind, CASE WHEN conflicts > 0 THEN 'Broken' ELSE 'Healthy' END AS health,
      CASE WHEN conflicts > 0 THEN 'Removes game content needed by other mods' WHEN removes > 0 THEN 'Removes ' || CAST(removes AS VARCHAR) || ' game element(s)'
        WHEN ops > 0 AND deps > 0 THEN 'Hybrid: ' || CAST(ops AS VARCHAR) || ' XML ops on ' || CAST(entities AS VARCHAR) || ' entities, ' || CAST(deps AS VARCHAR) || ' C# patches'
        WHEN ops > 0 AND sets > 0 AND appends > 0 THEN 'XML: ' || CAST(sets AS VARCHAR) || ' sets, ' || CAST(appends AS VARCHAR) || ' appends on ' || CAST(entities AS VARCHAR) || ' entities'
        WHEN ops > 0 AND sets > 0 THEN 'XML: ' || CAST(sets AS VARCHAR) || ' sets on ' || CAST(entities AS VARCHAR) || ' entities' WHEN ops > 0 AND appends > 0 THEN 'XML: ' || CAST(appends AS VARCHAR) || ' appends on ' || CAST(entities AS VARCHAR) || ' entities'
        WHEN ops > 0 THEN 'XML: ' || CAST(ops AS VARCHAR) || ' operations on ' || CAST(entities AS VARCHAR) || ' entities' WHEN deps > 0 THEN 'C#: ' || CAST(deps AS VARCHAR) || ' game code patches'
        WHEN has_dll THEN 'C# mod (no detected game patches)' WHEN has_xml THEN 'Has Config/ but no operations parsed' ELSE 'Config only (no XML/DLL detected)' END AS note FROM j""")  # fmt: skip
def mod_health(m: Model) -> DataFrame:
    """Kind and state of each mod, with a note: broken if it removes what others refer to."""
    op = F.col("operation")
    ops = m.mod_xml_operations.join(xpath_impact(m), "id").groupBy(F.col("mod_id").alias("id")).agg(
        n().alias("operations"), total(op == "remove").alias("removals"), total(op.isin("set", "setattribute")).alias("sets"), total(op.isin("append", "insertBefore", "insertAfter")).alias("appends"),
        F.countDistinct("target_name").alias("entities"), total(F.col("status") == "Conflict").alias("conflicts"),
    )
    deps = m.csharp_deps.groupBy(F.col("mod_id").alias("id")).agg(n().alias("dependencies"))
    kind = F.when(F.col("has_xml") & F.col("has_dll"), "Hybrid").when(F.col("has_xml"), "XML").when(F.col("has_dll"), "C#").otherwise("Config")
    rows = m.mods.join(ops, "id", "left").join(deps, "id", "left").fillna(0, ["operations", "removals", "sets", "appends", "entities", "conflicts", "dependencies"])
    c = lambda name: F.col(name)
    text = lambda *parts: F.concat(*(F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts))
    kinds = F.array_join(F.array_compact(F.array(F.when(c("sets") > 0, text(c("sets"), " sets")), F.when(c("appends") > 0, text(c("appends"), " appends")))), ", ")
    note = (
        F.when(c("conflicts") > 0, "Removes game content needed by other mods").when(c("removals") > 0, text("Removes ", c("removals"), " game element(s)"))
        .when((c("operations") > 0) & (c("dependencies") > 0), text("Hybrid: ", c("operations"), " XML ops on ", c("entities"), " entities, ", c("dependencies"), " C# patches"))
        .when(c("operations") > 0, text("XML: ", F.when(kinds == "", text(c("operations"), " operations")).otherwise(kinds), " on ", c("entities"), " entities"))
        .when(c("dependencies") > 0, text("C#: ", c("dependencies"), " game code patches")).when(c("has_dll"), "C# mod (no detected game patches)").when(c("has_xml"), "Has Config/ but no operations parsed").otherwise("Config only (no XML/DLL detected)")
    )
    return rows.select("name", "load_order", "operations", "dependencies", "removals", kind.alias("kind"), F.when(c("conflicts") > 0, "Broken").otherwise("Healthy").alias("health"), note.alias("note"))


@query("cnf_47_superlatives", """
    SELECT 'longest_item_name' AS what, name AS who, CAST(length(name) AS BIGINT) AS n FROM (SELECT name FROM xml_definitions WHERE definition_type = 'item' ORDER BY length(name) DESC, name LIMIT 1) a
    UNION ALL SELECT 'most_referenced', target_name, n FROM (SELECT target_name, count(*) AS n FROM xml_references GROUP BY 1 ORDER BY n DESC, target_name LIMIT 1) b
    UNION ALL SELECT 'most_properties', name, n FROM (SELECT d.name, count(*) AS n FROM xml_properties p JOIN xml_definitions d ON d.id = p.definition_id GROUP BY 1 ORDER BY n DESC, name LIMIT 1) c
    UNION ALL SELECT 'most_outgoing', name, n FROM (SELECT d.name, count(*) AS n FROM xml_references r JOIN xml_definitions d ON d.id = r.source_def_id GROUP BY 1 ORDER BY n DESC, name LIMIT 1) e
    UNION ALL SELECT 'most_incoming', name, n FROM (SELECT d.name, count(*) AS n FROM xml_references r JOIN xml_definitions d ON (d.definition_type, d.name) = (r.target_type, r.target_name) GROUP BY 1 ORDER BY n DESC, name LIMIT 1) f""")  # fmt: skip
def superlatives(m: Model) -> DataFrame:
    """The longest item name, the name referenced most, the definitions with most properties, references out and references in; ties by name."""
    best = lambda rows, what: rows.orderBy(F.desc("n"), "who").limit(1).select(F.lit(what).alias("what"), "who", "n")
    longest = m.xml_definitions.filter("definition_type = 'item'").select(F.col("name").alias("who"), F.length("name").cast("long").alias("n"))
    referenced = m.xml_references.groupBy(F.col("target_name").alias("who")).agg(n().alias("n"))
    names = m.xml_definitions.select(F.col("id").alias("definition_id"), F.col("name").alias("who"))
    properties = m.xml_properties.join(names, "definition_id").groupBy("who").agg(n().alias("n"))
    outgoing = m.xml_references.join(names.withColumnRenamed("definition_id", "source_def_id"), "source_def_id").groupBy("who").agg(n().alias("n"))
    ends = m.xml_definitions.select(F.col("definition_type").alias("target_type"), F.col("name").alias("target_name"))
    incoming = m.xml_references.join(ends, ["target_type", "target_name"]).groupBy(F.col("target_name").alias("who")).agg(n().alias("n"))
    found = {"longest_item_name": longest, "most_referenced": referenced, "most_properties": properties, "most_outgoing": outgoing, "most_incoming": incoming}
    return reduce(DataFrame.unionByName, (best(rows, what) for what, rows in found.items()))


@query("cnf_48_most_invasive", """
    SELECT m.name, coalesce(x.n, 0) + coalesce(h.n, 0) AS changes, coalesce(x.t, 0) + coalesce(h.t, 0) AS targets FROM mods m LEFT JOIN (SELECT mod_id, count(*) AS n, count(DISTINCT target_name) AS t FROM mod_xml_operations GROUP BY 1) x ON x.mod_id = m.id
    LEFT JOIN (SELECT mod_id, count(*) AS n, count(DISTINCT target_class) AS t FROM harmony_patches GROUP BY 1) h ON h.mod_id = m.id ORDER BY changes DESC, m.name LIMIT 10""")  # fmt: skip
def most_invasive(m: Model) -> DataFrame:
    """The ten mods with most changes, over how many targets."""
    x = m.mod_xml_operations.groupBy(F.col("mod_id").alias("id")).agg(n().alias("xn"), F.countDistinct("target_name").alias("xt"))
    h = m.harmony_patches.groupBy(F.col("mod_id").alias("id")).agg(n().alias("hn"), F.countDistinct("target_class").alias("ht"))
    rows = m.mods.join(x, "id", "left").join(h, "id", "left").fillna(0, ["xn", "xt", "hn", "ht"])
    return rows.select("name", (F.col("xn") + F.col("hn")).alias("changes"), (F.col("xt") + F.col("ht")).alias("targets")).orderBy(F.desc("changes"), "name").limit(10)


@query("cnf_48_most_interconnected", """
    SELECT d.name, coalesce(o.n, 0) + coalesce(i.n, 0) AS degree FROM xml_definitions d LEFT JOIN (SELECT source_def_id AS id, count(*) AS n FROM xml_references GROUP BY 1) o ON o.id = d.id
    LEFT JOIN (SELECT target_type, target_name, count(*) AS n FROM xml_references GROUP BY 1, 2) i ON i.target_type = d.definition_type AND i.target_name = d.name ORDER BY degree DESC, d.name LIMIT 10""")  # fmt: skip
def most_interconnected(m: Model) -> DataFrame:
    from .lookup import degrees

    rows = degrees(m).join(m.xml_definitions.select("id", "name"), "id")
    return rows.select("name", (F.col("out_degree") + F.col("in_degree")).alias("degree")).orderBy(F.desc("degree"), "name").limit(10)


#: Kinds of code dependencies that patch a method, and what they are called.
PATCH_KINDS = {"harmony_prefix": "Prefix", "harmony_postfix": "Postfix", "harmony_transpiler": "Transpiler"}


def _dependencies(m: Model) -> DataFrame:
    """The tables' dependencies, some of them as patches of methods and as extended classes and interfaces."""
    k = F.col("id") % 7
    kind = F.when(k == 0, "harmony_prefix").when(k == 1, "harmony_postfix").when(k == 2, "harmony_transpiler").when(k == 3, "extends_Item").when(k == 4, "implements_IModApi").otherwise(F.col("dependency_type"))
    name = F.when(k.isin(0, 1), F.concat("dependency_name", F.lit(".Run.Fast"))).otherwise(F.col("dependency_name"))
    return m.csharp_deps.withColumns({"dependency_type": kind, "dependency_name": name})


_DEPS_SQL = """WITH deps AS (SELECT id, mod_id, CASE WHEN id % 7 < 5 THEN ['harmony_prefix', 'harmony_postfix', 'harmony_transpiler', 'extends_Item', 'implements_IModApi'][CAST(id % 7 AS INTEGER) + 1] ELSE dependency_type END AS dependency_type,
    CASE WHEN id % 7 < 2 THEN dependency_name || '.Run.Fast' ELSE dependency_name END AS dependency_name FROM csharp_deps)"""


@query("cnf_49_code_rollup", _DEPS_SQL + """
    SELECT 'dependencies' AS section, '' AS mod, dependency_type AS a, '' AS b, '' AS c, count(*) AS n FROM deps GROUP BY 3
    UNION ALL SELECT 'patches', name, split_part(dependency_name, '.', 1), CASE WHEN contains(dependency_name, '.') THEN substr(dependency_name, strpos(dependency_name, '.') + 1) ELSE '' END, CASE dependency_type WHEN 'harmony_prefix' THEN 'Prefix' WHEN 'harmony_postfix' THEN 'Postfix' ELSE 'Transpiler' END, 1
      FROM (SELECT DISTINCT name, dependency_name, dependency_type FROM deps JOIN mods ON mods.id = deps.mod_id WHERE starts_with(dependency_type, 'harmony_') AND dependency_type <> 'harmony_class') p
    UNION ALL SELECT 'extensions', name, replace(replace(dependency_type, 'extends_', ''), 'implements_', ''), dependency_name, '', 1 FROM deps JOIN mods ON mods.id = deps.mod_id WHERE dependency_type LIKE 'extends_%' OR dependency_type LIKE 'implements_%'""")  # fmt: skip
def code_rollup(m: Model, deps: DataFrame | None = None) -> DataFrame:
    """Code dependencies in three sections: how many of each type; patches by class and method, split at the first dot; extended classes."""
    deps = _dependencies(m) if deps is None else deps
    kind, name, empty = F.col("dependency_type"), F.col("dependency_name"), F.lit("")
    shape = lambda rows, section, mod, a, b, c, k: rows.select(F.lit(section).alias("section"), mod.alias("mod"), a.alias("a"), b.alias("b"), c.alias("c"), k.cast("long").alias("n"))
    counts = shape(deps.groupBy("dependency_type").agg(n().alias("n")), "dependencies", empty, kind, empty, empty, F.col("n"))
    named = with_mod(m, deps, mod="name")
    patched = named.filter(kind.isin(*PATCH_KINDS)).select("mod", "dependency_name", "dependency_type").distinct()
    at = F.instr(name, ".")
    called = F.try_element_at(F.create_map(*(F.lit(x) for kv in PATCH_KINDS.items() for x in kv)), kind)
    patches = shape(patched, "patches", F.col("mod"), F.substring_index(name, ".", 1), F.when(at > 0, F.substring(name, at + 1, F.length(name))).otherwise(""), called, F.lit(1))
    extended = named.filter(kind.startswith("extends_") | kind.startswith("implements_"))
    return counts.unionByName(patches).unionByName(shape(extended, "extensions", F.col("mod"), F.regexp_replace(kind, "extends_|implements_", ""), name, empty, F.lit(1)))


#: Entity type to the system it belongs to; other types stand for themselves.
SYSTEMS = {
    "item": "Items", "block": "Blocks", "buff": "Buffs/Effects", "recipe": "Crafting", "entity_class": "Entities", "vehicle": "Vehicles", "quest": "Quests", "sound": "Audio", "loot_group": "Loot", "loot_container": "Loot",
    "skill": "Progression", "perk": "Progression",
}


def system_of(kind: Column) -> Column:
    return F.coalesce(F.try_element_at(F.create_map(*(F.lit(x) for kv in SYSTEMS.items() for x in kv)), kind), kind)


_SYSTEM_SQL = "CASE target_type " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in SYSTEMS.items()) + " ELSE target_type END"


@query("cnf_50_mod_behaviour", _DEPS_SQL + f"""
    , s AS (SELECT mod_id, {_SYSTEM_SQL} AS system FROM mod_xml_operations WHERE target_type <> '' GROUP BY 1, 2), sr AS (SELECT *, row_number() OVER (PARTITION BY mod_id ORDER BY system) AS o FROM s),
    f AS (SELECT mod_id, 'Patches ' || dependency_name AS feature, row_number() OVER (PARTITION BY mod_id ORDER BY id) AS o FROM deps WHERE starts_with(dependency_type, 'harmony_')),
    ss AS (SELECT mod_id, string_agg(system, ', ' ORDER BY o) AS systems, string_agg(CASE WHEN o <= 3 THEN system END, ', ' ORDER BY o) AS three FROM sr GROUP BY 1), ff AS (SELECT mod_id, string_agg(feature, '|' ORDER BY o) AS features, max(CASE WHEN o = 1 THEN feature END) AS first FROM f WHERE o <= 10 GROUP BY 1)
    SELECT mods.name, coalesce(ff.first, 'Modifies ' || ss.three, 'Game modification') AS one_liner, coalesce(ff.features, '') AS features, coalesce(ss.systems, '') AS systems
    FROM mods LEFT JOIN ss ON ss.mod_id = mods.id LEFT JOIN ff ON ff.mod_id = mods.id""")  # fmt: skip
def mod_behaviour(m: Model, deps: DataFrame | None = None) -> DataFrame:
    """What each mod does in a line: the first method it patches, else the systems it changes; with its first ten features and all systems."""
    deps = _dependencies(m) if deps is None else deps
    touched = m.mod_xml_operations.filter("target_type <> ''").select("mod_id", system_of(F.col("target_type")).alias("system")).distinct()
    systems = touched.groupBy("mod_id").agg(F.array_sort(F.collect_list("system")).alias("systems"))  # as many as there are systems
    order = Window.partitionBy("mod_id").orderBy("id")
    first = deps.filter(F.col("dependency_type").startswith("harmony_")).select("mod_id", "id", F.concat(F.lit("Patches "), "dependency_name").alias("feature")).withColumn("k", F.row_number().over(order)).filter("k <= 10")
    features = first.groupBy("mod_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "feature"))), lambda x: x["feature"]).alias("features"))
    rows = m.mods.select(F.col("id").alias("mod_id"), "name").join(systems, "mod_id", "left").join(features, "mod_id", "left")
    line = F.coalesce(F.get("features", F.lit(0)), F.concat(F.lit("Modifies "), F.array_join(F.slice("systems", 1, 3), ", ")), F.lit("Game modification"))
    joined = lambda c, sep: F.coalesce(F.array_join(c, sep), F.lit("")).alias(c)
    return rows.select("name", line.alias("one_liner"), joined("features", "|"), joined("systems", ", "))


@query("cnf_51_top_entities_per_mod", """
    SELECT mod_id, target_name, n FROM (SELECT mod_id, target_name, count(*) AS n, row_number() OVER (PARTITION BY mod_id ORDER BY count(*) DESC, target_name) AS r FROM mod_xml_operations GROUP BY 1, 2) t WHERE r <= 10""")  # fmt: skip
def top_entities_per_mod(m: Model) -> DataFrame:
    """The ten entities each mod changes most."""
    from pyspark.sql import Window

    order = Window.partitionBy("mod_id").orderBy(F.desc("n"), "target_name")
    rows = m.mod_xml_operations.groupBy("mod_id", "target_name").agg(n().alias("n"))
    return rows.withColumn("r", F.row_number().over(order)).filter("r <= 10").drop("r")


@query("cnf_51_entity_export", "SELECT d.id, d.definition_type, d.name, d.file_path, d.line_number, coalesce(p.n, 0) AS properties FROM xml_definitions d LEFT JOIN (SELECT definition_id, count(*) AS n FROM xml_properties GROUP BY 1) p ON p.definition_id = d.id")
def entity_export(m: Model) -> DataFrame:
    """All definitions by type and name, with how many properties they have."""
    props = m.xml_properties.groupBy(F.col("definition_id").alias("id")).agg(n().alias("properties"))
    rows = m.xml_definitions.select("id", "definition_type", "name", "file_path", "line_number").join(props, "id", "left")
    return rows.withColumn("properties", F.coalesce("properties", zero())).orderBy("definition_type", "name")


@query("cnf_51_reference_export", "SELECT d.name AS source_name, r.source_type, r.target_type, r.target_name, r.reference_context FROM xml_references r LEFT JOIN xml_definitions d ON d.id = r.source_def_id")
def reference_export(m: Model) -> DataFrame:
    """All references with the name of their source, in order."""
    names = m.xml_definitions.select(F.col("id").alias("source_def_id"), F.col("name").alias("source_name"))
    rows = m.xml_references.join(names, "source_def_id", "left").select("source_name", "source_type", "target_type", "target_name", "reference_context")
    return rows.orderBy("source_type", "source_name", "target_type", "target_name", "reference_context")


@query("cnf_51_transitive_export", CLOSURE_SQL + " SELECT source, target, depth FROM reach ORDER BY source, depth, target LIMIT 10000")
def transitive_export(m: Model, limit: int = 10_000) -> DataFrame:
    """The first ten thousand reachable pairs by source and depth, as the report shows them."""
    return reach(m).orderBy("source", "depth", "target").limit(limit)


@query("cnf_52_stats", """
    WITH kinds AS (SELECT operation, count(*) AS n FROM mod_xml_operations GROUP BY 1),
    contested AS (SELECT target_type || ':' || target_name AS who, count(DISTINCT mod_id) AS n FROM mod_xml_operations WHERE target_name IS NOT NULL GROUP BY 1 ORDER BY n DESC, who LIMIT 5),
    needed AS (SELECT d.name AS who, count(DISTINCT r.source_def_id) AS n FROM xml_references r JOIN xml_definitions d ON (d.definition_type, d.name) = (r.target_type, r.target_name) GROUP BY 1 ORDER BY n DESC, who LIMIT 3)
    SELECT 'definitions' AS fact, '' AS who, count(*) AS n FROM xml_definitions UNION ALL SELECT 'properties', '', count(*) FROM xml_properties UNION ALL SELECT 'references', '', count(*) FROM xml_references
    UNION ALL SELECT 'extending', '', count(*) FROM xml_definitions WHERE extends IS NOT NULL UNION ALL SELECT 'mods', '', count(*) FROM mods UNION ALL SELECT 'operations', '', count(*) FROM mod_xml_operations
    UNION ALL SELECT 'operations_of_kind', operation, n FROM kinds UNION ALL SELECT 'definitions_of_type', definition_type, count(*) FROM xml_definitions GROUP BY 2
    UNION ALL SELECT 'contested', who, n FROM contested UNION ALL SELECT 'dependants', who, n FROM needed
    UNION ALL SELECT 'longest_name', name, length(name) FROM (SELECT name FROM xml_definitions ORDER BY length(name) DESC, name LIMIT 1)""")  # fmt: skip
def stats(m: Model) -> DataFrame:
    """Counts of tables, operations and types, the longest name, the five most contested entities, the three most needed."""
    defs, ops = m.xml_definitions, m.mod_xml_operations
    whole = {"definitions": defs, "properties": m.xml_properties, "references": m.xml_references, "extending": defs.filter("extends is not null"), "mods": m.mods, "operations": ops}
    fact = lambda name, rows, who, many: rows.select(F.lit(name).alias("fact"), who.alias("who"), many.cast("long").alias("n"))
    out = [fact(name, rows.agg(n().alias("n")), F.lit(""), F.col("n")) for name, rows in whole.items()]
    out += [fact(name, rows.groupBy(F.col(by).alias("who")).agg(n().alias("n")), F.col("who"), F.col("n")) for name, rows, by in (("operations_of_kind", ops, "operation"), ("definitions_of_type", defs, "definition_type"))]
    top = lambda rows, k: rows.orderBy(F.desc("n"), "who").limit(k)
    entity = F.concat("target_type", F.lit(":"), "target_name").alias("who")
    contested = top(ops.filter("target_name is not null").groupBy(entity).agg(F.countDistinct("mod_id").alias("n")), 5)
    ends = defs.select(F.col("definition_type").alias("target_type"), F.col("name").alias("target_name"))
    needed = top(m.xml_references.join(ends, ["target_type", "target_name"]).groupBy(F.col("target_name").alias("who")).agg(F.countDistinct("source_def_id").alias("n")), 3)
    longest = top(defs.select(F.col("name").alias("who"), F.length("name").alias("n")), 1)
    out += [fact(name, rows, F.col("who"), F.col("n")) for name, rows in (("contested", contested), ("dependants", needed), ("longest_name", longest))]
    return reduce(DataFrame.unionByName, out)


@query("sem_01_property_traces", """
    SELECT p.property_name, count(*) AS usage_count, count(DISTINCT d.definition_type) AS types, min(substr(p.property_value, 1, 50)) AS sample FROM xml_properties p JOIN xml_definitions d ON d.id = p.definition_id GROUP BY 1""")  # fmt: skip
def property_traces(m: Model) -> DataFrame:
    """How each property name is used."""
    defs = m.xml_definitions.select(F.col("id").alias("definition_id"), "definition_type")
    return m.xml_properties.join(defs, "definition_id").groupBy("property_name").agg(n().alias("usage_count"), F.countDistinct("definition_type").alias("types"), F.min(F.substring("property_value", 1, 50)).alias("sample"))


@query("sem_02_definition_traces", """
    SELECT d.id, count(p.id) AS prop_count, coalesce(string_agg(p.property_name || '=' || substr(p.property_value, 1, 30), ',' ORDER BY p.property_name || '=' || substr(p.property_value, 1, 30)), '') AS props FROM xml_definitions d LEFT JOIN xml_properties p ON p.definition_id = d.id GROUP BY 1""")  # fmt: skip
def definition_traces(m: Model) -> DataFrame:
    """Each definition with its properties in short."""
    entry = F.concat("property_name", F.lit("="), F.substring("property_value", 1, 30))
    props = m.xml_properties.groupBy(F.col("definition_id").alias("id")).agg(n().alias("prop_count"), F.array_join(F.array_sort(F.collect_list(entry)), ",").alias("props"))
    return m.xml_definitions.select("id").join(props, "id", "left").select("id", F.coalesce("prop_count", zero()).alias("prop_count"), F.coalesce("props", F.lit("")).alias("props"))


@query("sem_03_cross_reference_patterns", "SELECT source_type, target_type, reference_context, count(*) AS n, min(target_name) AS sample FROM xml_references GROUP BY 1, 2, 3")
def cross_reference_patterns(m: Model) -> DataFrame:
    return m.xml_references.groupBy("source_type", "target_type", "reference_context").agg(n().alias("n"), F.min("target_name").alias("sample"))


@query("sem_04_definition_type_traces", "SELECT definition_type, count(*) AS n, min(name) AS first_name, max(name) AS last_name FROM xml_definitions GROUP BY 1")
def definition_type_traces(m: Model) -> DataFrame:
    return m.xml_definitions.groupBy("definition_type").agg(n().alias("n"), F.min("name").alias("first_name"), F.max("name").alias("last_name"))


@query("sem_05_code_class_traces", """
    SELECT target_class, count(*) AS patches, array_to_string(list_slice(list_sort(list_distinct(list(target_method))), 1, 10), ',') AS methods FROM harmony_patches GROUP BY 1""")  # fmt: skip
def code_class_traces(m: Model) -> DataFrame:
    """Patched classes with up to ten of their methods."""
    methods = F.slice(F.array_sort(F.collect_set("target_method")), 1, 10)
    return m.harmony_patches.groupBy("target_class").agg(n().alias("patches"), F.array_join(methods, ",").alias("methods"))


@query("agg_15_semantic_coverage", """
    SELECT 'property_name' AS entity_type, count(DISTINCT p.property_name) AS total, count(DISTINCT s.entity_name) AS described FROM xml_properties p LEFT JOIN semantic_mappings s ON s.entity_type = 'property_name' AND s.entity_name = p.property_name
    UNION ALL SELECT 'definition_type', count(DISTINCT d.definition_type), count(DISTINCT s.entity_name) FROM xml_definitions d LEFT JOIN semantic_mappings s ON s.entity_type = 'definition_type' AND s.entity_name = d.definition_type""")  # fmt: skip
def semantic_coverage(m: Model) -> DataFrame:
    """How many names of each kind have a description."""
    names = m.xml_properties.select(F.lit("property_name").alias("entity_type"), F.col("property_name").alias("entity_name")).distinct()
    names = names.unionByName(m.xml_definitions.select(F.lit("definition_type").alias("entity_type"), F.col("definition_type").alias("entity_name")).distinct())
    described = m.semantic_mappings.select("entity_type", "entity_name", F.lit(1).alias("d"))
    return names.join(described, ["entity_type", "entity_name"], "left").groupBy("entity_type").agg(n().alias("total"), F.count("d").alias("described"))


@query("snk_13_undescribed_traces", """
    WITH t AS (SELECT 'property_name' AS entity_type, property_name AS entity_name FROM xml_properties UNION SELECT 'definition', name FROM xml_definitions UNION SELECT 'definition_type', definition_type FROM xml_definitions
      UNION SELECT 'cross_reference', source_type || '>' || target_type || '>' || reference_context FROM xml_references UNION SELECT 'code_class', target_class FROM harmony_patches)
    SELECT entity_type, entity_name FROM t EXCEPT SELECT entity_type, entity_name FROM semantic_mappings""")  # fmt: skip
def undescribed_traces(m: Model) -> DataFrame:
    """Keys of all five classes of traces that have no description yet."""
    key = lambda rows, kind, name: rows.select(F.lit(kind).alias("entity_type"), name.alias("entity_name"))
    classes = [
        key(m.xml_properties, "property_name", F.col("property_name")), key(m.xml_definitions, "definition", F.col("name")), key(m.xml_definitions, "definition_type", F.col("definition_type")),
        key(m.xml_references, "cross_reference", F.concat_ws(">", "source_type", "target_type", "reference_context")), key(m.harmony_patches, "code_class", F.col("target_class")),
    ]
    known = m.semantic_mappings.select("entity_type", "entity_name")
    return reduce(DataFrame.unionByName, classes).distinct().join(known, ["entity_type", "entity_name"], "left_anti")


@query("inc_02_change_classification", """
    SELECT coalesce(lower(c.file_path), lower(s.file_path)) AS path, CASE WHEN s.file_path IS NULL THEN 'new' WHEN c.file_path IS NULL THEN 'deleted' WHEN s.content_hash = c.content_hash THEN 'unchanged' ELSE 'changed' END AS state
    FROM stored_hashes s FULL JOIN current_hashes c ON lower(s.file_path) = lower(c.file_path)""")  # fmt: skip
def change_classification(m: Model) -> DataFrame:
    """What happened to each file since its hash was stored; paths are blind to case."""
    key = F.lower("file_path").alias("path")
    stored, current = m.stored_hashes.select(key, F.col("content_hash").alias("s")), m.current_hashes.select(key, F.col("content_hash").alias("c"))
    state = F.when(F.col("s").isNull(), "new").when(F.col("c").isNull(), "deleted").when(F.col("s") == F.col("c"), "unchanged").otherwise("changed")
    return stored.join(current, "path", "full_outer").select("path", state.alias("state"))


@query("inc_03_stale_hashes", "SELECT file_path FROM stored_hashes WHERE lower(file_path) NOT IN (SELECT lower(file_path) FROM current_hashes)")
def stale_hashes(m: Model) -> DataFrame:
    current = m.current_hashes.select(F.lower("file_path").alias("k"))
    return m.stored_hashes.join(current, F.lower("file_path") == F.col("k"), "left_anti").select("file_path")


@query("inc_06_files_to_process", "SELECT c.file_path FROM current_hashes c WHERE NOT EXISTS (SELECT 1 FROM stored_hashes s WHERE lower(s.file_path) = lower(c.file_path) AND s.content_hash = c.content_hash)")
def files_to_process(m: Model) -> DataFrame:
    """Files whose present content has not been processed."""
    stored = m.stored_hashes.select(F.lower("file_path").alias("k"), "content_hash")
    current = m.current_hashes.withColumn("k", F.lower("file_path"))
    return current.join(stored, ["k", "content_hash"], "left_anti").select("file_path")
