"""Indirect conflicts: mods that meet through references, inheritance or shared recipes."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..model import REMOVALS, Model, csv, n, query, total, with_mod
from .graph import CLOSURE_SQL, DEPTH, reach, settled

DEFS = ("id", "definition_type", "name")


def _targets(m: Model, operations: DataFrame, **named: str) -> DataFrame:
    """Operations with the definition they aim at (entity_id) and columns of their mod."""
    defs = m.xml_definitions.select(F.col("id").alias("entity_id"), F.col("definition_type").alias("target_type"), F.col("name").alias("target_name"))
    return with_mod(m, operations.join(defs, ["target_type", "target_name"]), **named)


@query("cnf_15_h1_deleted_entity_referenced", """
    WITH needed AS (SELECT target_type, target_name, count(DISTINCT id) AS ref_count FROM xml_references GROUP BY 1, 2),
    deleted AS (SELECT DISTINCT mod_id, target_type, target_name FROM mod_xml_operations WHERE operation = 'remove')
    SELECT mod_id, d.id AS entity_id, d.name AS deleted_entity, mods.name AS deleter_mod, ref_count
    FROM deleted JOIN needed USING (target_type, target_name) JOIN mods ON mods.id = mod_id JOIN xml_definitions d ON (d.definition_type, d.name) = (target_type, target_name)""")  # fmt: skip
def deleted_entity_referenced(m: Model) -> DataFrame:
    """A removed entity still has references."""
    gone = _targets(m, m.mod_xml_operations.filter("operation = 'remove'"), deleter_mod="name").select("mod_id", "entity_id", "target_type", "target_name", "deleter_mod").distinct()
    refs = m.xml_references.groupBy("target_type", "target_name").agg(F.countDistinct("id").alias("ref_count"))
    return gone.join(refs, ["target_type", "target_name"]).select("mod_id", "entity_id", F.col("target_name").alias("deleted_entity"), "deleter_mod", "ref_count")


@query("cnf_16_h2_broken_inheritance", CLOSURE_SQL + """
    , touched AS (SELECT DISTINCT d.id, d.name, o.mod_id, o.operation IN ('set', 'remove') AND o.property_name IS NOT NULL AS deep FROM mod_xml_operations o JOIN xml_definitions d ON d.definition_type = o.target_type AND d.name = o.target_name WHERE o.mod_id IN (SELECT id FROM mods))
    SELECT DISTINCT p.mod_id AS mod1_id, c.mod_id AS mod2_id, p.id AS entity_id, p.name AS parent_entity, c.name AS child_entity, ext.depth
    FROM ext JOIN touched p ON p.id = ext.target AND p.deep JOIN touched c ON c.id = ext.source WHERE ext.depth BETWEEN 2 AND 10 AND p.mod_id <> c.mod_id""")  # fmt: skip
def broken_inheritance(m: Model, depth: int = DEPTH) -> DataFrame:
    """One mod changes a parent's property, another touches a descendant more than one step below."""
    chain = reach(m, "extends", depth).filter("depth > 1")
    # Each side distinct, so the pairs are distinct as they are made; names of one type are keys.
    parents = _targets(m, m.mod_xml_operations.filter("operation in ('set', 'remove') and property_name is not null")).select(F.col("entity_id").alias("target"), F.col("target_name").alias("parent_entity"), F.col("mod_id").alias("mod1_id")).distinct()
    children = with_mod(m, m.mod_xml_operations).select(F.col("target_type").alias("definition_type"), F.col("target_name").alias("child_entity"), F.col("mod_id").alias("mod2_id")).distinct()
    below = m.xml_definitions.select(F.col("id").alias("source"), "definition_type", F.col("name").alias("child_entity"))
    chain = chain.join(below, "source").select("target", "definition_type", "child_entity", "depth").distinct()
    both = chain.join(children, ["definition_type", "child_entity"]).join(parents, "target").filter("mod1_id <> mod2_id")
    return both.select("mod1_id", "mod2_id", F.col("target").alias("entity_id"), "parent_entity", "child_entity", "depth")


def _pairs(m: Model, rows: DataFrame, on: list[str], condition: str) -> DataFrame:
    """Unordered mod pairs on the same ``on`` columns; sides are a and b."""
    # Distinct before the pairs: repeated changes of a hot property would meet each other many times over.
    sides = with_mod(m, rows, name="name").select(*on, "mod_id", "name", "operation", "new_value").distinct()
    a, b = (sides.select(*on, F.struct("mod_id", "name", "operation", "new_value").alias(c)) for c in "ab")
    return a.join(b, on).filter(F.expr(f"a.mod_id < b.mod_id and ({condition})"))


@query("cnf_17_h3_conflicting_base_values", """
    WITH given AS (
      SELECT DISTINCT d.id AS entity_id, d.name AS entity, o.property_name, o.mod_id, o.new_value, mods.name AS mod FROM xml_definitions d
      JOIN mod_xml_operations o ON o.target_type = d.definition_type AND o.target_name = d.name AND o.operation = 'set' AND o.property_name IS NOT NULL AND o.new_value IS NOT NULL JOIN mods ON mods.id = o.mod_id)
    SELECT x.mod_id AS mod1_id, y.mod_id AS mod2_id, entity_id, property_name, x.new_value AS val1, y.new_value AS val2, x.mod AS mod1, y.mod AS mod2, x.entity
    FROM given x JOIN given y USING (entity_id, property_name) WHERE y.mod_id > x.mod_id AND NOT x.new_value = y.new_value""")  # fmt: skip
def conflicting_base_values(m: Model) -> DataFrame:
    """Two mods set one property to different values."""
    rows = _targets(m, m.mod_xml_operations.filter("operation = 'set' and property_name is not null"))
    both = _pairs(m, rows, ["entity_id", "target_name", "property_name"], "a.new_value <> b.new_value")
    return both.selectExpr("a.mod_id as mod1_id", "b.mod_id as mod2_id", "entity_id", "property_name", "a.new_value as val1", "b.new_value as val2", "a.name as mod1", "b.name as mod2", "target_name as entity").distinct()


@query("cnf_18_h4_orphaned_buff", """
    WITH applied AS (SELECT target_name AS buff, count(*) AS ref_count FROM xml_references WHERE target_type = 'buff' AND contains(lower(reference_context), 'addbuff') GROUP BY target_name),
    gone AS (SELECT mod_id, target_name AS buff FROM mod_xml_operations WHERE (operation, target_type) = ('remove', 'buff') GROUP BY 1, 2),
    known AS (SELECT id, name FROM xml_definitions WHERE definition_type = 'buff')
    SELECT gone.mod_id, known.id AS entity_id, buff AS buff_name, mods.name AS remover_mod, ref_count FROM gone JOIN applied USING (buff) JOIN known ON known.name = buff JOIN mods ON mods.id = gone.mod_id""")  # fmt: skip
def orphaned_buff(m: Model) -> DataFrame:
    """A removed buff is still applied somewhere."""
    gone = _targets(m, m.mod_xml_operations.filter("operation = 'remove' and target_type = 'buff'"), remover_mod="name").select("mod_id", "entity_id", F.col("target_name").alias("buff_name"), "remover_mod").distinct()
    refs = m.xml_references.filter(F.col("reference_context").ilike("%AddBuff%") & (F.col("target_type") == "buff")).groupBy(F.col("target_name").alias("buff_name")).agg(n().alias("ref_count"))
    return gone.join(refs, "buff_name").select("mod_id", "entity_id", "buff_name", "remover_mod", "ref_count")


@query("cnf_19_h5_recipe_conflict", """
    WITH hands AS (SELECT target_name AS recipe_name, mod_id, min(name) AS mod FROM mod_xml_operations JOIN mods ON mods.id = mod_id WHERE target_type = 'recipe' GROUP BY ALL)
    SELECT x.mod_id AS mod1_id, y.mod_id AS mod2_id, id AS entity_id, recipe_name, x.mod AS mod1, y.mod AS mod2
    FROM hands x JOIN hands y USING (recipe_name) JOIN (SELECT id, name AS recipe_name FROM xml_definitions WHERE definition_type = 'recipe') k USING (recipe_name) WHERE x.mod_id < y.mod_id""")  # fmt: skip
def recipe_conflict(m: Model) -> DataFrame:
    """Two mods change one recipe."""
    both = _pairs(m, _targets(m, m.mod_xml_operations.filter("target_type = 'recipe'")), ["entity_id", "target_name"], "true")
    return both.selectExpr("a.mod_id as mod1_id", "b.mod_id as mod2_id", "entity_id", "target_name as recipe_name", "a.name as mod1", "b.name as mod2").distinct()


@query("cnf_20_h6_loot_breakage", """
    WITH listed AS (SELECT target_name AS item, count(*) AS loot_ref_count FROM xml_references WHERE reference_context = 'loot_entry' GROUP BY 1),
    gone AS (SELECT DISTINCT target_name AS item, mod_id FROM mod_xml_operations WHERE (operation, target_type) = ('remove', 'item'))
    SELECT gone.mod_id, k.id AS entity_id, item AS removed_item, mods.name AS item_remover, loot_ref_count
    FROM listed JOIN gone USING (item) JOIN (SELECT id, name AS item FROM xml_definitions WHERE definition_type = 'item') k USING (item) JOIN mods ON mods.id = gone.mod_id""")  # fmt: skip
def loot_breakage(m: Model) -> DataFrame:
    """A removed item is still in loot lists."""
    gone = _targets(m, m.mod_xml_operations.filter("operation = 'remove' and target_type = 'item'"), item_remover="name").select("mod_id", "entity_id", F.col("target_name").alias("removed_item"), "item_remover").distinct()
    refs = m.xml_references.filter("reference_context = 'loot_entry'").groupBy(F.col("target_name").alias("removed_item")).agg(n().alias("loot_ref_count"))
    return gone.join(refs, "removed_item").select("mod_id", "entity_id", "removed_item", "item_remover", "loot_ref_count")


@query("cnf_21_h7_entity_class_conflict", """
    WITH acts AS (SELECT target_name AS entity_class, property_name, mod_id, operation, new_value FROM mod_xml_operations WHERE target_type = 'entity_class' AND property_name IS NOT NULL AND mod_id IN (SELECT id FROM mods) GROUP BY ALL),
    met AS (SELECT entity_class, property_name, x.mod_id AS mod1_id, y.mod_id AS mod2_id, x.new_value AS val1, y.new_value AS val2 FROM acts x JOIN acts y USING (entity_class, property_name)
      WHERE x.mod_id < y.mod_id AND NOT (x.new_value = y.new_value AND x.operation = y.operation) GROUP BY ALL)
    SELECT mod1_id, mod2_id, k.id AS entity_id, entity_class, property_name, val1, val2 FROM met JOIN (SELECT id, name AS entity_class FROM xml_definitions WHERE definition_type = 'entity_class') k USING (entity_class)""")  # fmt: skip
def entity_class_conflict(m: Model) -> DataFrame:
    """Two mods change one property of an entity class, by value or operation."""
    rows = _targets(m, m.mod_xml_operations.filter("target_type = 'entity_class' and property_name is not null"))
    both = _pairs(m, rows, ["entity_id", "target_name", "property_name"], "a.new_value <> b.new_value or a.operation <> b.operation")
    return both.selectExpr("a.mod_id as mod1_id", "b.mod_id as mod2_id", "entity_id", "target_name as entity_class", "property_name", "a.new_value as val1", "b.new_value as val2").distinct()


@query("cnf_22_m1_transitive_property_override", CLOSURE_SQL + """
    , changed AS (SELECT target_name AS parent, property_name, mod_id FROM mod_xml_operations WHERE property_name IS NOT NULL AND mod_id IN (SELECT id FROM mods) GROUP BY ALL), named AS (SELECT id, name FROM xml_definitions)
    SELECT mod_id AS mod1_id, mod_id AS mod2_id, far.target AS entity_id, changed.parent, below.name AS child, property_name, far.depth
    FROM (SELECT * FROM ext WHERE depth BETWEEN 2 AND 10) far JOIN named above ON above.id = far.target JOIN changed ON changed.parent = above.name JOIN named below ON below.id = far.source ORDER BY 1, 3, 5, 6, 7 LIMIT 100""")  # fmt: skip
def transitive_property_override(m: Model, depth: int = DEPTH, limit: int | None = 100, chain: DataFrame | None = None) -> DataFrame:
    """A property change of a parent reaches descendants two or more steps below; the first hundred by mod and entity."""
    chain = (reach(m, "extends", depth) if chain is None else chain).filter("depth >= 2")
    names = m.xml_definitions.select("id", "name")
    parents = names.withColumnsRenamed({"id": "target", "name": "parent"}).distinct()
    children = names.withColumnsRenamed({"id": "source", "name": "child"})
    changes = with_mod(m, m.mod_xml_operations.filter("property_name is not null")).select(F.col("target_name").alias("parent"), "property_name", "mod_id").distinct()
    if limit:  # every mod and entity that meet give a row, so the first rows are of that many first ones
        chain = chain.join(children.select("source"), "source", "left_semi")
        above = parents.join(chain.select("target").distinct(), "target")
        heads = settled(above.join(changes.select("parent", "mod_id"), "parent").select("mod_id", "target").distinct().orderBy("mod_id", "target").limit(limit))
        chain = chain.join(F.broadcast(heads.select("target").distinct()), "target", "left_semi")
        changes = changes.join(F.broadcast(heads.select("mod_id").distinct()), "mod_id", "left_semi")
    # Each side distinct, so the rows are.
    below = chain.join(children, "source").select("target", "child", "depth").distinct()
    out = below.join(parents, "target").join(changes, "parent")
    out = out.join(F.broadcast(heads), ["mod_id", "target"], "left_semi") if limit else out
    out = out.select(F.col("mod_id").alias("mod1_id"), F.col("mod_id").alias("mod2_id"), F.col("target").alias("entity_id"), "parent", "child", "property_name", "depth")
    return out.orderBy("mod1_id", "entity_id", "child", "property_name", "depth").limit(limit) if limit else out


@query("cnf_23_m2_buff_chain_interference", """
    WITH buffs AS (SELECT id, name FROM xml_definitions WHERE definition_type = 'buff'),
    links AS (SELECT source_def_id AS source, target_name AS buff2 FROM xml_references WHERE target_type = 'buff' AND contains(lower(reference_context), 'addbuff') GROUP BY ALL),
    hands AS (SELECT target_name AS buff, mod_id FROM mod_xml_operations WHERE target_type = 'buff' AND mod_id IN (SELECT id FROM mods) GROUP BY ALL)
    SELECT x.mod_id AS mod1_id, y.mod_id AS mod2_id, t.id AS entity_id, x.buff AS buff1, y.buff AS buff2, 1 AS depth
    FROM links JOIN buffs f ON f.id = source JOIN buffs t ON t.name = buff2 AND t.id <> f.id JOIN hands x ON x.buff = f.name JOIN hands y ON y.buff = buff2 WHERE y.mod_id > x.mod_id ORDER BY 1, 2, 3, 4 LIMIT 50""")  # fmt: skip
def buff_chain_interference(m: Model, limit: int | None = 50) -> DataFrame:
    """Two mods change both ends of an AddBuff reference. Only direct references keep their full context, so depth is 1."""
    buffs = m.xml_definitions.filter("definition_type = 'buff'").select("id", "name")
    ends = buffs.withColumnsRenamed({"id": "entity_id", "name": "buff2"})
    starts = buffs.withColumnsRenamed({"id": "source_def_id", "name": "buff1"})
    edges = m.xml_references.filter(F.col("reference_context").ilike("%AddBuff%") & (F.col("target_type") == "buff")).select("source_def_id", F.col("target_name").alias("buff2")).distinct().join(ends, "buff2").join(starts, "source_def_id")
    edges = edges.filter("source_def_id <> entity_id").select("entity_id", "buff1", "buff2").distinct()
    touched = with_mod(m, m.mod_xml_operations.filter("target_type = 'buff'")).select("target_name", "mod_id").distinct()
    a, b = touched.withColumnsRenamed({"target_name": "buff1", "mod_id": "mod1_id"}), touched.withColumnsRenamed({"target_name": "buff2", "mod_id": "mod2_id"})
    out = edges.join(a, "buff1").join(b, "buff2").filter("mod1_id < mod2_id").select("mod1_id", "mod2_id", "entity_id", "buff1", "buff2", F.lit(1).alias("depth"))
    return out.orderBy("mod1_id", "mod2_id", "entity_id", "buff1").limit(limit) if limit else out


@query("cnf_24_m3_shared_parent", CLOSURE_SQL + """
    , leaning AS (SELECT target AS id, count(*) AS n FROM reach GROUP BY target), hands AS (SELECT target_type AS definition_type, target_name AS name, mod_id FROM mod_xml_operations GROUP BY ALL),
    sums AS (SELECT definition_type, h.name, count(*) AS mod_count, string_agg(DISTINCT mods.name, ',' ORDER BY mods.name) AS mods FROM hands h JOIN mods ON mods.id = mod_id GROUP BY 1, 2 HAVING count(*) > 1)
    SELECT d.id AS entity_id, name AS parent_name, mod_count, mods, coalesce(n, 0) AS dependent_count FROM (SELECT * FROM xml_definitions WHERE extends IS NULL AND list_contains(['item', 'block', 'entity_class'], definition_type)) d
    JOIN sums USING (definition_type, name) LEFT JOIN leaning ON leaning.id = d.id ORDER BY dependent_count DESC, entity_id LIMIT 50""")  # fmt: skip
def shared_parent(m: Model, depth: int = DEPTH, limit: int = 50) -> DataFrame:
    """Several mods change a root entity that others depend on."""
    roots = m.xml_definitions.filter("extends is null and definition_type in ('item', 'block', 'entity_class')").select(F.col("id").alias("entity_id"))
    rows = _targets(m, m.mod_xml_operations, mod="name").join(roots, "entity_id", "left_semi")
    grouped = rows.groupBy("entity_id", F.col("target_name").alias("parent_name")).agg(F.countDistinct("mod_id").alias("mod_count"), csv(F.col("mod")).alias("mods")).filter("mod_count >= 2")
    dependents = reach(m, None, depth).groupBy(F.col("target").alias("entity_id")).agg(n().alias("dependent_count"))
    out = grouped.join(dependents, "entity_id", "left").withColumn("dependent_count", F.coalesce("dependent_count", F.lit(0)))
    return out.orderBy(F.desc("dependent_count"), "entity_id").limit(limit)


@query("cnf_25_m4_recipe_ingredient_change", """
    WITH hands AS (SELECT target_type AS kind, target_name AS thing, mod_id FROM mod_xml_operations WHERE mod_id IN (SELECT id FROM mods) GROUP BY ALL),
    parts AS (SELECT source_def_id AS entity_id, target_name AS ingredient FROM xml_references WHERE reference_context = 'recipe_ingredient' GROUP BY ALL),
    cooks AS (SELECT d.id AS entity_id, d.name AS recipe, mod_id FROM hands JOIN xml_definitions d ON d.name = thing AND d.definition_type = kind WHERE kind = 'recipe')
    SELECT DISTINCT cooks.mod_id AS mod1_id, h.mod_id AS mod2_id, entity_id, recipe, ingredient FROM cooks JOIN parts USING (entity_id) JOIN hands h ON h.thing = ingredient WHERE NOT h.mod_id = cooks.mod_id ORDER BY 1, 2, 3, 5 LIMIT 50""")  # fmt: skip
def recipe_ingredient_change(m: Model, limit: int | None = 50) -> DataFrame:
    """A recipe and one of its ingredients are changed by different mods."""
    parts = m.xml_references.filter("reference_context = 'recipe_ingredient'").select(F.col("source_def_id").alias("entity_id"), F.col("target_name").alias("ingredient")).distinct()
    recipes = _targets(m, m.mod_xml_operations.filter("target_type = 'recipe'")).select("entity_id", F.col("target_name").alias("recipe"), F.col("mod_id").alias("mod1_id")).distinct()
    others = with_mod(m, m.mod_xml_operations).select(F.col("target_name").alias("ingredient"), F.col("mod_id").alias("mod2_id")).distinct()
    out = parts.join(recipes, "entity_id").join(others, "ingredient").filter("mod1_id <> mod2_id").select("mod1_id", "mod2_id", "entity_id", "recipe", "ingredient")
    return out.orderBy("mod1_id", "mod2_id", "entity_id", "ingredient").limit(limit) if limit else out


def _stacked(m: Model, rows: DataFrame, least: int, limit: int, entry) -> DataFrame:
    grouped = _targets(m, rows, mod="name").groupBy("entity_id", F.col("target_name").alias("entity_name"), F.col("target_type").alias("definition_type")).agg(F.countDistinct("mod_id").alias("mod_count"), csv(entry).alias("mods"))
    return grouped.filter(F.col("mod_count") >= least).orderBy(F.desc("mod_count"), "entity_id").limit(limit)


@query("cnf_26_l1_additive_stacking", """
    WITH hands AS (SELECT target_type AS definition_type, target_name AS name, mod_id FROM mod_xml_operations WHERE operation = 'append' GROUP BY ALL),
    sums AS (SELECT definition_type, h.name, count(*) AS mod_count, string_agg(DISTINCT mods.name, ',' ORDER BY mods.name) AS mods FROM hands h JOIN mods ON mods.id = mod_id GROUP BY 1, 2)
    SELECT id AS entity_id, name AS entity_name, definition_type, mod_count, mods FROM sums JOIN xml_definitions USING (definition_type, name) WHERE mod_count > 1 ORDER BY mod_count DESC, entity_id LIMIT 30""")  # fmt: skip
def additive_stacking(m: Model) -> DataFrame:
    """Several mods append to one entity; the thirty with most mods."""
    return _stacked(m, m.mod_xml_operations.filter("operation = 'append'"), 2, 30, F.col("mod"))


@query("cnf_27_l2_same_entity_enhancement", """
    WITH acts AS (SELECT target_type AS definition_type, target_name AS entity_name, mod_id, mods.name || ':' || operation AS act FROM mod_xml_operations JOIN mods ON mods.id = mod_id WHERE NOT starts_with(operation, 'remove') GROUP BY ALL),
    sums AS (SELECT definition_type, entity_name, count(DISTINCT mod_id) AS mod_count, string_agg(DISTINCT act, ',' ORDER BY act) AS mods FROM acts GROUP BY 1, 2)
    SELECT d.id AS entity_id, entity_name, sums.definition_type, mod_count, mods FROM sums JOIN xml_definitions d ON (d.definition_type, d.name) = (sums.definition_type, entity_name) WHERE mod_count > 2 ORDER BY mod_count DESC, entity_id LIMIT 20""")  # fmt: skip
def same_entity_enhancement(m: Model) -> DataFrame:
    """Three or more mods change one entity without removing; the twenty with most mods."""
    return _stacked(m, m.mod_xml_operations.filter(~F.col("operation").isin(*REMOVALS)), 3, 20, F.concat("mod", F.lit(":"), "operation"))


@query("cnf_28_l3_related_group", """
    WITH members AS (SELECT target_name AS group_name, d.name AS member FROM xml_references r JOIN xml_definitions d ON d.id = r.source_def_id WHERE reference_context = 'group_member' GROUP BY ALL),
    hands AS (SELECT target_name AS member, mod_id, mods.name AS mod FROM mod_xml_operations JOIN mods ON mods.id = mod_id GROUP BY ALL),
    sums AS (SELECT group_name, count(DISTINCT mod_id) AS mod_count, string_agg(DISTINCT mod, ',' ORDER BY mod) AS mods FROM members JOIN hands USING (member) GROUP BY 1)
    SELECT * FROM sums WHERE mod_count > 1 ORDER BY mod_count DESC, group_name LIMIT 20""")  # fmt: skip
def related_group(m: Model) -> DataFrame:
    """Several mods change members of one group; the twenty groups with most mods."""
    members = m.xml_references.filter("reference_context = 'group_member'").select("source_def_id", F.col("target_name").alias("group_name")).distinct()
    names = m.xml_definitions.select(F.col("id").alias("source_def_id"), F.col("name").alias("target_name"))
    touched = with_mod(m, m.mod_xml_operations, mod="name").select("target_name", "mod_id", "mod").distinct()
    grouped = members.join(names, "source_def_id").join(touched, "target_name").groupBy("group_name").agg(F.countDistinct("mod_id").alias("mod_count"), csv(F.col("mod")).alias("mods"))
    return grouped.filter("mod_count >= 2").orderBy(F.desc("mod_count"), "group_name").limit(20)


SEVERITY = {f"{level[0].upper()}{k}": level for level, many in (("high", 7), ("medium", 4), ("low", 3)) for k in range(1, many + 1)}


def indirect_conflicts(m: Model, patterns: set[str] | None = None, chain: DataFrame | None = None) -> DataFrame:
    """All indirect conflicts, or those of some patterns: pattern_id, severity, mod1_id, mod2_id, entity_id; 0 stands for no mod or entity. chain: M1's, if at hand."""
    none = F.lit(0).cast("long")
    sections = [
        ("H1", "high", deleted_entity_referenced, "mod_id", None), ("H2", "high", broken_inheritance, "mod1_id", "mod2_id"),
        ("H3", "high", conflicting_base_values, "mod1_id", "mod2_id"), ("H4", "high", orphaned_buff, "mod_id", None),
        ("H5", "high", recipe_conflict, "mod1_id", "mod2_id"), ("H6", "high", loot_breakage, "mod_id", None),
        ("H7", "high", entity_class_conflict, "mod1_id", "mod2_id"), ("M1", "medium", transitive_property_override, "mod1_id", "mod2_id"),
        ("M2", "medium", buff_chain_interference, "mod1_id", "mod2_id"), ("M3", "medium", shared_parent, None, None),
        ("M4", "medium", recipe_ingredient_change, "mod1_id", "mod2_id"), ("L1", "low", additive_stacking, None, None),
        ("L2", "low", same_entity_enhancement, None, None), ("L3", "low", related_group, None, None),
    ]
    out = None
    for pattern, severity, f, mod1, mod2 in sections:
        if patterns is not None and pattern not in patterns:
            continue
        rows = f(m, chain=chain) if pattern == "M1" else f(m)
        entity = F.col("entity_id") if "entity_id" in rows.columns else none
        part = rows.select(F.lit(pattern).alias("pattern_id"), F.lit(severity).alias("severity"), (F.col(mod1) if mod1 else none).alias("mod1_id"), (F.col(mod2) if mod2 else none).alias("mod2_id"), entity.alias("entity_id"))
        out = part if out is None else out.unionByName(part)
    return out


def persistable(m: Model, conflicts: DataFrame) -> DataFrame:
    """Those whose mods and entity exist; patterns without a second mod fall away, as in the reference's store."""
    ids = m.mods.select("id")
    kept = conflicts.join(ids.withColumnRenamed("id", "mod1_id"), "mod1_id", "left_semi").join(ids.withColumnRenamed("id", "mod2_id"), "mod2_id", "left_semi")
    return kept.join(m.xml_definitions.select(F.col("id").alias("entity_id")), "entity_id", "left_semi")


class _Numbered:
    """A model's changes stored once by number, for counts of conflicts that make no pairs.

    changes: e, k, entity_id, target_type, mod_id, w, operation, property_name, new_value. A definition's e stands for its id and name,
    k for its type and name, w says how many names a mod has. All are exact with ids and names that repeat.
    """

    def __init__(self, m: Model):
        ops = settled(m.mod_xml_operations.select("mod_id", "operation", "target_type", "target_name", "property_name", "new_value"))
        defs = settled(m.xml_definitions.select("id", "definition_type", "name", "extends"))
        refs = m.xml_references.columns
        refs = settled(m.xml_references.select(*(c for c in ("id", "source_def_id", "target_type", "target_name", "reference_context") if c in refs)))
        self.model = Model(m.spark, tables={"mod_xml_operations": ops, "xml_definitions": defs, "xml_references": refs, "mods": m.mods})
        number = lambda *c: settled(defs.select(*c).distinct().withColumn("__n", F.monotonically_increasing_id()))
        e, k = number("id", "name").withColumnRenamed("__n", "e"), number("definition_type", "name").withColumnRenamed("__n", "k")
        self.defs = settled(defs.select("id", "definition_type", "name").distinct().join(e, ["id", "name"]).join(k, ["definition_type", "name"]))
        ids = self.defs.select(F.col("id").alias("entity_id"), F.col("definition_type").alias("target_type"), F.col("name").alias("target_name"), "e", "k")
        names = m.mods.select("id", "name").distinct().groupBy(F.col("id").alias("mod_id")).agg(n().alias("w"))
        self.chain = settled(reach(self.model, "extends").filter("depth > 1"))
        self.changes = settled(ops.join(ids, ["target_type", "target_name"]).join(names, "mod_id").drop("target_name"))

    def sides(self) -> tuple[DataFrame, DataFrame, DataFrame]:
        """H2's chains (target, k), and its distinct changes of parents (target, e, mod_id) and children (k, mod_id)."""
        names = self.defs.select(F.col("id").alias("source"), "k")
        chain = self.chain.join(names, "source").select("target", "k", "depth").distinct().select("target", "k")
        deep = self.changes.filter("operation in ('set', 'remove') and property_name is not null")
        return settled(chain), deep.select(F.col("entity_id").alias("target"), "e", "mod_id").distinct(), self.changes.select("k", "mod_id").distinct()

    def h2(self) -> DataFrame:
        """All parents' mods by all children's, less those of one mod."""
        chain, parents, children = self.sides()
        parents = settled(parents.join(chain.select("target").distinct(), "target", "left_semi"))
        many = chain.join(parents.groupBy("target").agg(n().alias("p")), "target").join(children.groupBy("k").agg(n().alias("c")), "k")
        same = chain.join(parents.select("target", "mod_id"), "target").join(children, ["k", "mod_id"])
        return many.agg(_whole(F.col("p") * F.col("c")).alias("n")).unionByName(same.agg(_whole(F.lit(-1)).alias("n"))).agg(F.sum("n").alias("n"))

    def h3(self) -> DataFrame:
        rows = self.changes.filter("operation = 'set' and property_name is not null and new_value is not null")
        rows = rows.select("e", "property_name", "mod_id", "new_value", "w").repartition("e", "property_name").distinct()
        return _met(rows, ["e", "property_name"], "mod_id", "new_value")

    def h5(self) -> DataFrame:
        return _met(self.changes.filter("target_type = 'recipe'").select("e", "mod_id", "w").repartition("e").distinct(), ["e"], "mod_id")

    def h7(self) -> DataFrame:
        """Pairs of a mod and value that differ in value or, by some of their operations, in operation."""
        on = ["e", "property_name"]
        rows = self.changes.filter("target_type = 'entity_class' and property_name is not null").select(*on, "mod_id", "new_value", "operation").repartition(*on)
        rows = rows.groupBy(*on, "mod_id", "new_value").agg(F.min("operation").alias("least"), F.max("operation").alias("most")).withColumn("w", F.lit(1).cast("long"))
        valued, acting, single = rows.filter("new_value is not null"), rows.filter("least is not null"), rows.filter("least = most")
        parts = [
            (1, _met(valued, on, "mod_id", "new_value")), (1, _met(acting, on, "mod_id")), (-1, _met(single, [*on, "least"], "mod_id")),  # by value; by operation
            (-1, _met(valued.filter("least is not null"), on, "mod_id", "new_value")), (1, _met(valued.filter("least = most"), [*on, "least"], "mod_id", "new_value")),  # by both
        ]
        return _sum(*parts)

    def groups(self, rows: DataFrame, on: list[str], least: int, limit: int) -> DataFrame:
        """How many groups with ``least`` mods at least, up to ``limit``."""
        mods = F.min("mod_id") != F.max("mod_id") if least == 2 else F.countDistinct("mod_id") >= least
        return rows.select(*on, "mod_id").groupBy(*on).agg(mods.alias("many")).filter("many").limit(limit).agg(n().cast(WHOLE).alias("n"))

    def m3(self, limit: int = 50) -> DataFrame:
        roots = self.model.xml_definitions.filter("extends is null and definition_type in ('item', 'block', 'entity_class')").select(F.col("id").alias("entity_id"))
        return self.groups(self.changes.join(roots, "entity_id", "left_semi"), ["e"], 2, limit)

    def l1(self) -> DataFrame:
        return self.groups(self.changes.filter("operation = 'append'"), ["entity_id", "k"], 2, 30)

    def l2(self) -> DataFrame:
        return self.groups(self.changes.filter(~F.col("operation").isin(*REMOVALS)), ["entity_id", "k"], 3, 20)


#: Exact sums of products.
WHOLE = "decimal(38,0)"


def _whole(x: Column) -> Column:
    return F.coalesce(F.sum(x.cast(WHOLE)), F.lit(0)).cast(WHOLE)


def _sum(*parts: tuple[int, DataFrame]) -> DataFrame:
    out = None
    for sign, part in parts:
        part = part.select((F.col("n") * sign).cast(WHOLE).alias("n"))
        out = part if out is None else out.unionByName(part)
    return out.agg(_whole(F.col("n")).alias("n"))


def _met(rows: DataFrame, on: list[str], *differ: str) -> DataFrame:
    """n: unordered pairs of rows (each w times) equal in ``on`` and different in every one of ``differ``, by squares of sums instead of pairs."""
    parts = []
    for k in range(len(differ) + 1):
        for same in combinations(differ, k):
            w = rows.groupBy(*on, *same).agg(F.sum("w").cast(WHOLE).alias("w"))
            parts.append(((-1) ** k, w.agg(_whole(F.col("w") * F.col("w")).alias("n"))))
    return _sum(*parts).select((F.col("n") / 2).cast(WHOLE).alias("n"))


#: Patterns whose rows are mods that meet, or groups in the order of their size: counted, not listed.
PAIRS = {"H2": _Numbered.h2, "H3": _Numbered.h3, "H5": _Numbered.h5, "H7": _Numbered.h7}
GROUPS = {"M3": _Numbered.m3, "L1": _Numbered.l1, "L2": _Numbered.l2}


def _of_mods(m: Model) -> set[str]:
    """The patterns whose rows name two mods there are; where no mod has the number 0, which stands for none, those with one or none fall away."""
    return {"H2", "H3", "H5", "H7", "M1", "M2", "M4"} if m.mods.filter("id = 0").isEmpty() else set(SEVERITY)


def conflict_counts(m: Model, kept: bool = False) -> DataFrame:
    """pattern_id, severity, n of ``indirect_conflicts``, or of its ``persistable`` ones, without a row for each."""
    numbered = _Numbered(m)
    counted, patterns = PAIRS | GROUPS, _of_mods(m) if kept else set(SEVERITY)
    counted = {k: f for k, f in counted.items() if k in patterns}
    listed = indirect_conflicts(numbered.model, patterns - set(counted), numbered.chain)
    listed = persistable(numbered.model, listed) if kept else listed
    out = listed.groupBy("pattern_id", "severity").agg(n().cast(WHOLE).alias("n"))
    for pattern, f in counted.items():
        out = out.unionByName(f(numbered).select(F.lit(pattern).alias("pattern_id"), F.lit(SEVERITY[pattern]).alias("severity"), "n"))
    return out.filter("n > 0").withColumn("n", F.col("n").cast("long"))


@query("cnf_29_persistable_conflicts")
def persistable_counts(m: Model) -> DataFrame:
    """How many conflicts of each pattern the store would keep."""
    return conflict_counts(m, kept=True).select("pattern_id", "n")


@query("cnf_30_conflict_summary")
def conflict_summary(m: Model, conflicts: DataFrame | None = None) -> DataFrame:
    rows = conflict_counts(m) if conflicts is None else conflicts.groupBy("pattern_id", "severity").agg(n().alias("n"))
    return rows.groupBy("severity").agg(F.sum("n").alias("conflict_count"), csv(F.col("pattern_id")).alias("patterns_found"))


@query("cnf_30_mod_interaction_matrix")
def mod_interaction_matrix(m: Model, conflicts: DataFrame | None = None) -> DataFrame:
    """Which pairs of mods meet how often."""
    rows = indirect_conflicts(m, _of_mods(m)) if conflicts is None else conflicts
    level = F.col("severity")
    grouped = rows.groupBy("mod1_id", "mod2_id").agg(n().alias("interaction_count"), total(level == "high").alias("high_count"), total(level == "medium").alias("medium_count"), total(level == "low").alias("low_count"))
    names = m.mods.select("id", "name")
    both = grouped.join(names.withColumnsRenamed({"id": "mod1_id", "name": "mod1_name"}), "mod1_id").join(names.withColumnsRenamed({"id": "mod2_id", "name": "mod2_name"}), "mod2_id")
    return both.drop("mod1_id", "mod2_id")
