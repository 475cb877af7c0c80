"""Edges, bounded closures and chain walks over definitions, classes and calls.

Closures are semi-naive loops: each round joins the frontier with the edges, keeps what is new, and is written to the
session's shared folder and read again, so that plans stay short and a lost executor costs one round.

A closure goes ten steps, as the rule it stands for does.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..model import Model, csv, n, query
from ..session import shared_dir

DEPTH = 10

CLOSURE_SQL = """
    WITH RECURSIVE edges AS (
      SELECT DISTINCT d.id AS s, p.id AS t, 'extends' AS kind FROM xml_definitions d JOIN xml_definitions p ON d.extends = p.name AND d.definition_type = p.definition_type WHERE d.id <> p.id
      UNION SELECT r.source_def_id, p.id, r.reference_context FROM xml_references r JOIN xml_definitions p ON r.target_name = p.name AND r.target_type = p.definition_type WHERE r.source_def_id <> p.id),
    walk AS (SELECT s, t, 1 AS depth FROM edges UNION SELECT w.s, e.t, w.depth + 1 FROM walk w JOIN edges e ON w.t = e.s WHERE w.depth < 10 AND w.s <> e.t),
    reach AS (SELECT s AS source, t AS target, min(depth) AS depth FROM walk GROUP BY 1, 2),
    up AS (SELECT s, t, 1 AS depth FROM edges WHERE kind = 'extends' UNION SELECT u.s, e.t, u.depth + 1 FROM up u JOIN edges e ON u.t = e.s WHERE e.kind = 'extends' AND u.depth < 10 AND u.s <> e.t),
    ext AS (SELECT s AS source, t AS target, min(depth) AS depth FROM up GROUP BY 1, 2)
"""


def settled(df: DataFrame) -> DataFrame:
    """``df`` written below the session's shared folder and read again."""
    path = f"{shared_dir(df.sparkSession)}/rounds/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@query("grf_02_direct_edges", CLOSURE_SQL + " SELECT s AS source, t AS target, kind AS ref_type FROM edges")
def direct_edges(m: Model) -> DataFrame:
    """Distinct edges: extends, and references by name and type."""
    defs = m.xml_definitions
    targets = defs.select(F.col("id").alias("target"), F.col("name").alias("target_name"), F.col("definition_type").alias("target_type"))
    extends = defs.filter("extends is not null and extends <> ''").select(F.col("id").alias("source"), F.col("extends").alias("target_name"), F.col("definition_type").alias("target_type"), F.lit("extends").alias("ref_type"))
    refs = m.xml_references.select(F.col("source_def_id").alias("source"), "target_name", "target_type", F.col("reference_context").alias("ref_type"))
    return extends.unionByName(refs).join(targets, ["target_name", "target_type"]).filter("source <> target").select("source", "target", "ref_type").distinct()


def closure(m: Model, kind: str | None = None, depth: int = DEPTH) -> DataFrame:
    """source, target, depth, path, reference_types of every reachable pair within ``depth`` steps, by a shortest path.

    Of equally short paths the least path text is kept. path: JSON array of ``type:id`` steps. reference_types:
    distinct types of the path, cut at their first colon once a path has two steps.
    """
    edges = direct_edges(m)
    edges = edges if kind is None else edges.filter(F.col("ref_type") == kind)
    edges = settled(edges.groupBy(F.col("source").alias("es"), F.col("target").alias("et")).agg(F.min("ref_type").alias("er")))
    step = F.concat("er", F.lit(":"), F.col("et").cast("string"))
    frontier = edges.select(F.col("es").alias("source"), F.col("et").alias("target"), F.array(step).alias("path"), F.array("er").alias("kinds"))
    frontier = seen = settled(frontier.withColumn("depth", F.lit(1)))
    for d in range(2, depth + 1):
        longer = frontier.join(edges, F.col("target") == F.col("es")).filter("source <> et").select("source", F.col("et").alias("target"), F.concat("path", F.array(step)).alias("path"), F.concat("kinds", F.array("er")).alias("kinds"))
        new = longer.join(seen.select("source", "target"), ["source", "target"], "left_anti").groupBy("source", "target").agg(F.min(F.struct("path", "kinds")).alias("best"))
        frontier = settled(new.select("source", "target", "best.path", "best.kinds", F.lit(d).alias("depth")))
        if frontier.isEmpty():
            break
        seen = seen.unionByName(frontier)
    cut = F.transform("kinds", lambda k: F.substring_index(k, ":", 1))
    types = F.when(F.col("depth") == 1, F.col("kinds")).otherwise(cut)
    return seen.select("source", "target", "depth", F.to_json("path").alias("path"), F.array_join(F.array_sort(F.array_distinct(types)), ",").alias("reference_types"))


def reach(m: Model, kind: str | None = None, depth: int = DEPTH) -> DataFrame:
    """source, target, depth of every reachable pair within ``depth`` steps: ``closure`` without the paths, which take most of its room."""
    edges = direct_edges(m)
    edges = edges if kind is None else edges.filter(F.col("ref_type") == kind)
    edges = settled(edges.select("source", "target").distinct())
    step = edges.select(F.col("source").alias("es"), F.col("target").alias("et"))
    frontier = seen = edges.withColumn("depth", F.lit(1))
    for d in range(2, depth + 1):
        longer = frontier.join(step, F.col("target") == F.col("es")).filter("source <> et").select("source", F.col("et").alias("target")).distinct()
        frontier = settled(longer.join(seen.select("source", "target"), ["source", "target"], "left_anti").withColumn("depth", F.lit(d)))
        if frontier.isEmpty():
            break
        seen = seen.unionByName(frontier)
    return seen


@query("grf_04_transitive_closure", CLOSURE_SQL + " SELECT source, target, depth FROM reach")
def transitive_closure(m: Model, depth: int = DEPTH) -> DataFrame:
    """Reachable pairs within ``depth`` steps."""
    return reach(m, None, depth)


@query("grf_05_impact_analysis", CLOSURE_SQL + """
    , one AS (SELECT min(id) AS id FROM xml_definitions WHERE definition_type = 'item')
    SELECT 'dependent' AS side, d.id AS entity_id, d.name, d.definition_type, r.depth FROM reach r JOIN one ON r.target = one.id JOIN xml_definitions d ON d.id = r.source
    UNION ALL SELECT 'requirement', d.id, d.name, d.definition_type, r.depth FROM reach r JOIN one ON r.source = one.id JOIN xml_definitions d ON d.id = r.target""")  # fmt: skip
def impact_of_first_item(m: Model, depth: int = DEPTH) -> DataFrame:
    first = m.xml_definitions.filter("definition_type = 'item'").agg(F.min("id").alias("id"))
    return impact(m, first, depth)


def impact(m: Model, entity: DataFrame, depth: int = DEPTH) -> DataFrame:
    """What depends on the entities in ``entity`` (id) and what they need."""
    pairs = reach(m, None, depth)
    defs = m.xml_definitions.select(F.col("id").alias("entity_id"), "name", "definition_type")
    down = pairs.join(entity, F.col("target") == F.col("id")).select(F.lit("dependent").alias("side"), F.col("source").alias("entity_id"), "depth")
    up = pairs.join(entity, F.col("source") == F.col("id")).select(F.lit("requirement").alias("side"), F.col("target").alias("entity_id"), "depth")
    return down.unionByName(up).join(defs, "entity_id").select("side", "entity_id", "name", "definition_type", "depth")


@query("grf_06_inheritance_hotspots", CLOSURE_SQL + """
    SELECT d.name AS base_entity, d.definition_type, count(*) AS dependent_count, CASE WHEN count(*) > 100 THEN 'CRITICAL' WHEN count(*) > 50 THEN 'HIGH' WHEN count(*) > 20 THEN 'MEDIUM' ELSE 'LOW' END AS risk_level
    FROM reach r JOIN xml_definitions d ON r.target = d.id GROUP BY r.target, d.name, d.definition_type""")  # fmt: skip
def inheritance_hotspots(m: Model, depth: int = DEPTH) -> DataFrame:
    """How many entities depend on each, with a risk band."""
    counts = reach(m, None, depth).groupBy("target").agg(n().alias("dependent_count"))
    c = F.col("dependent_count")
    risk = F.when(c > 100, "CRITICAL").when(c > 50, "HIGH").when(c > 20, "MEDIUM").otherwise("LOW")
    return counts.join(m.xml_definitions, F.col("target") == F.col("id")).select(F.col("name").alias("base_entity"), "definition_type", "dependent_count", risk.alias("risk_level"))


@query("grf_07_hotspots_with_dependents", CLOSURE_SQL + """
    SELECT d.name AS base_entity, d.definition_type, count(DISTINCT r.source) AS dependent_count, string_agg(DISTINCT s.name, ',' ORDER BY s.name) AS dependents
    FROM reach r JOIN xml_definitions d ON r.target = d.id JOIN xml_definitions s ON r.source = s.id GROUP BY d.id, d.name, d.definition_type ORDER BY dependent_count DESC, d.id LIMIT 25""")  # fmt: skip
def hotspots_with_dependents(m: Model, depth: int = DEPTH) -> DataFrame:
    """The 25 entities most depended on, with their dependents."""
    defs = m.xml_definitions
    pairs = reach(m, None, depth)
    top = pairs.groupBy("target").agg(F.countDistinct("source").alias("dependent_count")).orderBy(F.desc("dependent_count"), "target").limit(25)
    names = defs.select(F.col("id").alias("source"), F.col("name").alias("dependent"))
    lists = pairs.join(F.broadcast(top), "target").join(names, "source").groupBy("target", "dependent_count").agg(csv(F.col("dependent")).alias("dependents"))
    return lists.join(defs, F.col("target") == F.col("id")).select(F.col("name").alias("base_entity"), "definition_type", "dependent_count", "dependents")


@query("grf_08_dependency_stats", CLOSURE_SQL + """
    , a AS (SELECT source AS id, count(*) AS n, max(depth) AS depth FROM reach GROUP BY 1), b AS (SELECT target AS id, count(*) AS n FROM reach GROUP BY 1)
    SELECT d.id, d.name, coalesce(a.n, 0) AS dependencies, coalesce(b.n, 0) AS dependents, coalesce(a.depth, 0) AS max_depth FROM xml_definitions d LEFT JOIN a USING (id) LEFT JOIN b USING (id) WHERE a.n IS NOT NULL OR b.n IS NOT NULL""")  # fmt: skip
def dependency_stats(m: Model, depth: int = DEPTH) -> DataFrame:
    """For each entity in some dependency: how many it needs, how many need it, how deep."""
    pairs = reach(m, None, depth)
    needs = pairs.groupBy(F.col("source").alias("id")).agg(n().alias("dependencies"), F.max("depth").alias("max_depth"))
    needed = pairs.groupBy(F.col("target").alias("id")).agg(n().alias("dependents"))
    both = needs.join(needed, "id", "full_outer").join(m.xml_definitions.select("id", "name"), "id")
    zero = F.lit(0).cast("long")
    return both.select("id", "name", F.coalesce("dependencies", zero).alias("dependencies"), F.coalesce("dependents", zero).alias("dependents"), F.coalesce("max_depth", F.lit(0)).alias("max_depth"))


@query("grf_10_inheritance_chain", """
    WITH RECURSIVE walk AS (SELECT class_name, class_name AS cur, 0 AS depth FROM class_inheritance UNION ALL SELECT w.class_name, c.parent_class, w.depth + 1 FROM walk w JOIN class_inheritance c ON c.class_name = w.cur WHERE c.parent_class IS NOT NULL AND w.depth < 10)
    SELECT class_name, cur AS ancestor, depth FROM walk WHERE depth > 0""")  # fmt: skip
def inheritance_chain(m: Model, depth: int = 10) -> DataFrame:
    """Each class with its ancestors, up to ``depth`` steps."""
    return _chain(m.class_inheritance.filter("parent_class is not null").select(F.col("class_name").alias("c"), F.col("parent_class").alias("p")), depth).withColumnsRenamed({"child": "class_name"})


def _chain(parents: DataFrame, depth: int) -> DataFrame:
    """child, ancestor, depth over c -> p; a class met again ends its walk."""
    parents = settled(parents)
    frontier = out = settled(parents.select(F.col("c").alias("child"), F.col("p").alias("ancestor"), F.lit(1).alias("depth")))
    for d in range(2, depth + 1):
        up = frontier.join(parents, F.col("ancestor") == F.col("c")).select("child", F.col("p").alias("ancestor"), F.lit(d).alias("depth")).filter("child <> ancestor")
        frontier = settled(up.join(out.select("child", "ancestor"), ["child", "ancestor"], "left_anti"))
        if frontier.isEmpty():
            break
        out = out.unionByName(frontier)
    return out


@query("grf_09_base_class_chain", """
    WITH RECURSIVE walk AS (SELECT name, name AS cur, 0 AS depth FROM types UNION ALL SELECT w.name, t.base_type, w.depth + 1 FROM walk w JOIN types t ON t.name = w.cur WHERE t.base_type IS NOT NULL AND w.depth < 10)
    SELECT name AS type_name, string_agg(cur, '>' ORDER BY depth) AS chain FROM walk GROUP BY 1""")  # fmt: skip
def base_class_chain(m: Model) -> DataFrame:
    """Each type with its bases from itself upward, joined by '>'."""
    parents = m.types.filter("base_type is not null").select(F.col("name").alias("c"), F.col("base_type").alias("p"))
    own = m.types.select(F.col("name").alias("child"), F.col("name").alias("ancestor"), F.lit(0).alias("depth"))
    steps = own.unionByName(_chain(parents, 10)).groupBy(F.col("child").alias("type_name")).agg(F.array_sort(F.collect_list(F.struct("depth", "ancestor"))).alias("s"))
    return steps.select("type_name", F.array_join(F.transform("s", lambda x: x["ancestor"]), ">").alias("chain"))


@query("grf_01_call_chains", """
    WITH RECURSIVE e AS (SELECT DISTINCT caller_id AS s, callee_id AS t FROM calls), walk AS (SELECT s, t, [s, t] AS path, 1 AS depth FROM e WHERE s = 1
      UNION ALL SELECT w.s, e.t, list_append(w.path, e.t), w.depth + 1 FROM walk w JOIN e ON w.t = e.s WHERE w.depth < 10 AND NOT list_contains(w.path, e.t))
    SELECT s AS source, t AS target, depth, array_to_string(path, '>') AS path FROM walk""")  # fmt: skip
def call_chains_of_first(m: Model) -> DataFrame:
    return call_chains(m, m.methods.filter("id = 1").select("id"))


def call_chains(m: Model, sources: DataFrame, depth: int = 10, target: int | None = None, limit: int | None = None) -> DataFrame:
    """Simple call paths from the methods in ``sources`` (id), guarded by ids; to ``target`` only, the shortest first, if given."""
    edges = settled(m.calls.select(F.col("caller_id").alias("es"), F.col("callee_id").alias("et")).distinct())
    frontier = edges.join(sources, F.col("es") == F.col("id")).select(F.col("es").alias("source"), F.col("et").alias("target"), F.array("es", "et").alias("ids"), F.lit(1).alias("depth"))
    frontier = out = settled(frontier)
    for d in range(2, depth + 1):
        longer = frontier.join(edges, F.col("target") == F.col("es")).filter(~F.array_contains("ids", F.col("et")))
        frontier = settled(longer.select("source", F.col("et").alias("target"), F.concat("ids", F.array("et")).alias("ids"), F.lit(d).alias("depth")))
        if frontier.isEmpty():
            break
        out = out.unionByName(frontier)
    out = out.select("source", "target", "depth", F.array_join(F.col("ids").cast("array<string>"), ">").alias("path"))
    if target is not None:
        out = out.filter(F.col("target") == target).orderBy("depth", "path")
    return out.limit(limit) if limit else out


@query("grf_12_two_level_callers", """
    WITH c AS (SELECT DISTINCT callee_id, caller_id FROM calls), r AS (SELECT callee_id, caller_id, row_number() OVER (PARTITION BY callee_id ORDER BY caller_id) AS k FROM c)
    SELECT r.callee_id AS method_id, r.caller_id, coalesce(x.caller_id, 0) AS upper_id, CASE WHEN me.name IN ('Update', 'LateUpdate') THEN 'engine' WHEN x.caller_id IS NULL THEN 'entry' ELSE 'inner' END AS tag
    FROM r JOIN methods me ON me.id = r.caller_id LEFT JOIN r x ON x.callee_id = r.caller_id AND x.k = 1 WHERE r.k <= 5""")  # fmt: skip
def two_level_callers(m: Model) -> DataFrame:
    """Up to five callers of each method, one caller above each, and what kind of entry that is."""
    from pyspark.sql import Window

    order = Window.partitionBy("callee_id").orderBy("caller_id")
    ranked = m.calls.select("callee_id", "caller_id").distinct().withColumn("k", F.row_number().over(order))
    upper = ranked.filter("k = 1").select(F.col("callee_id").alias("caller_id"), F.col("caller_id").alias("upper_id"))
    names = m.methods.select(F.col("id").alias("caller_id"), "name")
    tag = F.when(F.col("name").isin("Update", "LateUpdate"), "engine").when(F.col("upper_id").isNull(), "entry").otherwise("inner")
    return ranked.filter("k <= 5").join(names, "caller_id").join(upper, "caller_id", "left").select(F.col("callee_id").alias("method_id"), "caller_id", F.coalesce("upper_id", F.lit(0).cast("long")).alias("upper_id"), tag.alias("tag"))


@query("grf_13_implementations", """
    SELECT t.full_name AS type_name, me.name AS method_name, me.signature, CASE WHEN me.is_override THEN 'override' WHEN me.is_abstract THEN 'abstract' WHEN me.is_virtual THEN 'virtual' ELSE '' END AS modifier, t.base_type
    FROM methods me JOIN types t ON me.type_id = t.id WHERE me.name = 'Update'""")  # fmt: skip
def implementations(m: Model, name: str = "Update") -> DataFrame:
    """All methods of a name with their modifier and base type."""
    modifier = F.when(F.col("is_override"), "override").when(F.col("is_abstract"), "abstract").when(F.col("is_virtual"), "virtual").otherwise("")
    rows = m.methods.filter(F.col("name") == name).select("type_id", F.col("name").alias("method_name"), "signature", modifier.alias("modifier"))
    return rows.join(m.types.select(F.col("id").alias("type_id"), F.col("full_name").alias("type_name"), "base_type"), "type_id").drop("type_id")


@query("grf_11_override_chain", """
    WITH RECURSIVE up AS (SELECT name, name AS cur, 0 AS depth FROM types UNION ALL SELECT u.name, t.base_type, u.depth + 1 FROM up u JOIN types t ON t.name = u.cur WHERE t.base_type IS NOT NULL AND u.depth < 10)
    SELECT DISTINCT a.id AS method_id, b.id AS base_method_id, up.depth FROM methods a JOIN types ta ON a.type_id = ta.id JOIN up ON up.name = ta.name AND up.depth > 0
    JOIN types tb ON tb.name = up.cur JOIN methods b ON b.type_id = tb.id AND b.name = a.name""")  # fmt: skip
def override_chain(m: Model) -> DataFrame:
    """Methods with the methods of the same name in their base types."""
    parents = m.types.filter("base_type is not null").select(F.col("name").alias("c"), F.col("base_type").alias("p"))
    types = m.types.select(F.col("id").alias("type_id"), F.col("name").alias("type_name"))
    own = m.methods.select(F.col("id").alias("mid"), "type_id", F.col("name").alias("method")).join(types, "type_id")
    # Each side distinct, so the pairs are distinct as they are made; ids of methods are keys.
    below = own.select(F.col("mid").alias("method_id"), F.col("type_name").alias("child"), "method").distinct()
    above = own.select(F.col("mid").alias("base_method_id"), F.col("type_name").alias("ancestor"), "method").distinct()
    return below.join(_chain(parents, 10).distinct(), "child").join(above, ["ancestor", "method"]).select("method_id", "base_method_id", "depth")
