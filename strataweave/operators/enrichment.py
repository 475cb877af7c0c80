"""What a finding's page shows beside the finding: its entity, who calls it, how it is reached, what it means, what it calls, what
it derives from. One row a finding, a struct or list a section; ``enrichment_json`` gives the sections as JSON.

Lists are cut where the page cuts them (ten callers, five chains, twenty callees), by rank before anything is gathered, so that a
method that everything calls is no large group.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..model import Model, n, query
from ..sources import source_code as sc
from . import text
from .code import ENGINE_CALLBACKS
from .graph import settled
from .hierarchy import ancestors

#: Calls that name an entity in a line of code, and the entity's type.
NAMING_CALLS = [("item", r"(?:GetItem|GetItemClass|ItemClass\.GetForId)"), ("block", r"(?:GetBlockByName|GetBlockValue)"), ("buff", r"(?:AddBuff|RemoveBuff|HasBuff)"), ("sound", r"(?:Play|PlayOneShot|BroadcastPlay)")]
#: What a finding is about, by the entity's type and by its own kind, and how open to change it is.
CATEGORY_OF_ENTITY = {
    "buff": "Status Effect", "item": "Item Reference", "block": "Block Reference", "entity_class": "Entity Spawn", "sound": "Audio Reference", "recipe": "Crafting", "quest": "Quest System",
}
CATEGORY = {
    "hookable_event": "Extension Point", "console_command": "Debug Tool", "singleton_access": "System Access", "stub_method": "Incomplete Implementation", "unimplemented": "Missing Feature",
    "empty_catch": "Error Handling", "todo": "Developer Note",
}
MODDABILITY = {"hardcoded_entity": "requires_harmony", "hookable_event": "safe_to_extend", "stub_method": "good_hook_point"}
CONFIDENCE = {"active": 0.95, "moderate": 0.85, "low": 0.7, "internal": 0.5, "unused": 0.8}
#: What to do about a finding, in our own words.
ADVICE = {
    "hardcoded_entity": "Keep the name and change what it stands for, or patch the code that looks for it.", "hookable_event": "Run code after the event, or before it where its effect has to be kept back.",
    "stub_method": "Put code in front of the empty method and skip it.",
}
OTHER_ADVICE = "Read the code around it: a config change, a patch or an event may do."


def _looked_up(key: Column, table: dict, default) -> Column:
    return F.coalesce(F.try_element_at(F.create_map(*(F.lit(x) for kv in table.items() for x in kv)), key), F.lit(default))


def entry_point(method: Column) -> Column:
    """What calls a method from outside: the engine, the console, an event, the start of the program; null for none of these."""
    low = F.lower(method)
    return F.when(method.isin(*ENGINE_CALLBACKS), "unity").when(low.startswith("cmd") | (low == "execute"), "console").when(low.startswith("on"), "event").when(low == "main", "main")


def semantic_context(analysis_type: Column, entity_name: Column, entity_type: Column) -> Column:
    """struct(category, moddability_level, reasoning, actionable_advice, related_concerns)."""
    hard = analysis_type == "hardcoded_entity"
    category = F.when(hard, _looked_up(entity_type, CATEGORY_OF_ENTITY, "Game Entity")).otherwise(_looked_up(analysis_type, CATEGORY, "Code Pattern"))
    reasoning = F.when(entity_name.isNotNull() & (entity_name != ""), F.concat(F.lit("The code looks for "), F.coalesce(entity_type, F.lit("a name")), F.lit(" '"), entity_name, F.lit("' and fails without it."))).otherwise(F.concat(category, F.lit(" in code.")))
    concerns = F.array_compact(F.array(
        F.when(hard, "Hardcoded references cannot be changed via XML"), F.when(hard & (entity_type == "buff"), "Consider Harmony patch to intercept buff application"),
        F.when(hard & (entity_type == "item"), "Item replacements may require ItemClass patch"),
    ))
    return F.struct(category.alias("category"), reasoning.alias("reasoning"), _looked_up(analysis_type, MODDABILITY, "review_required").alias("moddability_level"), _looked_up(analysis_type, ADVICE, OTHER_ADVICE).alias("actionable_advice"), concerns.alias("related_concerns"))


def entities(findings: DataFrame, definitions: DataFrame) -> DataFrame:
    """id -> entity_name, entity_type, xml_status (found, code_only), xml_file, fuzzy_matches of the findings that name an entity.

    The name is what ``related_entities`` says; of hardcoded entities else what the line of code says.
    """
    given = F.from_json("related_entities", "entity_name string, entity_type string")
    code = F.when(F.col("analysis_type") == "hardcoded_entity", F.col("code_snippet"))
    calls = [(kind, F.nullif(F.regexp_extract(code, call + r'\s*\([^"()]*"([^"]+)"', 1), F.lit(""))) for kind, call in NAMING_CALLS]
    name = F.coalesce(F.nullif(given["entity_name"], F.lit("")), *(x for _, x in calls))
    kind = F.coalesce(F.nullif(given["entity_type"], F.lit("")), *(F.when(x.isNotNull(), k) for k, x in calls))
    rows = findings.select("id", name.alias("entity_name"), kind.alias("entity_type")).filter("entity_name is not null")
    known = definitions.groupBy(F.lower("name").alias("key"), F.col("definition_type").alias("entity_type")).agg(F.min("file_path").alias("xml_file"))
    typed = rows.withColumn("key", F.lower("entity_name")).join(known, ["key", "entity_type"], "left")
    typed = settled(typed.select("id", "entity_name", "entity_type", F.when(F.col("xml_file").isNotNull(), "found").otherwise("code_only").alias("xml_status"), "xml_file"))
    lost = typed.filter("xml_status = 'code_only'").select(F.col("entity_name").alias("name")).distinct()
    best = text.fuzzy_match(lost, definitions.select(F.col("name").alias("known"), F.col("definition_type").alias("kind")))
    lists = best.groupBy(F.col("name").alias("entity_name")).agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "known", "kind", "score"))), lambda x: F.struct(x["known"].alias("name"), x["kind"].alias("type"), x["score"].alias("score"))).alias("fuzzy_matches"))  # five a name
    return typed.join(lists, "entity_name", "left")


def _targets(m: Model) -> DataFrame:
    """id, class, method of all methods; keys are lower case."""
    types = m.types.select(F.col("id").alias("type_id"), F.col("name").alias("class"))
    return m.methods.join(types, "type_id").select("id", "class", F.col("name").alias("method"), "signature")


def callers(m: Model) -> DataFrame:
    """One row for each method that is called, by class and method in lower case: caller_count, external_count, the first ten callers
    and the chains through the first five, by class, method and line."""
    names = settled(_targets(m))
    side = lambda p: names.select(F.col("id").alias(f"{p}_id"), F.col("class").alias(f"{p}_class"), F.col("method").alias(f"{p}_method"))
    sites = m.calls.select("caller_id", "callee_id", "line_number", "call_type").join(side("caller"), "caller_id").join(side("callee"), "callee_id")
    sites = settled(sites.select(F.lower("callee_class").alias("c"), F.lower("callee_method").alias("f"), "caller_class", "caller_method", "line_number", (F.lower("caller_class") != F.lower("callee_class")).alias("outside")))
    counts = sites.groupBy("c", "f").agg(n().alias("caller_count"), F.count_if("outside").alias("external_count"))
    order = Window.partitionBy("c", "f").orderBy("caller_class", "caller_method", "line_number")
    first = settled(sites.withColumn("k", F.row_number().over(order)).filter("k <= 10"))
    parent = first.filter("k = 1").select(F.col("c").alias("pc"), F.col("f").alias("pf"), F.col("caller_class").alias("up_class"), F.col("caller_method").alias("up_method"))
    step = lambda c, f, entry: F.struct(c.alias("class"), f.alias("method"), entry.alias("entry_point_type"))
    entry, none = entry_point(F.col("caller_method")), F.lit(None).cast("string")
    up = first.filter("k <= 5").join(parent, (F.lower("caller_class") == F.col("pc")) & (F.lower("caller_method") == F.col("pf")), "left")
    own = F.array(step(F.col("caller_class"), F.col("caller_method"), entry))
    above = F.array(step(F.col("up_class"), F.col("up_method"), entry_point(F.col("up_method"))), step(F.col("caller_class"), F.col("caller_method"), none))
    chain = F.when(entry.isNotNull() | F.col("up_class").isNull(), own).otherwise(above)
    sorted_ = lambda x: F.transform(F.array_sort(F.collect_list(x)), lambda s: s["v"])
    chains = up.groupBy("c", "f").agg(sorted_(F.struct("k", chain.alias("v"))).alias("call_chains"))
    tens = first.groupBy("c", "f").agg(sorted_(F.struct("k", F.struct("caller_class", "caller_method", "line_number").alias("v"))).alias("method_callers"))
    return counts.join(tens, ["c", "f"]).join(chains, ["c", "f"])


def callees(m: Model) -> DataFrame:
    """By class and method: callee_count (twenty at most) and the first twenty callees by class, method and line."""
    names = settled(_targets(m))
    side = lambda p: names.select(F.col("id").alias(f"{p}_id"), F.col("class").alias(f"{p}_class"), F.col("method").alias(f"{p}_method"), F.col("signature").alias(f"{p}_signature"))
    sites = m.calls.join(side("caller"), "caller_id").join(side("callee"), "callee_id")
    order = Window.partitionBy("caller_class", "caller_method").orderBy("callee_class", "callee_method", "line_number", "callee_id")
    first = sites.withColumn("k", F.row_number().over(order)).filter("k <= 20")
    lists = F.array_sort(F.collect_list(F.struct("k", F.struct("callee_class", "callee_method", F.col("callee_signature").alias("signature"), "call_type", "line_number").alias("v"))))
    return first.groupBy("caller_class", "caller_method").agg(n().alias("callee_count"), F.transform(lists, lambda s: s["v"]).alias("callees"))


def hierarchies(m: Model) -> DataFrame:
    """class -> base_classes from the nearest up, ten at most."""
    names = m.types.select(F.col("id").alias("up"), F.col("name").alias("base"))
    steps = ancestors(m.types).select("id", F.posexplode(F.reverse("path")).alias("k", "up")).filter("k between 1 and 10").join(names, "up")
    lists = steps.groupBy("id").agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "base"))), lambda s: s["base"]).alias("base_classes"))  # ten a class
    return m.types.select("id", F.col("name").alias("class")).join(lists, "id").drop("id")


def enrichment(m: Model, findings: DataFrame | None = None, sources: DataFrame | None = None) -> DataFrame:
    """All nine sections. findings: id, analysis_type, class_name, method_name, file_path, line_number, code_snippet, related_entities;
    sources: file_path, content. A section that has nothing to show is null."""
    g = m.game_code_analysis if findings is None else findings
    g = g if "code_snippet" in g.columns else g.withColumn("code_snippet", F.lit(None).cast("string"))
    e = entities(g, m.xml_definitions)
    rows = g.select("id", "analysis_type", F.col("class_name").alias("class"), F.col("method_name").alias("method"), "file_path", "line_number")
    rows = rows.withColumns({"c": F.lower("class"), "f": F.lower("method")}).join(callers(m), ["c", "f"], "left")
    rows = rows.join(callees(m), (F.col("class") == F.col("caller_class")) & (F.col("method") == F.col("caller_method")), "left").join(hierarchies(m), "class", "left").join(e, "id", "left")
    total, outside = F.coalesce("caller_count", F.lit(0).cast("long")), F.coalesce("external_count", F.lit(0).cast("long"))
    named = F.coalesce((F.col("class") != "") & (F.col("method") != ""), F.lit(False))
    engine = F.col("method").isin(*ENGINE_CALLBACKS)
    level = F.when(outside >= 5, "active").when(outside >= 2, "moderate").when(outside == 1, "low").when(total > 0, "internal").otherwise("unused")
    dead_why = F.when(engine, "The engine calls it").when(total == 0, "No callers found in decompiled code").when(outside == 0, "Only called internally within same class").otherwise(F.concat(F.lit("Called by "), outside.cast("string"), F.lit(" external location(s)")))
    dead = F.struct(
        (~engine & (total == 0)).alias("is_likely_dead"), F.when(engine, 0.1).when(total == 0, 0.8).when(outside == 0, 0.5).otherwise(0.1).alias("confidence"), dead_why.alias("reasoning"),
        total.alias("caller_count"), outside.alias("external_caller_count"), F.coalesce("method_callers", F.array().cast("array<struct<caller_class:string,caller_method:string,line_number:bigint>>")).alias("method_callers"),
    )
    target = F.array(F.struct(F.col("class"), F.col("method"), F.lit(None).cast("string").alias("entry_point_type")))
    chains = F.transform(F.coalesce("call_chains", F.array().cast("array<array<struct<class:string,method:string,entry_point_type:string>>>")), lambda c: F.concat(c, target))
    reach = F.struct(level.alias("usage_level"), _looked_up(level, CONFIDENCE, 0.3).alias("confidence"), total.alias("caller_count"), chains.alias("call_chains"))
    when = lambda condition, section: F.when(condition, section)
    out = rows.select(
        "id", "file_path", "line_number", "entity_name", "xml_status", "xml_file", "fuzzy_matches", when(named, dead).alias("dead_code_analysis"), when(named, level).alias("usage_level"), when(named, reach).alias("reachability"),
        semantic_context(F.col("analysis_type"), F.col("entity_name"), F.col("entity_type")).alias("semantic_context"), when(F.col("callees").isNotNull(), F.struct("callee_count", "callees")).alias("callees"),
        when(F.col("base_classes").isNotNull(), F.struct("base_classes", F.size("base_classes").alias("depth"))).alias("type_hierarchy"),
    )
    if sources is None:
        return out.withColumn("source_context", F.lit(None).cast("struct<method_body:string,method_start_line:bigint,method_end_line:bigint>")).drop("file_path", "line_number")
    bodies = sc.scan(sources, sc.bodies, sc.BODY_COLUMNS).select("file_path", F.struct(F.col("body").alias("method_body"), F.col("first_line").alias("method_start_line"), F.col("last_line").alias("method_end_line")).alias("source_context"))
    spans = out.join(bodies, "file_path", "left").withColumn("source_context", F.when(F.col("line_number").between(F.col("source_context.method_start_line"), F.col("source_context.method_end_line")), F.col("source_context")))
    narrow = spans.groupBy("id").agg(F.min_by("source_context", F.col("source_context.method_end_line") - F.col("source_context.method_start_line")).alias("source_context"))  # the innermost
    return out.join(narrow, "id", "left").drop("file_path", "line_number")


def enrichment_json(m: Model, **args) -> DataFrame:
    """The sections as JSON texts, as they are stored."""
    rows = enrichment(m, **args)
    sections = {"fuzzy_matches", "dead_code_analysis", "reachability", "semantic_context", "source_context", "callees", "type_hierarchy"}
    return rows.select(*(F.to_json(c).alias(c) if c in sections else c for c in rows.columns))


def _findings(m: Model) -> DataFrame:
    """The tables' findings, in the methods of their ids, and with lines that name definitions, some with a letter too many."""
    names = _targets(m).select("id", "class", "method")
    defs = m.xml_definitions.select("id", F.col("name").alias("entity"))
    rows = m.game_code_analysis.drop("class_name", "method_name").join(names, "id").join(defs, "id")
    call = F.when(F.col("id") % 3 == 0, "p.AddBuff(").when(F.col("id") % 3 == 1, "ItemClass.GetItem(").otherwise("Block.GetBlockByName(")
    name = F.concat(F.when(F.col("id") % 2 == 0, "x").otherwise(""), F.col("entity"))
    snippet = F.concat(F.lit("var v = "), call, F.lit('"'), name, F.lit('");'))
    return rows.select("id", "analysis_type", F.col("class").alias("class_name"), F.col("method").alias("method_name"), "file_path", "line_number", snippet.alias("code_snippet"), "related_entities")


_CALLERS_SQL = """
    WITH RECURSIVE t AS (SELECT me.id, ty.name AS class, me.name AS method FROM methods me JOIN types ty ON ty.id = me.type_id),
    g AS (SELECT g.id, g.analysis_type, t.class, t.method, d.name AS entity FROM game_code_analysis g JOIN t ON t.id = g.id JOIN xml_definitions d ON d.id = g.id),
    site AS (SELECT b.class AS c, b.method AS f, a.class AS caller_class, a.method AS caller_method, calls.line_number, a.class <> b.class AS outside FROM calls JOIN t a ON a.id = calls.caller_id JOIN t b ON b.id = calls.callee_id),
    k AS (SELECT c, f, count(*) AS total, CAST(sum(CASE WHEN outside THEN 1 ELSE 0 END) AS BIGINT) AS outside FROM site GROUP BY 1, 2)"""


@query("cod_19_enrichment", _CALLERS_SQL + """
    , r AS (SELECT *, row_number() OVER (PARTITION BY c, f ORDER BY caller_class, caller_method, line_number) AS o FROM site),
    ten AS (SELECT c, f, string_agg(caller_class || '.' || caller_method, ',' ORDER BY o) AS callers FROM r WHERE o <= 10 GROUP BY 1, 2),
    up AS (SELECT ty.name AS class, ty.base_type AS base, 1 AS k FROM types ty WHERE ty.base_type IS NOT NULL UNION ALL SELECT up.class, ty.base_type, up.k + 1 FROM up JOIN types ty ON ty.name = up.base WHERE ty.base_type IS NOT NULL AND up.k < 10),
    h AS (SELECT class, string_agg(base, '>' ORDER BY k) AS bases FROM up GROUP BY 1)
    SELECT g.id, CASE WHEN coalesce(k.outside, 0) >= 5 THEN 'active' WHEN coalesce(k.outside, 0) >= 2 THEN 'moderate' WHEN coalesce(k.outside, 0) = 1 THEN 'low' WHEN coalesce(k.total, 0) > 0 THEN 'internal' ELSE 'unused' END AS usage_level,
      g.method NOT IN ('Update', 'LateUpdate') AND coalesce(k.total, 0) = 0 AS is_likely_dead, CAST(CASE WHEN g.method IN ('Update', 'LateUpdate') THEN 0.1 WHEN coalesce(k.total, 0) = 0 THEN 0.8 WHEN k.outside = 0 THEN 0.5 ELSE 0.1 END AS DOUBLE) AS dead_confidence,
      coalesce(k.total, 0) AS caller_count, coalesce(k.outside, 0) AS external_caller_count, coalesce(ten.callers, '') AS callers, coalesce(h.bases, '') AS bases
    FROM g LEFT JOIN k ON k.c = g.class AND k.f = g.method LEFT JOIN ten ON ten.c = g.class AND ten.f = g.method LEFT JOIN h ON h.class = g.class""")  # fmt: skip
def enriched_callers(m: Model) -> DataFrame:
    """Usage, signs of dead code, callers and bases of every finding."""
    rows = enrichment(m, _findings(m))
    d = F.col("dead_code_analysis")
    names = F.array_join(F.transform(d["method_callers"], lambda c: F.concat_ws(".", c["caller_class"], c["caller_method"])), ",")
    bases = F.coalesce(F.array_join("type_hierarchy.base_classes", ">"), F.lit(""))
    return rows.select("id", "usage_level", d["is_likely_dead"].alias("is_likely_dead"), d["confidence"].alias("dead_confidence"), d["caller_count"].alias("caller_count"), d["external_caller_count"].alias("external_caller_count"), names.alias("callers"), bases.alias("bases"))


@query("cod_19_call_chains", _CALLERS_SQL + """
    , r AS (SELECT *, row_number() OVER (PARTITION BY c, f ORDER BY caller_class, caller_method, line_number) AS o FROM site),
    ch AS (SELECT r.c, r.f, r.o, CASE WHEN r.caller_method IN ('Update', 'LateUpdate') THEN r.caller_class || '.' || r.caller_method || '(unity)' WHEN p.c IS NULL THEN r.caller_class || '.' || r.caller_method
        ELSE p.caller_class || '.' || p.caller_method || CASE WHEN p.caller_method IN ('Update', 'LateUpdate') THEN '(unity)' ELSE '' END || '>' || r.caller_class || '.' || r.caller_method END AS s
      FROM r LEFT JOIN r p ON p.c = r.caller_class AND p.f = r.caller_method AND p.o = 1 WHERE r.o <= 5),
    one AS (SELECT c, f, string_agg(s || '>' || c || '.' || f, ';' ORDER BY o) AS chains FROM ch GROUP BY 1, 2),
    ce AS (SELECT a.class AS c, a.method AS f, b.class || '.' || b.method AS s, row_number() OVER (PARTITION BY a.class, a.method ORDER BY b.class, b.method, calls.line_number, calls.callee_id) AS o FROM calls JOIN t a ON a.id = calls.caller_id JOIN t b ON b.id = calls.callee_id),
    outs AS (SELECT c, f, string_agg(s, ',' ORDER BY o) AS callees FROM ce WHERE o <= 20 GROUP BY 1, 2)
    SELECT g.id, coalesce(one.chains, '') AS chains, coalesce(outs.callees, '') AS callees FROM g LEFT JOIN one ON one.c = g.class AND one.f = g.method LEFT JOIN outs ON outs.c = g.class AND outs.f = g.method""")  # fmt: skip
def enriched_chains(m: Model) -> DataFrame:
    """How every finding's method is reached, and what it calls."""
    rows = enrichment(m, _findings(m))
    step = lambda s: F.concat(s["class"], F.lit("."), s["method"], F.when(s["entry_point_type"].isNotNull(), F.concat(F.lit("("), s["entry_point_type"], F.lit(")"))).otherwise(""))
    chains = F.transform("reachability.call_chains", lambda c: F.array_join(F.transform(c, step), ">"))
    calls = F.array_join(F.transform("callees.callees", lambda c: F.concat_ws(".", c["callee_class"], c["callee_method"])), ",")
    return rows.select("id", F.array_join(chains, ";").alias("chains"), F.coalesce(calls, F.lit("")).alias("callees"))


@query("cod_23_semantic_context", """
    WITH g AS (SELECT g.id, g.analysis_type, analysis_type = 'hardcoded_entity' AS hard, CASE g.id % 3 WHEN 0 THEN 'buff' WHEN 1 THEN 'item' ELSE 'block' END AS kind, CASE WHEN g.id % 2 = 0 THEN 'x' ELSE '' END || d.name AS entity FROM game_code_analysis g JOIN xml_definitions d ON d.id = g.id JOIN methods me ON me.id = g.id)
    SELECT g.id, CASE WHEN hard THEN CASE kind WHEN 'buff' THEN 'Status Effect' WHEN 'item' THEN 'Item Reference' ELSE 'Block Reference' END WHEN analysis_type = 'stub_method' THEN 'Incomplete Implementation' WHEN analysis_type = 'unimplemented' THEN 'Missing Feature'
        WHEN analysis_type = 'empty_catch' THEN 'Error Handling' WHEN analysis_type = 'todo' THEN 'Developer Note' ELSE 'Code Pattern' END AS category,
      CASE analysis_type WHEN 'hardcoded_entity' THEN 'requires_harmony' WHEN 'stub_method' THEN 'good_hook_point' ELSE 'review_required' END AS moddability, CAST(CASE WHEN hard THEN CASE WHEN kind = 'block' THEN 1 ELSE 2 END ELSE 0 END AS INTEGER) AS concerns,
      CASE WHEN hard THEN entity END AS entity_name, CASE WHEN hard THEN CASE WHEN x.name IS NULL THEN 'code_only' ELSE 'found' END END AS xml_status, x.file_path AS xml_file
    FROM g LEFT JOIN xml_definitions x ON hard AND x.definition_type = kind AND lower(x.name) = lower(entity)""")  # fmt: skip
def enriched_meaning(m: Model) -> DataFrame:
    """What every finding is about, how open to change it is, and whether its entity is defined."""
    rows = enrichment(m, _findings(m))
    s = F.col("semantic_context")
    return rows.select("id", s["category"].alias("category"), s["moddability_level"].alias("moddability"), F.size(s["related_concerns"]).alias("concerns"), "entity_name", "xml_status", "xml_file")
