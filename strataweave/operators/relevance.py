"""How relevant a finding is: connectivity, entity, mods, keywords, less what marks artifacts."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..model import REGISTRY, Model, n, query
from .graph import settled

#: Weight of each factor.
WEIGHTS = {"connectivity": 1.0, "entity": 1.2, "mod": 1.5, "keyword": 0.8}
#: Points of entity words in a class name.
ENTITY_POINTS = {
    "Item": 40, "ItemClass": 40, "Block": 35, "BlockClass": 35, "Entity": 30, "EntityClass": 30, "Recipe": 25, "Buff": 20, "Effect": 20, "Vehicle": 20,
    "Quest": 15, "Trader": 15, "UI": 10, "Window": 10, "XUi": 10, "Sound": 10, "Audio": 10,
}
#: Keyword, category, multiplier.
KEYWORDS = [
    ("Inventory", "inventory", 1.5), ("Backpack", "inventory", 1.3), ("ItemStack", "inventory", 1.2), ("Container", "inventory", 1.2), ("Slot", "inventory", 1.1),
    ("Damage", "combat", 1.3), ("Attack", "combat", 1.2), ("Weapon", "combat", 1.2), ("EntityAlive", "combat", 1.1), ("Hit", "combat", 1.1),
    ("Recipe", "crafting", 1.3), ("Craft", "crafting", 1.2), ("Workstation", "crafting", 1.2),
    ("Skill", "progression", 1.2), ("Perk", "progression", 1.2), ("Level", "progression", 1.1), ("XP", "progression", 1.1),
    ("Trader", "trading", 1.3), ("Vending", "trading", 1.2), ("Buy", "trading", 1.1), ("Sell", "trading", 1.1),
    ("Spawn", "spawning", 1.2), ("Sleeper", "spawning", 1.2), ("Horde", "spawning", 1.1),
    ("NetPackage", "network", 1.2), ("RPC", "network", 1.1), ("Sync", "network", 1.1),
    ("Debug", "artifact", -0.5), ("Test", "artifact", -0.3), ("Dump", "artifact", -0.3), ("Log", "artifact", -0.2),
]
USAGE_POINTS = {"active": 30, "moderate": 15, "low": 5}


def holds(x: Column, word: str) -> Column:
    return F.contains(F.lower(F.coalesce(x, F.lit(""))), F.lit(word.lower()))


def entity_score(class_name: Column, related: Column, points: dict[str, int] = ENTITY_POINTS) -> Column:
    """The best word of the class name or related entities, up to 50."""
    each = [F.when(holds(class_name, k) | holds(related, k), v).otherwise(0) for k, v in points.items()]
    return F.least(F.greatest(F.lit(0), *each), F.lit(50))


def keyword_score(class_name: Column, method_name: Column, keywords: list[tuple[str, str, float]] = KEYWORDS) -> Column:
    """15 (artifacts 20) times the multiplier of each keyword found, cut to a whole number from -20 to 40."""
    where = F.concat_ws(" ", class_name, method_name)
    total = F.lit(0.0)
    for word, category, factor in keywords:
        total = total + F.when(holds(where, word), factor * (20 if category == "artifact" else 15)).otherwise(0.0)
    return F.greatest(F.lit(-20), F.least(F.lit(40), F.round(total, 6).cast("int")))


def artifact_penalty(analysis_type: Column, description: Column, class_name: Column) -> Column:
    """-40 for unreachable code, -30 for debug and test classes, -10 for to-dos; -40 at most."""
    kind = F.lower(analysis_type)
    unreachable = F.when((kind == "unreachable") | holds(description, "unreachable"), -40).otherwise(0)
    debug = F.when(holds(class_name, "debug") | holds(class_name, "test"), -30).otherwise(0)
    return F.greatest(F.lit(-40), unreachable + debug + F.when(kind == "todo", -10).otherwise(0))


def _entity_sql(points: dict[str, int]) -> str:
    return "least(greatest(0, " + ", ".join(f"CASE WHEN class_name ILIKE '%{k}%' OR related_entities ILIKE '%{k}%' THEN {v} ELSE 0 END" for k, v in points.items()) + "), 50)"


def _keyword_sql() -> str:
    terms = " + ".join(f"CASE WHEN class_name || ' ' || method_name ILIKE '%{k}%' THEN {round(f * (20 if c == 'artifact' else 15), 6)} ELSE 0 END" for k, c, f in KEYWORDS)
    return f"CAST(greatest(-20, least(40, trunc(round({terms}, 6)))) AS INTEGER)"


PENALTY_SQL = "greatest(-40, CASE WHEN analysis_type ILIKE 'unreachable' OR description ILIKE '%unreachable%' THEN -40 ELSE 0 END + CASE WHEN class_name ILIKE '%debug%' OR class_name ILIKE '%test%' THEN -30 ELSE 0 END + CASE WHEN analysis_type ILIKE 'todo' THEN -10 ELSE 0 END)"


@query("cod_28_entity_scores", f"SELECT id, {_entity_sql(ENTITY_POINTS)} AS score FROM game_code_analysis")
def entity_scores(m: Model) -> DataFrame:
    return m.game_code_analysis.select("id", entity_score(F.col("class_name"), F.col("related_entities")).alias("score"))


@query("cod_30_keyword_scores", f"SELECT id, {_keyword_sql()} AS score FROM game_code_analysis")
def keyword_scores(m: Model) -> DataFrame:
    return m.game_code_analysis.select("id", keyword_score(F.col("class_name"), F.col("method_name")).alias("score"))


@query("cod_31_artifact_penalties", f"SELECT id, {PENALTY_SQL} AS penalty FROM game_code_analysis")
def artifact_penalties(m: Model) -> DataFrame:
    return m.game_code_analysis.select("id", artifact_penalty(F.col("analysis_type"), F.col("description"), F.col("class_name")).alias("penalty"))


MOD_SQL = """
    SELECT g.id, least(50, CASE WHEN p.m IS NOT NULL THEN 50 ELSE 0 END + CASE WHEN x.c IS NOT NULL THEN 30 ELSE 0 END + CASE WHEN d.c IS NOT NULL THEN 40 ELSE 0 END) AS score FROM game_code_analysis g
    LEFT JOIN (SELECT DISTINCT target_method AS m FROM harmony_patches) p ON p.m = g.method_name LEFT JOIN (SELECT DISTINCT target_name AS c FROM mod_xml_operations) x ON x.c = g.class_name
    LEFT JOIN (SELECT DISTINCT dependency_name AS c FROM csharp_deps) d ON d.c = g.class_name"""


@query("cod_29_mod_scores", MOD_SQL)
def mod_scores(m: Model) -> DataFrame:
    """50 for a patched method, 30 for a class that XML changes name, 40 for one that code needs; 50 at most."""
    patched = m.harmony_patches.select(F.col("target_method").alias("method_name")).distinct().withColumn("p", F.lit(50))
    named = m.mod_xml_operations.select(F.col("target_name").alias("class_name")).distinct().withColumn("x", F.lit(30))
    needed = m.csharp_deps.select(F.col("dependency_name").alias("class_name")).distinct().withColumn("d", F.lit(40))
    rows = m.game_code_analysis.join(patched, "method_name", "left").join(named, "class_name", "left").join(needed, "class_name", "left").fillna(0, ["p", "x", "d"])
    return rows.select("id", F.least(F.lit(50), F.col("p") + F.col("x") + F.col("d")).alias("score"))


CALLBACKS = ("Update", "LateUpdate", "FixedUpdate", "Awake", "Start")
REACH_SQL = f"""
    WITH RECURSIVE walk AS (SELECT id, 0 AS depth FROM methods WHERE name IN ({", ".join(f"'{c}'" for c in CALLBACKS)})
      UNION SELECT calls.callee_id, walk.depth + 1 FROM walk JOIN calls ON calls.caller_id = walk.id WHERE walk.depth < 5)
    SELECT name, CAST(min(depth) AS INTEGER) AS depth FROM walk JOIN methods USING (id) GROUP BY 1"""
CONNECT_SQL = f"""
    SELECT g.id, least(100, if(r.name IS NULL, 0, 10) + CASE WHEN coalesce(c.n, 0) >= 5 THEN 30 + 20 WHEN coalesce(c.n, 0) >= 3 THEN 15 + 10 WHEN coalesce(c.n, 0) >= 2 THEN 15 + 5 WHEN coalesce(c.n, 0) = 1 THEN 5 + 5 ELSE 0 END) AS score
    FROM game_code_analysis g LEFT JOIN (SELECT me.name, count(DISTINCT c.caller_id) AS n FROM calls c JOIN methods me ON me.id = c.callee_id GROUP BY 1) c ON c.name = g.method_name
    LEFT JOIN ({REACH_SQL}) r ON r.name = g.method_name"""


def reachable_methods(m: Model, steps: int = 5) -> DataFrame:
    """name, depth: the fewest calls (at most ``steps``) from a method that the engine calls to one of that name."""
    edges = settled(m.calls.select(F.col("caller_id").alias("s"), F.col("callee_id").alias("t")).distinct())
    frontier = seen = settled(m.methods.filter(F.col("name").isin(*CALLBACKS)).select("id", F.lit(0).alias("depth")).distinct())
    for d in range(1, steps + 1):
        new = frontier.join(edges, F.col("id") == F.col("s")).select(F.col("t").alias("id")).distinct().join(seen.select("id"), "id", "left_anti")
        frontier = settled(new.withColumn("depth", F.lit(d)))
        if frontier.isEmpty():
            break
        seen = seen.unionByName(frontier)
    return seen.join(m.methods.select("id", "name"), "id").groupBy("name").agg(F.min("depth").alias("depth"))


def caller_counts(m: Model) -> DataFrame:
    """method_name, callers: distinct callers of the methods of a name."""
    methods = m.methods.select(F.col("id").alias("callee_id"), F.col("name").alias("method_name"))
    return m.calls.join(methods, "callee_id").groupBy("method_name").agg(F.countDistinct("caller_id").alias("callers"))


@query("cod_22_reachability", f"""
    SELECT g.id, CASE WHEN coalesce(c.n, 0) >= 5 THEN 'active' WHEN coalesce(c.n, 0) >= 2 THEN 'moderate' WHEN coalesce(c.n, 0) = 1 THEN 'low' ELSE 'unused' END AS usage_level,
      CASE WHEN coalesce(c.n, 0) >= 5 THEN 'high' WHEN coalesce(c.n, 0) >= 2 THEN 'medium' WHEN coalesce(c.n, 0) = 1 THEN 'low' ELSE 'none' END AS confidence, r.name IS NOT NULL AS reachable, coalesce(r.depth, -1) AS depth
    FROM game_code_analysis g LEFT JOIN (SELECT me.name, count(DISTINCT c.caller_id) AS n FROM calls c JOIN methods me ON me.id = c.callee_id GROUP BY 1) c ON c.name = g.method_name
    LEFT JOIN ({REACH_SQL}) r ON r.name = g.method_name""")  # fmt: skip
def reachability(m: Model) -> DataFrame:
    """How much each finding's method is used, and within how many calls the engine comes to it (-1: in none of five)."""
    reach = reachable_methods(m).withColumnRenamed("name", "method_name")
    rows = m.game_code_analysis.select("id", "method_name").join(caller_counts(m), "method_name", "left").join(reach, "method_name", "left")
    c = F.coalesce("callers", F.lit(0))
    level = lambda *names: F.when(c >= 5, names[0]).when(c >= 2, names[1]).when(c == 1, names[2]).otherwise(names[3])
    depth = F.col("depth")
    return rows.select("id", level("active", "moderate", "low", "unused").alias("usage_level"), level("high", "medium", "low", "none").alias("confidence"), depth.isNotNull().alias("reachable"), F.coalesce(depth, F.lit(-1)).alias("depth"))


@query("cod_27_connectivity_scores", CONNECT_SQL)
def connectivity_scores(m: Model) -> DataFrame:
    """Usage level by callers (five active, two moderate, one low), points for the callers themselves, ten for what is reachable."""
    c = F.coalesce("callers", F.lit(0))
    usage = F.when(c >= 5, USAGE_POINTS["active"]).when(c >= 2, USAGE_POINTS["moderate"]).when(c >= 1, USAGE_POINTS["low"]).otherwise(0)
    callers = F.when(c >= 5, 20).when(c >= 3, 10).when(c >= 1, 5).otherwise(0)
    reach = reachable_methods(m).select(F.col("name").alias("method_name"), F.lit(10).alias("reach"))
    rows = m.game_code_analysis.join(caller_counts(m), "method_name", "left").join(reach, "method_name", "left")
    return rows.select("id", F.least(F.lit(100), usage + callers + F.coalesce("reach", F.lit(0))).alias("score"))


@query("cod_26_relevance_scores", f"""
    WITH c AS ({CONNECT_SQL}), d AS ({MOD_SQL})
    SELECT g.id, CAST(greatest(-50, least(150, trunc(round(c.score * 1.0 + {_entity_sql(ENTITY_POINTS)} * 1.2 + d.score * 1.5 + {_keyword_sql()} * 0.8 + {PENALTY_SQL}, 6)))) AS INTEGER) AS total_score
    FROM game_code_analysis g JOIN c ON c.id = g.id JOIN d ON d.id = g.id""")  # fmt: skip
def relevance_scores(m: Model, weights: dict[str, float] = WEIGHTS) -> DataFrame:
    """Weighted sum of all factors and the penalty, cut to a whole number from -50 to 150."""
    rows = m.game_code_analysis.join(connectivity_scores(m).withColumnRenamed("score", "c"), "id").join(mod_scores(m).withColumnRenamed("score", "d"), "id")
    entity, keyword = entity_score(F.col("class_name"), F.col("related_entities")), keyword_score(F.col("class_name"), F.col("method_name"))
    penalty = artifact_penalty(F.col("analysis_type"), F.col("description"), F.col("class_name"))
    value = F.col("c") * weights["connectivity"] + entity * weights["entity"] + F.col("d") * weights["mod"] + keyword * weights["keyword"] + penalty
    return rows.select("id", F.greatest(F.lit(-50), F.least(F.lit(150), F.round(value, 6).cast("int"))).alias("total_score"))


def missing_scores(m: Model, scored: DataFrame, force: bool = False) -> DataFrame:
    """Scores of findings that ``scored`` (id) lacks; of all with ``force``."""
    rows = relevance_scores(m)
    return rows if force else rows.join(scored.select("id"), "id", "left_anti")


@query("inc_07_score_only_missing", f"SELECT s.id, s.total_score FROM ({REGISTRY['cod_26_relevance_scores'][1]}) s JOIN game_code_analysis g ON g.id = s.id WHERE g.severity <> 'BUG'")
def relevance_of_missing(m: Model) -> DataFrame:
    """Relevance scores of findings not scored before; bugs stand for those that were."""
    return missing_scores(m, m.game_code_analysis.filter("severity = 'BUG'"))


@query("cod_32_scored_findings", f"SELECT g.id, g.severity, coalesce(s.total_score, 0) AS score FROM game_code_analysis g LEFT JOIN ({REGISTRY['cod_26_relevance_scores'][1]}) s ON s.id = g.id")
def scored_findings(m: Model) -> DataFrame:
    """All findings with their relevance score, 0 where there is none, the best first."""
    rows = m.game_code_analysis.select("id", "severity").join(relevance_scores(m).withColumnRenamed("total_score", "score"), "id", "left")
    return rows.select("id", "severity", F.coalesce("score", F.lit(0)).alias("score")).orderBy(F.desc("score"), "severity", "id")


@query("cod_33_types_with_findings", """
    SELECT t.id, count(g.id) AS findings FROM types t LEFT JOIN (SELECT DISTINCT id, class_name AS c FROM game_code_analysis UNION SELECT DISTINCT id, replace(method_name, 'M', 'Type') FROM game_code_analysis) g ON g.c = t.name GROUP BY 1""")  # fmt: skip
def types_with_findings(m: Model) -> DataFrame:
    """Findings that name each type in either of two ways, each counted once: a union instead of an OR."""
    g = m.game_code_analysis
    names = g.select("id", F.col("class_name").alias("name")).unionByName(g.select("id", F.regexp_replace("method_name", "M", "Type").alias("name"))).distinct()
    counts = names.groupBy("name").agg(n().alias("findings"))
    return m.types.select("id", "name").join(counts, "name", "left").select("id", F.coalesce("findings", F.lit(0).cast("long")).alias("findings"))


@query("cod_20_dead_code", """
    SELECT me.id, CASE WHEN me.name IN ('Update', 'LateUpdate') THEN 0.1 WHEN coalesce(c.n, 0) = 0 THEN 0.8 WHEN coalesce(c.o, 0) = 0 THEN 0.5 ELSE 0.1 END::DOUBLE AS dead_confidence,
      CASE WHEN coalesce(c.o, 0) >= 5 THEN 'active' WHEN coalesce(c.o, 0) >= 2 THEN 'moderate' WHEN coalesce(c.o, 0) = 1 THEN 'low' WHEN coalesce(c.n, 0) > 0 THEN 'internal' ELSE 'unused' END AS usage_level
    FROM methods me LEFT JOIN (SELECT c.callee_id, count(*) AS n, CAST(sum(CASE WHEN a.type_id <> b.type_id THEN 1 ELSE 0 END) AS BIGINT) AS o FROM calls c JOIN methods a ON a.id = c.caller_id JOIN methods b ON b.id = c.callee_id GROUP BY 1) c ON c.callee_id = me.id""")  # fmt: skip
def dead_code(m: Model) -> DataFrame:
    """How sure it is that a method is dead, and its usage level, by callers inside and outside its type."""
    a = m.methods.select(F.col("id").alias("caller_id"), F.col("type_id").alias("ta"))
    b = m.methods.select(F.col("id").alias("callee_id"), F.col("type_id").alias("tb"))
    outside = F.sum(F.when(F.col("ta") != F.col("tb"), 1).otherwise(0))
    counts = m.calls.join(a, "caller_id").join(b, "callee_id").groupBy(F.col("callee_id").alias("id")).agg(n().alias("n"), outside.alias("o"))
    rows = m.methods.select("id", "name").join(counts, "id", "left").fillna(0, ["n", "o"])
    every, other = F.col("n"), F.col("o")
    dead = F.when(F.col("name").isin("Update", "LateUpdate"), 0.1).when(every == 0, 0.8).when(other == 0, 0.5).otherwise(0.1)
    level = F.when(other >= 5, "active").when(other >= 2, "moderate").when(other == 1, "low").when(every > 0, "internal").otherwise("unused")
    return rows.select("id", dead.alias("dead_confidence"), level.alias("usage_level"))


@query("cod_25_callee_lists", """
    SELECT caller_id, array_to_string(list_slice(list_sort(list_distinct(list(target_type || '.' || target_method))), 1, 20), ',') AS callees FROM external_calls GROUP BY 1""")  # fmt: skip
def callee_lists(m: Model) -> DataFrame:
    """Up to twenty outside methods that each method calls."""
    names = F.slice(F.array_sort(F.collect_set(F.concat_ws(".", "target_type", "target_method"))), 1, 20)
    return m.external_calls.groupBy("caller_id").agg(F.array_join(names, ",").alias("callees"))


# --- Parameters as tables ---------------------------------------------------------------------------------------------

#: Rows up to which a table of keywords is sent to every task.
MOST_KEYWORDS = 10_000


def default_parameters(spark) -> dict[str, DataFrame]:
    """The fixed values as tables, to be changed row by row: weights (factor, weight), keywords (keyword, category, multiplier), entities (word, points)."""
    return {
        "weights": spark.createDataFrame(list(WEIGHTS.items()), "factor string, weight double"), "keywords": spark.createDataFrame(KEYWORDS, "keyword string, category string, multiplier double"),
        "entities": spark.createDataFrame(list(ENTITY_POINTS.items()), "word string, points int"),
    }


def _hits(names: DataFrame, words: DataFrame, word: str) -> DataFrame:
    """names (where) x words of which a name holds the text. Names that hold none are sieved out by one pattern of all words; a table
    of over ``MOST_KEYWORDS`` words is joined by the words' first three letters instead of being sent."""
    held = words.filter(F.length(word) > 0).withColumn("__w", F.lower(word))
    if held.limit(MOST_KEYWORDS + 1).count() <= MOST_KEYWORDS:
        listed = [r["__w"] for r in held.select("__w").distinct().collect()]  # checked just now
        sieve = "|".join(re.escape(w) for w in listed) or r"(?!)"
        return names.filter(F.rlike(F.lower("where"), F.lit(sieve))).join(F.broadcast(held), F.contains(F.lower("where"), F.col("__w"))).drop("__w")
    low = F.lower("where")
    grams = names.withColumn("__g", F.explode(F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.length(low), F.lit(1))), lambda i: F.substring(low, i, F.lit(3))))))
    return grams.join(held.withColumn("__g", F.substring("__w", 1, 3)), "__g").filter(F.contains(F.lower("where"), F.col("__w"))).drop("__g", "__w").distinct()


def tuned_scores(m: Model, parameters: dict[str, DataFrame] | None = None) -> DataFrame:
    """Relevance scores by tables of parameters: id, keyword_score, entity_score, total_score."""
    p = default_parameters(m.spark) | (parameters or {})
    g = m.game_code_analysis
    names = g.select(F.concat_ws(" ", "class_name", "method_name").alias("where")).distinct()
    worth = F.col("multiplier") * F.when(F.col("category") == "artifact", 20).otherwise(15)
    keyword = _hits(names, p["keywords"].dropDuplicates(["keyword"]), "keyword").groupBy("where").agg(F.round(F.sum(worth), 6).alias("k"))
    things = g.select(F.concat_ws(" \x01 ", "class_name", "related_entities").alias("where")).distinct()
    entity = _hits(things, p["entities"], "word").groupBy(F.col("where").alias("what")).agg(F.max("points").alias("e"))
    rows = g.withColumns({"where": F.concat_ws(" ", "class_name", "method_name"), "what": F.concat_ws(" \x01 ", "class_name", "related_entities")}).join(keyword, "where", "left").join(entity, "what", "left")
    k = F.greatest(F.lit(-20), F.least(F.lit(40), F.coalesce("k", F.lit(0.0)).cast("int")))
    e = F.least(F.greatest(F.lit(0), F.coalesce("e", F.lit(0))), F.lit(50))
    factors = F.map_from_entries(F.collect_list(F.struct("factor", "weight")))
    weights = p["weights"].dropDuplicates(["factor"]).agg(factors.alias("w"))  # four rows
    scored = rows.select("id", k.alias("keyword_score"), e.alias("entity_score"), artifact_penalty(F.col("analysis_type"), F.col("description"), F.col("class_name")).alias("penalty"))
    scored = scored.join(connectivity_scores(m).withColumnRenamed("score", "c"), "id").join(mod_scores(m).withColumnRenamed("score", "d"), "id").crossJoin(F.broadcast(weights))
    w = lambda factor: F.coalesce(F.try_element_at("w", F.lit(factor)), F.lit(1.0))
    value = F.col("c") * w("connectivity") + F.col("entity_score") * w("entity") + F.col("d") * w("mod") + F.col("keyword_score") * w("keyword") + F.col("penalty")
    return scored.select("id", "keyword_score", "entity_score", F.greatest(F.lit(-50), F.least(F.lit(150), F.round(value, 6).cast("int"))).alias("total_score"))


@query("udf_02_default_parameters", f"SELECT s.id, {_keyword_sql()} AS keyword_score, {_entity_sql(ENTITY_POINTS)} AS entity_score, s.total_score FROM ({REGISTRY['cod_26_relevance_scores'][1]}) s JOIN game_code_analysis g ON g.id = s.id")
def scores_by_tables(m: Model) -> DataFrame:
    """By the fixed values as tables: the same as by the rules in code."""
    return tuned_scores(m)


@query("udf_02_tuned_parameters", f"""
    WITH c AS ({CONNECT_SQL}), d AS ({MOD_SQL}),
    k AS (SELECT id, CASE WHEN class_name || ' ' || method_name ILIKE '%block%' THEN 30.0 ELSE 0.0 END + CASE WHEN class_name || ' ' || method_name ILIKE '%m1%' THEN -6.0 ELSE 0.0 END AS k, CASE WHEN class_name ILIKE '%player%' OR related_entities ILIKE '%player%' THEN 33 ELSE 0 END AS e FROM game_code_analysis)
    SELECT g.id, CAST(greatest(-20, least(40, k.k)) AS INTEGER) AS keyword_score, k.e AS entity_score,
      CAST(greatest(-50, least(150, trunc(round(c.score * 2.0 + k.e * 0.5 + d.score * 1.0 + CAST(greatest(-20, least(40, k.k)) AS INTEGER) * 3.0 + {PENALTY_SQL}, 6)))) AS INTEGER) AS total_score
    FROM game_code_analysis g JOIN k ON k.id = g.id JOIN c ON c.id = g.id JOIN d ON d.id = g.id""")  # fmt: skip
def scores_by_other_tables(m: Model) -> DataFrame:
    """Other weights, keywords and entity words: rows changed, scores change."""
    spark = m.spark
    return tuned_scores(m, {
        "weights": spark.createDataFrame([("connectivity", 2.0), ("entity", 0.5), ("keyword", 3.0)], "factor string, weight double"), "entities": spark.createDataFrame([("Player", 33)], "word string, points int"),
        "keywords": spark.createDataFrame([("Block", "building", 2.0), ("M1", "artifact", -0.3)], "keyword string, category string, multiplier double"),
    })
