"""XPath strings as columns: canonical form, hash, what they aim at. All run inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Element of a config path and the entity type it stands for.
TARGETS = {
    "item": "item", "block": "block", "entity_class": "entity_class", "buff": "buff", "recipe": "recipe", "sound": "sound", "vehicle": "vehicle",
    "quest": "quest", "skill": "skill", "perk": "perk", "lootcontainer": "loot_container", "lootgroup": "loot_group", "entitygroup": "entity_group", "action_sequence": "game_event",
}
OPERATIONS = ("base_set", "base_add", "base_subtract", "perc_set", "perc_add", "perc_subtract")


def _outside_quotes(path: Column, change) -> Column:
    """``change`` applied to the parts of a path that stand outside double quotes."""
    parts = F.split(path, '"', -1)
    return F.array_join(F.transform(parts, lambda p, i: F.when(i % 2 == 0, change(p)).otherwise(p)), '"')


def normalise(path: Column, sort_all: bool = False) -> Column:
    """One spelling for one meaning: white space, operator spacing, quotes, sorted `` and `` terms, positions, case.

    Spaces around ``@`` go first, so `` and `` before an attribute no longer splits, as in the reference; ``sort_all``
    sorts such terms too.
    """
    p = F.regexp_replace(F.trim(F.coalesce(path, F.lit(""))), r"\s+", " ")
    p = F.regexp_replace(p, r"\s*([\[\]=@/])\s*", "$1")
    p = F.regexp_replace(p, r"'([^'\"]*)'", '"$1"')
    if sort_all:
        p = F.regexp_replace(p, r"(?<=[\"\])]) and@", " and @")

    def ordered(p: Column) -> Column:
        terms = F.regexp_extract_all(p, F.lit(r"\[[^\[\]]*\]|[^\[]+"), F.lit(0))
        term = lambda t: F.when(
            t.startswith("[") & F.contains(t, F.lit(" and ")),
            F.concat(F.lit("["), F.array_join(F.array_sort(F.transform(F.split(F.substring(t, F.lit(2), F.length(t) - 2), " and "), lambda x: F.trim(x))), " and "), F.lit("]")),
        ).otherwise(t)
        return F.array_join(F.transform(terms, term), "")

    p = ordered(p)
    p = F.regexp_replace(p, r"\[position\(\)=(\d+)\]", "[$1]")
    p = F.regexp_replace(p, r"/\./", "/")
    p = F.regexp_replace(p, r"(?<=.)/$", "")
    return _outside_quotes(p, F.lower)


def path_hash(path: Column) -> Column:
    """Sixteen hex digits of the normalised path; none for an empty one."""
    p = normalise(path)
    return F.when(p == "", "").otherwise(F.substring(F.sha2(p.cast("binary"), 256), 1, 16))


def conflict_key(path: Column, operation: Column) -> Column:
    return F.lower(F.concat(normalise(path), F.lit("|"), operation))


def _first(path: Column, patterns: list[str]) -> Column:
    return F.coalesce(*(F.nullif(F.regexp_extract(path, p, 1), F.lit("")) for p in patterns))


def target(path: Column) -> Column:
    """struct(type, name) of the entity a path selects by name or id; nulls where it selects none."""
    kind, name = F.lit(None).cast("string"), F.lit(None).cast("string")
    for element, value in reversed(TARGETS.items()):
        found = F.nullif(F.regexp_extract(path, rf"(?i)/{element}\[\s*@(?:name|id)\s*=\s*[\"']([^\"']+)[\"']", 1), F.lit(""))
        kind, name = F.when(found.isNotNull(), value).otherwise(kind), F.coalesce(found, name)
    return F.struct(kind.alias("type"), name.alias("name"))


def property_name(path: Column) -> Column:
    return _first(path, [r"(?i)property\[@name=[\"']([^\"']+)[\"']\]", r"(?i)passive_effect\[@name=[\"']([^\"']+)[\"']\]", r"(?i)property\[@class=[\"']([^\"']+)[\"']\]", r"/@([A-Za-z_]+)$"])


def attribute_value(path: Column, attribute: str) -> Column:
    return _first(path, [rf"@{attribute}\s*=\s*[\"']([^\"']*)[\"']"])


def effect(path: Column) -> Column:
    """struct of what a path says about an effect: its name, attribute, trigger, and what it changes."""
    name = _first(path, [r"(?i)passive_effect\[@name=[\"']([^\"']+)[\"']"])
    trigger = F.rlike(path, F.lit("(?i)triggered_effect"))
    part = target(path)
    return F.struct(
        part["type"].alias("parent_entity"), part["name"].alias("parent_entity_name"), name.alias("effect_name"), _first(path, [r"/@([A-Za-z_]+)$"]).alias("attribute"),
        trigger.alias("is_triggered"), F.when(trigger, attribute_value(path, "action")).alias("trigger_action"), F.when(trigger, attribute_value(path, "cvar")).alias("trigger_cvar"),
        F.when(trigger, attribute_value(path, "operation")).alias("trigger_operation"), path.endswith("/@operation").alias("modifies_operation"), path.endswith("/@value").alias("modifies_value"),
    )


def effect_operation(value: Column) -> Column:
    """struct(operation, value_type, is_set) of one of six operations; nulls else."""
    known = F.lower(F.trim(value))
    ok = known.isin(*OPERATIONS)
    return F.struct(F.when(ok, F.substring_index(known, "_", -1)).alias("operation"), F.when(ok, F.substring_index(known, "_", 1)).alias("value_type"), F.when(ok, known.endswith("_set")).alias("is_set"))


#: Where the two extractors look for an entity: the path to it, the attribute that selects it, its type.
NORMALISED_TARGETS = [
    ("/items/item", "name", "item"), ("/blocks/block", "name", "block"), ("/entity_classes/entity_class", "name", "entity_class"), ("/buffs/buff", "name", "buff"), ("/recipes/recipe", "name", "recipe"),
    ("/progression/perks/perk", "name", "perk"), ("/progression/skills/skill", "name", "skill"), ("/lootcontainers/lootcontainer", "id", "lootcontainer"), ("/lootgroups/lootgroup", "name", "lootgroup"),
    ("/vehicles/vehicle", "name", "vehicle"), ("/quests/quest", "id", "quest"), ("/gamestages", "name", "gamestages"),
]
CHANGE_TARGETS = [
    ("/items/item", "name", "item"), ("/blocks/block", "name", "block"), ("/entity_classes/entity_class", "name", "entity_class"), ("/buffs/buff", "name", "buff"), ("/recipes/recipe", "name", "recipe"),
    ("/Sounds/SoundDataNode", "name", "sound"), ("/lootcontainers/lootcontainer", "name", "loot_container"), ("/lootcontainers/lootgroup", "name", "loot_group"), ("/quests/quest", "id", "quest"),
    ("/progression/perks/perk", "name", "perk"), ("/progression/skills/skill", "name", "skill"), ("/vehicles/vehicle", "name", "vehicle"), ("/windows/window", "name", "window"),
    ("/controls/*", "name", "control"), ("/gameevents/gameevent", "name", "game_event"), ("/archetypes/archetype", "name", "archetype"),
]
FRAGILE_TARGETS = [
    ("/lootcontainers/lootcontainer", "size", "loot_container"), ("/lootcontainers/lootcontainer", "id", "loot_container"), ("/windows/window", "controller", "window"),
    ("/controls/*", "controller", "control"), ("/items/item", "Extends", "item"), ("/blocks/block", "Extends", "block"),
]


def _selectors(path: Column, pattern: str) -> Column:
    """All selectors of a path: struct(at: the steps before it, attribute, value), by a pattern with these three groups."""
    part = lambda k: F.regexp_extract_all(path, F.lit(pattern), F.lit(k))
    return F.arrays_zip(part(1).alias("at"), part(2).alias("attribute"), part(3).alias("value"))


def _ranked(selectors: Column, rank) -> Column:
    """The first selector of the least rank; null if none has one."""
    ranked = F.transform(selectors, lambda s, i: F.struct(rank(s).alias("rank"), i.alias("i"), s.alias("s")))
    return F.array_min(F.filter(ranked, lambda r: r["rank"].isNotNull()))


def _rank(s: Column, table: list[tuple[str, str, str]], first: int) -> Column:
    """The place in ``table`` of what a selector selects, from ``first`` on; a star stands for any step."""
    out = F.lit(None).cast("int")
    for k in range(len(table) - 1, -1, -1):
        at, key, _ = table[k]
        head = s["at"].endswith(at) if not at.endswith("/*") else F.regexp_replace(s["at"], r"/\w+$", "").endswith(at[:-2])
        out = F.when((s["attribute"] == key) & head, k + first).otherwise(out)
    return out


def normalised_target(path: Column) -> Column:
    """struct(type, name) by the normaliser's rule: twelve known places, in order, whatever the case and the quotes."""
    lower = lambda s: F.struct(F.lower(s["at"]).alias("at"), F.lower(s["attribute"]).alias("attribute"), s["value"].alias("value"))
    found = F.transform(_selectors(path, r"((?:/\w+)+)\[@(\w+)=[\"']([^\"']+)[\"']\]"), lower)
    best = _ranked(found, lambda s: _rank(s, NORMALISED_TARGETS, 0))
    kinds = F.array(*(F.lit(kind) for _, _, kind in NORMALISED_TARGETS))
    return F.struct(F.get(kinds, best["rank"]).alias("type"), best["s"]["value"].alias("name"))


def change_target(path: Column) -> Column:
    """struct(type, name, attribute, value, fragile) by the rule for change documents: single quotes, and nothing between the selector
    and the next slash or the end. Selections by another attribute are named by it; they are fragile unless it is an id."""
    tables = CHANGE_TARGETS + FRAGILE_TARGETS
    any_ = len(tables)
    found = _selectors(path, r"((?:/\w+)+)\[@(\w+)='([^']+)'\](?=/|$)")
    generic = lambda s: F.when(F.rlike(s["at"], F.lit(r"/\w+/\w+$")), any_)
    best = _ranked(found, lambda s: F.coalesce(_rank(s, tables, 0), generic(s)))

    def shape(b: Column) -> Column:
        rank, s = b["rank"], b["s"]
        element = F.substring_index(s["at"], "/", -1)
        kind = F.when((rank == any_) | (rank == [t[0] for t in CHANGE_TARGETS].index("/controls/*")), element).otherwise(F.get(F.array(*(F.lit(k) for _, _, k in tables)), rank))
        quoted = F.concat(F.lit("["), s["attribute"], F.lit("='"), s["value"], F.lit("']"))
        plain = (rank < len(CHANGE_TARGETS)) | ((rank == any_) & (s["attribute"] == "name"))
        fragile = F.when(rank == any_, ~s["attribute"].isin("name", "id")).otherwise(rank >= len(CHANGE_TARGETS))
        attribute = F.when(rank < len(CHANGE_TARGETS), "name").otherwise(s["attribute"])
        return F.struct(kind.alias("type"), F.when(plain, s["value"]).otherwise(quoted).alias("name"), attribute.alias("attribute"), s["value"].alias("value"), fragile.alias("fragile"))

    return F.get(F.transform(F.filter(F.array(best), lambda b: b.isNotNull()), shape), F.lit(0))
