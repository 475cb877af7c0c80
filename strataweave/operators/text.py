"""Scalar functions of names, paths and hashes over the canonical tables, and fuzzy matching."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import game_context as gc
from ..functions import text as tx
from ..functions import xpath as xp
from ..functions import xpath_grammar as xg
from ..model import Model, query
from .graph import settled

PAIRS = "FROM xml_definitions d JOIN xml_definitions e ON e.name = d.extends AND e.definition_type = d.definition_type"


def _pairs(m: Model) -> DataFrame:
    """Each definition beside the one it extends."""
    e = m.xml_definitions.select(F.col("name").alias("extends"), "definition_type")
    return m.xml_definitions.join(e, ["extends", "definition_type"]).select("id", F.col("name").alias("a"), F.col("extends").alias("b"))


@query("scl_01_normalised_paths", """
    SELECT id, CASE id % 6
      WHEN 0 THEN '/items/item[@name="' || target_name || '"]/property[@name="Size"]/@value' WHEN 1 THEN '/buffs/buff[' || CAST(id % 9 + 1 AS VARCHAR) || ']' WHEN 2 THEN '//item[@a="X" and@name="' || target_name || '"]'
      WHEN 3 THEN '/a/b[c="1" and d="' || target_name || '"]' WHEN 4 THEN '/items/item' ELSE '' END AS normalised FROM mod_xml_operations""")  # fmt: skip
def normalised_paths(m: Model) -> DataFrame:
    """Paths in six spellings: spaces, quotes, capitals, ordered terms, positions, steps that mean nothing."""
    name = F.col("target_name")
    shapes = [
        F.concat(F.lit("  /Items / item [ @name = '"), name, F.lit("' ]/PROPERTY[@Name='Size']/ @value ")), F.concat(F.lit("/buffs/buff[ position() = "), (F.col("id") % 9 + 1).cast("string"), F.lit(" ]/")),
        F.concat(F.lit("//item[ @a = 'X' and @name='"), name, F.lit("' ]")), F.concat(F.lit("/a/b[d='"), name, F.lit("' and  c = '1']")), F.lit("/items/./item/"), F.lit("   "),
    ]
    return m.mod_xml_operations.select("id", xp.normalise(_pick(F.col("id"), shapes)).alias("normalised"))


def _pick(key: Column, options: list[Column]) -> Column:
    """The option at the key's remainder."""
    out = options[-1]
    for k in range(len(options) - 2, -1, -1):
        out = F.when(key % len(options) == k, options[k]).otherwise(out)
    return out


#: Damage done to a path, by its id: how, and at which character it is found out; nothing is found out where that is 0.
DAMAGES = [
    ("xpath", "0"), ("xpath || '['", "len(xpath) + 2"), ("xpath || ']'", "len(xpath) + 1"), ("replace(xpath, '\"]/prop', '\"/prop')", "strpos(xpath, ']/prop')"), ("replace(xpath, '[@name=\"', '[@@name=\"')", "strpos(xpath, '[@name') + 2"),
    ("replace(xpath, '=', '==')", "strpos(xpath, '=') + 1"), ("replace(xpath, '\"]/prop', ']/prop')", "strpos(xpath, '\"prop')"), ("replace(xpath, '/property', '///property')", "strpos(xpath, '/property') + 2"),
    ("replace(xpath, '/property', '/child::property')", "0"), ("replace(xpath, '/property', '/kid::property')", "strpos(xpath, '/property') + 1"), ("xpath || '[last( and 1]'", "len(xpath) + 12"), ("replace(xpath, '/@value', '[contains(@a)]')", "len(xpath) + 6"),
    ("replace(xpath, '/@value', '[contains(@a, \"b\") and not(position() = last())]')", "0"), ("xpath || ' or'", "len(xpath) + 4"), ("' '", "1"), ("xpath || ' | //x[. > -1.5]/..'", "0"), ("'count(' || xpath || ') * 2 + \"1\"'", "0"), ("'count(' || xpath || ')[1]'", "len(xpath) + 8"),
    ("xpath || '#'", "len(xpath) + 1"), ("'(' || xpath || ')[2]/text()'", "0"), ("'(' || xpath", "len(xpath) + 2"), ("xpath || '/'", "len(xpath) + 2"),
]


def _cases(which: int) -> str:
    return f"CASE id % {len(DAMAGES)} " + " ".join(f"WHEN {k} THEN {d[which]}" for k, d in enumerate(DAMAGES)) + " END"


@query("scl_02_path_validity", f"SELECT id, CAST({_cases(1)} AS INTEGER) AS fault, {_cases(1)} = 0 AS valid FROM mod_xml_operations")
def path_validity(m: Model) -> DataFrame:
    """Real paths, whole and damaged in many ways: valid or not, and where not."""
    path = F.expr(_cases(0))
    return m.mod_xml_operations.select("id", xg.fault(path).alias("fault")).select("id", "fault", (F.col("fault") == 0).alias("valid"))


@query("scl_04_normalised_targets", """
    SELECT id, CASE WHEN id % 5 = 4 THEN NULL ELSE ['item', 'quest', 'perk', 'gamestages'][id % 5 + 1] END AS found_type, CASE WHEN id % 5 <> 4 THEN target_name END AS found_name FROM mod_xml_operations""")  # fmt: skip
def normalised_targets(m: Model) -> DataFrame:
    """Targets by the normaliser's twelve places; one that is none of them."""
    name = F.col("target_name")
    around = lambda a, b: F.concat(F.lit(a), name, F.lit(b))
    path = _pick(F.col("id"), [around("/ITEMS/Item[@name='", "']/x"), around('/quests/quest[@id="', '"]'), around("/progression/perks/perk[@name='", "']"), around("//x/gamestages[@name='", "']"), around("/quests/quest[@name='", "']")])
    found = xp.normalised_target(path)
    return m.mod_xml_operations.select("id", found["type"].alias("found_type"), found["name"].alias("found_name"))


@query("scl_04_change_targets", """
    WITH t AS (SELECT id, CAST(id % 8 AS INTEGER) AS k, target_name AS n FROM mod_xml_operations)
    SELECT id, ['item', 'loot_container', 'loot_container', 'button', 'control', 'trader', 'zone', NULL][k + 1] AS found_type,
      CASE WHEN k IN (0, 3) THEN n WHEN k < 7 THEN '[' || ['', 'size', 'id', '', 'controller', 'id', 'biome'][k + 1] || '=' || chr(39) || n || chr(39) || ']' END AS found_name,
      ['name', 'size', 'id', 'name', 'controller', 'id', 'biome', NULL][k + 1] AS attribute, CASE WHEN k <> 7 THEN k IN (1, 2, 4, 6) END AS fragile FROM t""")  # fmt: skip
def change_targets(m: Model) -> DataFrame:
    """Targets by the rule for change documents: by name, by other attributes, by any element; double quotes are none."""
    shapes = [
        "/items/item[@name='{}']/x", "/lootcontainers/lootcontainer[@size='{}']", "/lootcontainers/lootcontainer[@id='{}']/item", "/windows/controls/button[@name='{}']", "/controls/grid[@controller='{}']",
        "/traders/trader[@id='{}']/x", "/map/zone[@biome='{}']", '/items/item[@name="{}"]',
    ]
    path = _pick(F.col("id"), [F.replace(F.lit(x), F.lit("{}"), F.col("target_name")) for x in shapes])
    found = xp.change_target(path)
    return m.mod_xml_operations.select("id", found["type"].alias("found_type"), found["name"].alias("found_name"), found["attribute"].alias("attribute"), found["fragile"].alias("fragile"))


@query("scl_03_path_hashes", "SELECT id, substr(sha256(xpath), 1, 16) AS path_hash, lower(xpath || '|' || operation) AS conflict_key FROM mod_xml_operations")
def path_hashes(m: Model) -> DataFrame:
    return m.mod_xml_operations.select("id", xp.path_hash(F.col("xpath")).alias("path_hash"), xp.conflict_key(F.col("xpath"), F.col("operation")).alias("conflict_key"))


@query("scl_05_path_targets", "SELECT id, target_type AS found_type, target_name AS found_name FROM mod_xml_operations")
def path_targets(m: Model) -> DataFrame:
    found = xp.target(F.col("xpath"))
    return m.mod_xml_operations.select("id", found["type"].alias("found_type"), found["name"].alias("found_name"))


@query("scl_06_path_properties", "SELECT id, regexp_extract(xpath, 'property\\[@name=\"([^\"]+)\"', 1) AS property FROM mod_xml_operations")
def path_properties(m: Model) -> DataFrame:
    return m.mod_xml_operations.select("id", xp.property_name(F.col("xpath")).alias("property"))


@query("scl_07_effect_context", """
    SELECT id, target_type AS parent_entity, target_name AS parent_entity_name, CASE WHEN id % 3 = 0 THEN 'Effect' || CAST(id % 20 AS VARCHAR) END AS effect_name, CASE WHEN id % 3 = 1 THEN NULL WHEN id % 3 = 0 AND id % 2 = 0 THEN 'operation' ELSE 'value' END AS attribute,
      id % 3 = 1 AS is_triggered, CASE WHEN id % 3 = 1 THEN 'ModifyCVar' END AS trigger_action, CASE WHEN id % 3 = 1 THEN 'cv' || CAST(id % 7 AS VARCHAR) END AS trigger_cvar, id % 6 = 0 AS modifies_operation, id % 3 = 2 OR id % 6 = 3 AS modifies_value FROM mod_xml_operations""")  # fmt: skip
def effect_context(m: Model) -> DataFrame:
    """What paths say about effects: passive ones, triggered ones and none."""
    key = F.col("id")
    head = F.regexp_extract("xpath", r"^.*?\]", 0)
    passive = F.concat(head, F.lit("/effect_group/passive_effect[@name='Effect"), (key % 20).cast("string"), F.lit("']/@"), F.when(key % 2 == 0, "operation").otherwise("value"))
    triggered = F.concat(head, F.lit("/triggered_effect[@action='ModifyCVar' and @cvar='cv"), (key % 7).cast("string"), F.lit("']"))
    e = xp.effect(F.when(key % 3 == 0, passive).when(key % 3 == 1, triggered).otherwise(F.col("xpath")))
    return m.mod_xml_operations.select("id", e.alias("e")).select("id", *(f"e.{c}" for c in ("parent_entity", "parent_entity_name", "effect_name", "attribute", "is_triggered", "trigger_action", "trigger_cvar", "modifies_operation", "modifies_value")))


@query("scl_08_effect_operations", "SELECT id, split_part(effect_operation, '_', 2) AS operation, split_part(effect_operation, '_', 1) AS value_type, effect_operation LIKE '%_set' AS is_set FROM mod_xml_operations WHERE effect_operation IS NOT NULL")
def effect_operations(m: Model) -> DataFrame:
    rows = m.mod_xml_operations.filter("effect_operation is not null")
    return rows.select("id", xp.effect_operation(F.col("effect_operation")).alias("e")).select("id", "e.operation", "e.value_type", "e.is_set")


@query("scl_09_equivalent_paths", """
    SELECT a.id, b.id AS other FROM mod_xml_operations a JOIN mod_xml_operations b ON a.target_type = b.target_type AND a.target_name = b.target_name AND a.line_number % 3 = b.line_number % 3 AND a.id < b.id AND a.operation = b.operation""")  # fmt: skip
def equivalent_paths(m: Model) -> DataFrame:
    """Pairs of paths of one operation, spelled in several ways, that mean the same node."""
    key, kind, name = F.col("id"), F.col("target_type"), F.col("target_name")
    text = lambda *parts: F.concat(*(F.lit(p) if isinstance(p, str) else p for p in parts))
    place = (F.col("line_number") % 3 + 1).cast("string")
    spelled = _pick(key, [
        text("/", kind, "[@name='", name, "']/x[", place, "]"), text(" / ", F.upper(kind), '[ @name = "', name, '" ]/X[ position() = ', place, " ]/"),
        text("/", kind, "[@NAME='", name, "']/./x[", place, "]"), text("/", kind, "[@name='", name, "'] /x[", place, "]/"),
    ])
    hashed = m.mod_xml_operations.select("id", "operation", xp.path_hash(spelled).alias("h"))
    return hashed.join(hashed.select(F.col("id").alias("other"), "operation", "h"), ["operation", "h"]).filter("id < other").select("id", "other")


@query("scl_10_name_tokens", "SELECT id, array_to_string(list_filter(string_split_regex(lower(name), '[_\\-\\s.]+'), lambda x: length(x) > 1), ' ') AS tokens FROM xml_definitions")
def definition_tokens(m: Model) -> DataFrame:
    return m.xml_definitions.select("id", F.array_join(tx.name_tokens(F.col("name")), " ").alias("tokens"))


@query("scl_11_token_overlap", f"""
    WITH t AS (SELECT d.id, list_filter(string_split(lower(d.name), '_'), lambda x: length(x) > 1) AS a, list_filter(string_split(lower(e.name), '_'), lambda x: length(x) > 1) AS b {PAIRS})
    SELECT id, round(len(list_distinct(list_intersect(a, b))) / len(list_distinct(list_concat(a, b))), 6) AS overlap FROM t""")  # fmt: skip
def token_overlap(m: Model) -> DataFrame:
    return _pairs(m).select("id", F.round(tx.jaccard(tx.name_tokens(F.col("a")), tx.name_tokens(F.col("b"))), 6).alias("overlap"))


@query("scl_12_edit_similarity", f"SELECT d.id, round(1 - levenshtein(lower(d.name), lower(e.name)) / greatest(length(d.name), length(e.name)), 6) AS similarity {PAIRS}")
def edit_similarities(m: Model) -> DataFrame:
    return _pairs(m).select("id", F.round(tx.edit_similarity(F.col("a"), F.col("b")), 6).alias("similarity"))


@query("scl_13_affix_similarity", f"""
    WITH p AS (SELECT d.id, lower(d.name) AS a, lower(e.name) AS b {PAIRS}),
    h AS (SELECT *, least(length(a), length(b)) AS s, greatest(length(a), length(b)) AS l, len(list_filter(range(1, least(length(a), length(b)) + 1), lambda i: substr(a, 1, i) = substr(b, 1, i))) AS h,
      len(list_filter(range(1, least(length(a), length(b)) + 1), lambda i: right(a, i) = right(b, i))) AS t FROM p)
    SELECT id, round((h + least(t, s - h)) / l, 6) AS similarity FROM h""")  # fmt: skip
def affix_similarities(m: Model) -> DataFrame:
    return _pairs(m).select("id", F.round(tx.affix_similarity(F.col("a"), F.col("b")), 6).alias("similarity"))


@query("scl_15_type_bonus", "SELECT id, CASE WHEN target_type = source_type THEN 0.15 WHEN contains(target_type, source_type) OR contains(source_type, target_type) THEN 0.05 ELSE 0.0 END::DOUBLE AS bonus FROM xml_references")
def type_bonuses(m: Model) -> DataFrame:
    return m.xml_references.select("id", tx.type_bonus(F.col("source_type"), F.col("target_type")).alias("bonus"))


@query("scl_18_content_hashes", "SELECT doc_id, upper(sha256(coalesce(text, ''))) AS content_hash, upper(sha256(coalesce(text, '') || chr(0) || coalesce(lang, ''))) AS joined_hash FROM documents")
def content_hashes(m: Model) -> DataFrame:
    docs = m.spark.read.parquet(f"{m.sf_dir}/documents.parquet")
    return docs.select("doc_id", tx.content_hash(F.col("text")).alias("content_hash"), tx.joined_hash(F.col("text"), F.col("lang")).alias("joined_hash"))


@query("scl_19_md5_hashes", "SELECT doc_id, md5(coalesce(text, '')) AS hash FROM documents")
def md5_hashes(m: Model) -> DataFrame:
    return m.spark.read.parquet(f"{m.sf_dir}/documents.parquet").select("doc_id", F.md5(F.coalesce("text", F.lit("")).cast("binary")).alias("hash"))


@query("scl_23_string_built_ins", "SELECT id, CAST(length(name) AS BIGINT) AS n, substr(name, 1, 3) AS head, CAST(instr(name, '_') AS BIGINT) AS place, name || ':' || extends AS chained FROM xml_definitions")
def string_built_ins(m: Model) -> DataFrame:
    name = F.col("name")
    return m.xml_definitions.select("id", F.length(name).cast("long").alias("n"), F.substring(name, 1, 3).alias("head"), F.instr(name, "_").cast("long").alias("place"), F.concat(name, F.lit(":"), "extends").alias("chained"))


@query("scl_26_json", "SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events")
def json_fields(m: Model) -> DataFrame:
    events = m.spark.read.parquet(f"{m.sf_dir}/events.parquet")
    return events.select("event_id", F.get_json_object("props", "$.k").cast("long").alias("k"))


@query("scl_27_clamped_arithmetic", "SELECT id, CAST(greatest(-20, least(40, trunc(line_number * 1.3 - 25))) AS BIGINT) AS clamped, round(line_number / 7, 2) AS rounded FROM xml_definitions")
def clamped_arithmetic(m: Model) -> DataFrame:
    n = F.col("line_number")
    value = (n * 1.3 - 25).cast("long")  # truncates toward zero
    return m.xml_definitions.select("id", F.greatest(F.lit(-20), F.least(F.lit(40), value)).cast("long").alias("clamped"), F.round(n / 7, 2).alias("rounded"))


_TYPE_SQL = "CASE definition_type " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in gc.OF_TYPE.items()) + " ELSE 'Game Configuration' END"
#: Words put before names, so that every rule meets some.
_WORDS = sorted({w.replace("+", "x") for rules in (gc.OF_PROPERTY, gc.OF_DEFINITION, gc.OF_CLASS) for words, _ in rules for w in words.split()} | {"", "Zzz"})
_WORD_SQL = f"[{', '.join(repr(w.capitalize()) for w in _WORDS)}][id % {len(_WORDS)} + 1]"


@query("scl_30_game_context", f"""
    WITH d AS (SELECT id, definition_type, {_WORD_SQL} || '_' || name AS name FROM xml_definitions)
    SELECT id, {gc.sql('name', gc.OF_PROPERTY, "'Game Property'")} AS as_property, {gc.sql('name', gc.OF_DEFINITION, _TYPE_SQL)} AS as_definition, {gc.sql('name', gc.OF_CLASS, "'Game Core'")} AS as_class FROM d""")  # fmt: skip
def game_context(m: Model) -> DataFrame:
    """What names tell as names of properties, definitions and classes."""
    word = F.get(F.array(*(F.lit(w.capitalize()) for w in _WORDS)), (F.col("id") % len(_WORDS)).cast("int"))
    name = F.concat(word, F.lit("_"), "name")
    return m.xml_definitions.select("id", gc.of_property(name).alias("as_property"), gc.of_definition(F.col("definition_type"), name).alias("as_definition"), gc.of_class(name).alias("as_class"))


@query("scl_30_property_context", f"SELECT id, {gc.sql('property_name', gc.OF_PROPERTY, repr('Game Property'))} AS context FROM xml_properties")
def property_context(m: Model) -> DataFrame:
    """What the tables' properties are about."""
    return m.xml_properties.select("id", gc.of_property(F.col("property_name")).alias("context"))


#: Rows of one side of a block of pairs.
BLOCK_ROWS = 2000


def _in_blocks(names: DataFrame, known: DataFrame, rows: int = BLOCK_ROWS) -> DataFrame:
    """Every row of ``names`` beside every row of ``known``: both in blocks of about ``rows``, each pair of blocks for itself, so a task
    holds one block however long the lists are. Only a list of one block is sent to all."""
    parts = lambda df: -(-df.count() // rows) or 1
    many, most = parts(names), parts(known)
    if most == 1:
        return names.repartition(max(many, int(names.sparkSession.conf.get("spark.sql.shuffle.partitions")))).crossJoin(F.broadcast(known))
    own = lambda df, n: F.pmod(F.xxhash64(*df.columns), F.lit(n)).cast("int")
    left = names.withColumn("__x", own(names, many)).withColumn("__y", F.explode(F.sequence(F.lit(0), F.lit(most - 1))))
    right = known.withColumn("__y", own(known, most)).withColumn("__x", F.explode(F.sequence(F.lit(0), F.lit(many - 1))))
    return left.join(right, ["__x", "__y"]).drop("__x", "__y")


#: Names and knowns of up to so many characters, that may be so many edits apart, are met by what they must share; others one by one.
SHORT, EDITS = 64, 2
#: Up to so many names that may be two edits away are scored against all: of every known one all pairs of characters would be left out for them.
FEW = 8


def _cut(x: Column, edits: int) -> Column:
    """``x`` without up to ``edits`` characters, in all ways: two strings that few edits apart have one such remainder in common."""
    out = F.array(x)
    for _ in range(edits):
        less = lambda s: F.transform(F.sequence(F.lit(1), F.length(s)), lambda i: F.concat(F.substring(s, F.lit(1), i - 1), F.substring(s, i + 1, F.length(s))))
        out = F.array_union(out, F.flatten(F.transform(F.filter(out, lambda s: F.length(s) > 0), less)))
    return F.array_distinct(out)


def _parts(x: Column, sizes: list[int]) -> Column:
    """All stretches of ``x`` that have one of some lengths."""
    fit = F.filter(F.array(*map(F.lit, sizes)).cast("array<int>"), lambda k: k <= F.length(x))
    return F.array_distinct(F.flatten(F.transform(fit, lambda k: F.transform(F.sequence(F.lit(1), F.length(x) - k + 1), lambda i: F.substring(x, i, k)))))


def _sizes(x: DataFrame) -> list[int]:
    """Lengths of texts in the one column of ``x``: a few dozen, as names are."""
    return sorted(r[0] for r in x.select(F.length(x.columns[0])).distinct().collect())


def _candidates(names: DataFrame, known: DataFrame, top: int) -> tuple[DataFrame, DataFrame]:
    """Pairs (name, known, kind) that hold the best ``top`` of some names, and the names whose best may be anywhere.

    A prefix of L >= 4 characters gives 0.7 + 0.02 L. Where ``top`` knowns have a name's first L characters, only what
    scores as much can be among its best: by such a prefix, by few edits, or by tokens, of which the longest must meet one if no part may fail.
    Spark takes all parts of a text for as large as the text and would send them to all by way of the driver: these joins are merged.
    """
    prefixes = lambda rows, c: rows.withColumn("L", F.explode(F.sequence(F.lit(4), F.length(c)))).withColumn("key", F.substring(c, F.lit(1), F.col("L")))
    near, far = names.filter(F.length("nl").between(4, SHORT)), known.filter(F.length("kl").between(4, SHORT))
    heads = prefixes(far, "kl").select("L", "key", "known", "kind")
    shared = heads.groupBy("L", "key").agg(F.count(F.lit(1)).alias("many")).filter(F.col("many") >= top).select("key")
    best = prefixes(near.select("name", "nl"), "nl").select("name", "L", "key").hint("merge").join(shared, "key").groupBy("name").agg(F.max("L").alias("L")).hint("merge").join(names, "name")
    # A hair below the rounded score, as ties count.
    best = best.withColumn("t", F.bround(0.7 + 0.02 * F.col("L"), 2) - 0.0051)
    longest = F.floor(F.length("nl") / F.col("t"))
    edits = F.floor((1 - F.col("t")) * longest + 1e-9).cast("int")
    # One token, or so few that each must meet one; above 0.8 it isn't enough that a name contains the other.
    sure = (F.col("t") > 0.8) & (edits <= EDITS) & ((F.size("nt") == 0) | (F.ceil(F.col("t") * F.size("nt")) >= F.size("nt")) | (F.col("t") > 1))
    best = settled(best.withColumn("edits", edits).filter(sure))
    if best.filter(F.col("edits") == EDITS).count() <= FEW:
        best = best.filter(F.col("edits") < EDITS)
    rest = names.join(best.select("name"), "name", "left_anti")

    by_prefix = best.select("name", "L", F.substring("nl", F.lit(1), F.col("L")).alias("key")).hint("merge").join(heads.hint("merge"), ["L", "key"])
    found = by_prefix.select("name", "known", "kind")
    known = known.filter(F.length("kl") <= SHORT)
    for d in range(EDITS + 1):
        mine = best.filter(F.col("edits") == d).select("name", F.explode(_cut(F.col("nl"), d)).alias("key"))
        lengths = best.filter(F.col("edits") == d).select(F.explode(F.sequence(F.greatest(F.length("nl") - d, F.lit(0)), F.length("nl") + d)).alias("size")).distinct()
        theirs = known.join(lengths, F.length("kl") == F.col("size"), "left_semi").select("known", "kind", F.explode(_cut(F.col("kl"), d)).alias("key"))
        found = found.unionByName(mine.hint("merge").join(theirs.hint("merge"), "key").select("name", "known", "kind"))
    token = lambda c: F.reduce(c, F.lit(""), lambda x, y: F.when(F.length(y) > F.length(x), y).otherwise(x))
    said = best.filter((F.size("nt") > 0) & (F.col("t") <= 1)).select("name", token(F.col("nt")).alias("key"))
    tokens = known.select("known", "kind", F.explode(F.array_distinct("kt")).alias("token"))
    # A name's token lies in a known one, or the other way about.
    inside = tokens.withColumn("key", F.explode(_parts(F.col("token"), _sizes(said.select("key")))))
    around = said.withColumn("token", F.explode(_parts(F.col("key"), _sizes(tokens.select("token")))))
    for a, b, key in ((said, inside, "key"), (around, tokens, "token")):
        found = found.unionByName(a.hint("merge").join(b.hint("merge"), key).select("name", "known", "kind"))
    return found.distinct(), rest


def fuzzy_match(names: DataFrame, known: DataFrame, least: float = 0.4, top: int = 5) -> DataFrame:
    """For each ``name`` the best ``top`` of ``known`` (known, kind) by the reference's score, at least ``least``.

    Names whose best are sure to share something with them meet only what does. The others, and all names with very long knowns, are scored
    against all that is known: 0.4 is so low that no shared token or q-gram is sure.
    """
    side = lambda rows, c, p: rows.filter(F.col(c).isNotNull()).distinct().withColumns({f"{p}l": F.lower(c), f"{p}t": tx.capital_tokens(F.col(c))})
    ours, theirs = settled(side(names.select("name"), "name", "n")), settled(side(known.select("known", "kind"), "known", "k"))
    met, rest = _candidates(ours, theirs, top)
    sure = ours.join(rest.select("name"), "name", "left_anti")
    met = met.select("name", F.col("known").alias("__known"), F.col("kind").alias("__kind"))
    pairs = met.join(ours, "name").join(theirs, (F.col("__known") == F.col("known")) & F.col("__kind").eqNullSafe(F.col("kind"))).drop("__known", "__kind")
    columns = ["name", "nl", "nt", "known", "kind", "kl", "kt"]
    for a, b in ((rest, theirs), (sure, theirs.filter(F.length("kl") > SHORT))):
        pairs = pairs.select(*columns).unionByName(_in_blocks(a, b).select(*columns))
    score = F.greatest(tx.spelling_score(F.col("nl"), F.col("kl")), tx.token_score(F.col("nt"), F.col("kt")))
    # Out of an array of one element: a filter on the score itself would go before it and work it out once more.
    found = pairs.select("name", "known", "kind", F.explode_outer(F.array(score)).alias("s")).filter(F.col("s") >= least).select("name", "known", "kind", F.bround("s", 2).alias("score"))
    order = Window.partitionBy("name").orderBy(F.desc("score"), "known", "kind")
    return found.withColumn("rank", F.row_number().over(order).cast("long")).filter(F.col("rank") <= top)


@query("scl_17_fuzzy_match")
def fuzzy_classes(m: Model) -> DataFrame:
    """Distinct names that code depends on against the names of definitions."""
    known = m.xml_definitions.select(F.col("name").alias("known"), F.col("definition_type").alias("kind"))
    deps = m.csharp_deps
    return fuzzy_match(deps.select(F.col("dependency_name").alias("name")), known)


def four_factor_score(a: F.Column, b: F.Column, kind_a: F.Column, kind_b: F.Column) -> F.Column:
    """Token overlap, edit, affix and semantic token similarity, weighted, and a bonus for the type."""
    x, y = tx.name_tokens(a), tx.name_tokens(b)
    return 0.35 * tx.jaccard(x, y) + 0.25 * tx.edit_similarity(a, b) + 0.15 * tx.affix_similarity(a, b) + 0.25 * tx.token_similarity(x, y) + tx.type_bonus(kind_a, kind_b)


def four_factor_match(names: DataFrame, known: DataFrame, least: float = 0.4, top: int = 5) -> DataFrame:
    """For each (name, expected) the best ``top`` of ``known`` (known, kind) by four factors, at least ``least``, capped at 1."""
    side = names.select("name", "expected").distinct()
    pairs = _in_blocks(side, known.select("known", "kind").distinct())
    scored = pairs.withColumn("s", four_factor_score(F.col("name"), F.col("known"), F.col("expected"), F.col("kind"))).filter(F.col("s") >= least)
    capped = scored.select("name", "expected", "known", "kind", F.round(F.least("s", F.lit(1.0)), 6).alias("score"))
    order = Window.partitionBy("name", "expected").orderBy(F.desc("score"), "known", "kind")
    return capped.withColumn("rank", F.row_number().over(order).cast("long")).filter(F.col("rank") <= top)


@query("scl_16_four_factor_match")
def four_factor_entities(m: Model) -> DataFrame:
    """Names of references that no definition has, against the definitions."""
    defs = m.xml_definitions
    missing = m.xml_references.join(defs.select(F.col("name").alias("target_name")), "target_name", "left_anti")
    known = defs.select(F.col("name").alias("known"), F.col("definition_type").alias("kind"))
    return four_factor_match(missing.select(F.col("target_name").alias("name"), F.col("target_type").alias("expected")), known, least=0.15)
