"""Events as code facts: who declares, fires and handles them, and which flows a patch covers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..model import Model, n, query
from .code import METHOD, lines

KEY = ["owner_type", "event_name"]


@query("evt_01_event_lookup", """
    SELECT 'declaration' AS kind, event_name, owner_type, delegate_type AS detail, CASE WHEN is_mod THEN 'MOD' ELSE 'GAME' END AS origin FROM event_declarations WHERE event_name ILIKE '%c%'
    UNION ALL SELECT 'subscription', event_name, owner_type, subscriber_type || '.' || handler_method, CASE WHEN is_mod THEN 'MOD' ELSE 'GAME' END FROM event_subscriptions WHERE event_name ILIKE '%c%'
    UNION ALL SELECT 'fire', event_name, owner_type, firer_type || CASE WHEN is_conditional THEN ' (conditional)' ELSE ' (always)' END, CASE WHEN is_mod THEN 'MOD' ELSE 'GAME' END FROM event_fires WHERE event_name ILIKE '%c%'""")  # fmt: skip
def event_lookup(m: Model, pattern: str = "%c%") -> DataFrame:
    """Declarations, subscriptions and fires of events by name."""
    origin = F.when(F.col("is_mod"), "MOD").otherwise("GAME").alias("origin")
    of = lambda rows, kind, detail: rows.filter(F.col("event_name").ilike(pattern)).select(F.lit(kind).alias("kind"), "event_name", "owner_type", detail.alias("detail"), origin)
    fired = F.concat("firer_type", F.when(F.col("is_conditional"), " (conditional)").otherwise(" (always)"))
    out = of(m.event_declarations, "declaration", F.col("delegate_type"))
    return out.unionByName(of(m.event_subscriptions, "subscription", F.concat_ws(".", "subscriber_type", "handler_method"))).unionByName(of(m.event_fires, "fire", fired))


@query("evt_02_event_flow", """
    SELECT f.id AS fire_id, f.event_name, f.owner_type, f.firer_type, f.is_conditional, coalesce(s.subscriber_type, '') AS subscriber_type, coalesce(s.handler_method, '') AS handler_method, coalesce(p.patch_count, 0) AS patch_count
    FROM event_fires f LEFT JOIN event_subscriptions s ON s.owner_type = f.owner_type AND s.event_name = f.event_name
    LEFT JOIN (SELECT target_class, target_method, count(*) AS patch_count FROM harmony_patches GROUP BY 1, 2) p ON p.target_class = s.subscriber_type AND p.target_method = s.handler_method""")  # fmt: skip
def event_flow(m: Model) -> DataFrame:
    """Each fire with its handlers and how many patches those have."""
    handlers = m.event_subscriptions.select(*KEY, "subscriber_type", "handler_method")
    patches = m.harmony_patches.groupBy(F.col("target_class").alias("subscriber_type"), F.col("target_method").alias("handler_method")).agg(n().alias("patch_count"))
    flow = m.event_fires.select(F.col("id").alias("fire_id"), *KEY, "firer_type", "is_conditional").join(handlers, KEY, "left").join(patches, ["subscriber_type", "handler_method"], "left")
    return flow.fillna("", ["subscriber_type", "handler_method"]).fillna(0, ["patch_count"])


@query("evt_03_effective_callers", """
    SELECT t.name AS target_class, me.name AS target_method, count(DISTINCT c.caller_id) AS affected_callers FROM methods me JOIN types t ON me.type_id = t.id JOIN calls c ON c.callee_id = me.id GROUP BY 1, 2""")  # fmt: skip
def effective_callers(m: Model) -> DataFrame:
    """How many callers a change of each method reaches."""
    types = m.types.select(F.col("id").alias("type_id"), F.col("name").alias("target_class"))
    methods = m.methods.select(F.col("id").alias("callee_id"), "type_id", F.col("name").alias("target_method"))
    return m.calls.join(methods, "callee_id").join(types, "type_id").groupBy("target_class", "target_method").agg(F.countDistinct("caller_id").alias("affected_callers"))


#: Names known to be events, whatever their case, and how the names of others begin, end or go.
KNOWN_EVENTS = (
    "DragAndDropItemChanged", "OnBackpackItemsChangedInternal", "OnToolbeltItemsChangedInternal", "OnInventoryChanged", "ItemsChanged", "SlotChanged", "OnOpen",
    "OnClose", "OnValueChanged", "OnClick", "OnPress",
)
FIRED_LIKE = r"^On|Changed$|Event$|ItemsChanged"
HANDLED_LIKE = FIRED_LIKE + r"|Fired$|Triggered$|Handler$|Click|Press"


def looks_like_event(name: Column, pattern: str = HANDLED_LIKE) -> Column:
    return F.lower(name).isin(*map(str.lower, KNOWN_EVENTS)) | F.rlike(name, F.lit(pattern))


@query("evt_05_event_names", f"""
    WITH n AS (SELECT DISTINCT event_name FROM event_declarations UNION SELECT DISTINCT 'On' || event_name || 'Raised' FROM event_declarations UNION SELECT DISTINCT event_name || 'Fired' FROM event_declarations
      UNION SELECT DISTINCT 'SLOT' || upper(event_name) FROM event_declarations UNION SELECT 'slotchanged' UNION SELECT 'MouseClicks' UNION SELECT 'onlooker')
    SELECT event_name, lower(event_name) IN ({", ".join(f"'{k.lower()}'" for k in KNOWN_EVENTS)}) OR starts_with(event_name, 'On') OR suffix(event_name, 'Changed') OR suffix(event_name, 'Event') OR suffix(event_name, 'Fired')
      OR suffix(event_name, 'Triggered') OR suffix(event_name, 'Handler') OR contains(event_name, 'ItemsChanged') OR contains(event_name, 'Click') OR contains(event_name, 'Press') AS handled_like,
      lower(event_name) IN ({", ".join(f"'{k.lower()}'" for k in KNOWN_EVENTS)}) OR starts_with(event_name, 'On') OR suffix(event_name, 'Changed') OR suffix(event_name, 'Event') OR contains(event_name, 'ItemsChanged') AS fired_like FROM n""")  # fmt: skip
def event_names(m: Model) -> DataFrame:
    """Whether a name may be that of an event that is handled, or (with fewer rules) fired; over declared names and forms of them."""
    name = F.col("event_name")
    own = m.event_declarations.select("event_name").distinct()
    forms = F.array(name, F.concat(F.lit("On"), name, F.lit("Raised")), F.concat(name, F.lit("Fired")), F.concat(F.lit("SLOT"), F.upper(name)), *map(F.lit, ("slotchanged", "MouseClicks", "onlooker")))
    names = own.select(F.explode(forms).alias("event_name")).distinct()
    return names.select("event_name", looks_like_event(name).alias("handled_like"), looks_like_event(name, FIRED_LIKE).alias("fired_like"))


#: What a variable's name says of its type.
OWNER_OF_VARIABLE = {
    "player": "EntityPlayerLocal", "entityPlayer": "EntityPlayerLocal", "_player": "EntityPlayerLocal", "backpack": "Bag", "Backpack": "Bag", "_backpack": "Bag",
    "toolbelt": "Inventory", "Toolbelt": "Inventory", "_toolbelt": "Inventory",
}
OWNER_OF_MEMBER = {"Backpack": "Bag", "Toolbelt": "Inventory", "Player": "EntityPlayerLocal"}


def _owner(receiver: Column, own: Column) -> Column:
    """Type of the object that an event belongs to, by the text before it; without any, the class around it."""
    last = F.substring_index(receiver, ".", -1)
    pick = lambda table, key: F.coalesce(*(F.when(key == k, v) for k, v in table.items()))
    variable = F.coalesce(pick(OWNER_OF_VARIABLE, receiver), F.when(F.rlike(receiver, F.lit("[iI]nventory")), "XUiM_PlayerInventory"), receiver)
    return F.when((receiver == "") | (receiver == "this"), own).when(F.contains(receiver, F.lit(".")), F.coalesce(pick(OWNER_OF_MEMBER, last), last)).otherwise(variable)


def event_rows(files: DataFrame) -> DataFrame:
    """file_path, content -> declarations, subscriptions and fires of events, one row each, with the class around them.

    kind: declaration, subscription or fire; detail: the delegate's type, ``add`` or ``remove``, or how it is fired; handler:
    the method that a subscription names (``<lambda>`` for one without a name); conditional: fired only if not null.
    """
    order = Window.partitionBy("file_path").orderBy("line_number").rowsBetween(Window.unboundedPreceding, 0)
    rows = lines(files).withColumn("type", F.last(F.nullif(F.regexp_extract("line", r"\b(?:class|struct|interface)\s+(\w+)", 1), F.lit("")), ignorenulls=True).over(order))
    code = rows.filter(~F.rlike("line", F.lit(r"^\s*(//|\*|/\*)")))
    own = F.coalesce("type", F.lit("Unknown"))
    hit = lambda pattern: code.select("file_path", "line_number", "line", own.alias("type"), F.explode(F.regexp_extract_all("line", F.lit(pattern), F.lit(0))).alias("hit"))
    part = lambda pattern, k: F.regexp_extract("hit", pattern, k)
    no = F.lit(None)
    shape = lambda rows, kind, owner, name, detail, handler=no, conditional=no: rows.select(
        "file_path", "line_number", F.lit(kind).alias("kind"), "type", owner.alias("owner_type"), name.alias("event_name"), detail.alias("detail"),
        handler.cast("string").alias("handler"), conditional.cast("boolean").alias("conditional"),
    )
    declares = r"\bevent\s+([\w.]+(?:<[^;{=]*>)?)\s+(\w+)\s*(?:[;={]|$)"
    declared = shape(hit(declares), "declaration", F.col("type"), part(declares, 2), part(declares, 1))
    subscribes = r"((?:\w+\.)*)(\w+)\s*([+-])=\s*([^;]+)"
    right = F.trim(part(subscribes, 4))
    made = F.coalesce(F.nullif(F.regexp_extract(right, r"^new\s+[\w.<>]+\(\s*([\w.]+)", 1), F.lit("")), right)
    handler = F.when(F.contains(right, F.lit("=>")), "<lambda>").otherwise(F.substring_index(made, ".", -1))
    before = F.regexp_replace(part(subscribes, 1), r"\.$", "")
    found = hit(subscribes).filter(looks_like_event(part(subscribes, 2)))
    subscribed = shape(found, "subscription", _owner(before, F.col("type")), part(subscribes, 2), F.when(part(subscribes, 3) == "+", "add").otherwise("remove"), handler)
    invokes = r"((?:\w+\??\.)*)(\w+)(\??)\.(Invoke|DynamicInvoke)\s*\("
    before = F.regexp_replace(F.replace(part(invokes, 1), F.lit("?"), F.lit("")), r"\.$", "")
    found = hit(invokes).filter(looks_like_event(part(invokes, 2), FIRED_LIKE))
    invoked = shape(found, "fire", _owner(before, F.col("type")), part(invokes, 2), part(invokes, 4), conditional=F.contains(F.col("hit"), F.lit("?")))
    # A direct call: a name by itself, neither a member nor what a declaration declares.
    calls = r"(?<![\w.])(?<!\bnew )(\w+)\s*\("
    declaration = F.rlike("line", F.lit(METHOD)) | F.rlike("line", F.lit(r"\bdelegate\b"))
    found = hit(calls).filter(looks_like_event(part(calls, 1), FIRED_LIKE) & ~declaration)
    called = shape(found, "fire", F.col("type"), part(calls, 1), F.lit("direct"), conditional=F.lit(False))
    return declared.unionByName(subscribed).unionByName(invoked).unionByName(called)


@query("evt_07_flow_coverage", """
    SELECT f.event_name, f.owner_type, count(DISTINCT f.id) AS fires, count(DISTINCT s.id) AS subscribers, coalesce(bool_or(p.target_class IS NOT NULL), false) AS covered
    FROM event_fires f LEFT JOIN event_subscriptions s ON s.owner_type = f.owner_type AND s.event_name = f.event_name
    LEFT JOIN (SELECT DISTINCT target_class, target_method FROM harmony_patches) p ON p.target_class = s.subscriber_type AND p.target_method = s.handler_method WHERE f.is_mod GROUP BY 1, 2""")  # fmt: skip
def flow_coverage(m: Model) -> DataFrame:
    """Events that mods fire: is any of their handlers patched?"""
    patched = m.harmony_patches.select(F.col("target_class").alias("subscriber_type"), F.col("target_method").alias("handler_method")).distinct().withColumn("hit", F.lit(True))
    handlers = m.event_subscriptions.join(patched, ["subscriber_type", "handler_method"], "left").groupBy(*KEY).agg(F.countDistinct("id").alias("subscribers"), F.max(F.coalesce("hit", F.lit(False))).alias("covered"))
    fires = m.event_fires.filter("is_mod").groupBy(*KEY).agg(F.countDistinct("id").alias("fires"))
    out = fires.join(handlers, KEY, "left")
    return out.select("event_name", "owner_type", "fires", F.coalesce("subscribers", F.lit(0).cast("long")).alias("subscribers"), F.coalesce("covered", F.lit(False)).alias("covered"))


@query("evt_08_uncovered_subscribers", """
    SELECT DISTINCT s.owner_type, s.event_name, s.subscriber_type, s.handler_method, 'Medium' AS severity FROM event_subscriptions s JOIN event_fires f ON s.owner_type = f.owner_type AND s.event_name = f.event_name
    WHERE f.is_mod AND NOT EXISTS (SELECT 1 FROM harmony_patches p WHERE p.target_class = s.subscriber_type AND p.target_method = s.handler_method)""")  # fmt: skip
def uncovered_subscribers(m: Model) -> DataFrame:
    """Handlers of mod-fired events that no patch reaches."""
    fired = m.event_fires.filter("is_mod").select(*KEY).distinct()
    patched = m.harmony_patches.select(F.col("target_class").alias("subscriber_type"), F.col("target_method").alias("handler_method"))
    rows = m.event_subscriptions.join(fired, KEY, "left_semi").join(patched, ["subscriber_type", "handler_method"], "left_anti")
    return rows.select(*KEY, "subscriber_type", "handler_method", F.lit("Medium").alias("severity")).distinct()


@query("evt_08_missing_overloads", """
    SELECT DISTINCT hp.target_class, hp.target_method, hp.target_arg_types AS patched, o.target_arg_types AS missing,
      'Low' AS severity FROM harmony_patches hp JOIN harmony_patches o ON o.target_method = hp.target_method AND o.target_class = hp.target_class AND o.target_arg_types <> hp.target_arg_types
    WHERE NOT EXISTS (SELECT 1 FROM harmony_patches x WHERE x.mod_id = hp.mod_id AND x.target_class = hp.target_class AND x.target_method = hp.target_method AND x.target_arg_types = o.target_arg_types)""")  # fmt: skip
def missing_overloads(m: Model) -> DataFrame:
    """A mod patches one overload of a method but not another that is known."""
    method = ["target_class", "target_method"]
    own = m.harmony_patches.select("mod_id", *method, F.col("target_arg_types").alias("patched")).distinct()
    known = m.harmony_patches.select(*method, F.col("target_arg_types").alias("missing")).distinct()
    gaps = own.join(known, method).filter("patched <> missing").join(own.withColumnRenamed("patched", "missing"), ["mod_id", *method, "missing"], "left_anti")
    return gaps.select(*method, "patched", "missing", F.lit("Low").alias("severity")).distinct()
