"""Scans of documents: config files, change files and source files are written from the tables, one for each row, and read
back by the parsers; the SQL states what must come out, from the tables alone."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..model import Model, query
from ..sources import sinks, xml_config
from ..sources import source_code as sc
from . import code, ecosystem, events
from .shapes import Shapes, config_shapes

KEY = "CAST(p_partkey AS VARCHAR)"


def _part(m: Model) -> DataFrame:
    return m.spark.read.parquet(f"{m.sf_dir}/part.parquet")


def _text(template: str, **values: Column) -> Column:
    """The template with each ``{name}`` replaced by a column."""
    out = F.lit(template)
    for name, value in values.items():
        out = F.replace(out, F.lit("{" + name + "}"), value.cast("string"))
    return out


# --- Config files -----------------------------------------------------------------------------------------------------

#: By survey number: tag, entity type, naming attribute, attribute of the parent, root, and the shapes of this kind alone.
CONFIGS = {
    "src_02_items": ("item", "item", "name", "parent", "items", [
        ('<item name="x{K}_{J}">\n<property name="Extends" value="base{Z}"/>\n<property class="Action0">\n<property name="SoundRandom" value="s{Z}"/>\n</property></item>',
         [(1, "x{K}_{J}", "base{Z}"), (2, "property", "Extends", "base{Z}", ""), (3, "property", "", "", "Action0"), (4, "property", "SoundRandom", "s{Z}", "Action0"), (2, "reference", "item", "base{Z}", "property:Extends"), (4, "reference", "sound", "s{Z}", "property:SoundRandom")])]),
    "src_03_blocks": ("block", "block", "name", None, "blocks", [
        ('<block name="b{K}_{J}">\n<property name="Extends" value="c{Z}"/></block>', [(1, "b{K}_{J}", "c{Z}"), (2, "property", "Extends", "c{Z}", ""), (2, "reference", "item", "c{Z}", "property:Extends")])]),
    "src_04_entity_classes": ("entity_class", "entity_class", "name", "extends", "entity_classes", [
        ('\n<entity_class name="e{K}_{J}" extends="z{Z}"><property name="LootListOnDeath" value="l{Z}"/></entity_class>', [(2, "e{K}_{J}", "z{Z}"), (2, "property", "LootListOnDeath", "l{Z}", ""), (2, "reference", "loot_group", "l{Z}", "property:LootListOnDeath")])]),
    "src_05_entity_groups": ("entitygroup", "entity_group", "name", None, "entitygroups", [
        ('<entitygroup name="g{K}_{J}">\nzombie{Z}, 1\n\n  zombieB\n<![CDATA[bear,2]]></entitygroup>', [(1, "g{K}_{J}", ""), *((1, "reference", "entity_class", x, "group_member") for x in ("zombie{Z}", "zombieB", "bear"))])]),
    "src_06_buffs": ("buff", "buff", "name", None, "buffs", [
        ('<buff name="u{K}_{J}">\n<effect_group>\n<triggered_effect action="AddBuff" buff="v{Z}, w,," sound="x" event=""/>\n<triggered_effect event="ev"/></effect_group></buff>',
         [(1, "u{K}_{J}", ""), (3, "reference", "buff", "v{Z}", "triggered_effect:AddBuff"), (3, "reference", "buff", "w", "triggered_effect:AddBuff"), (3, "reference", "sound", "x", "triggered_effect:AddBuff"), (4, "reference", "game_event", "ev", "triggered_effect:")])]),
    "src_07_recipes": ("recipe", "recipe", "name", None, "recipes", [
        ('<recipe name="y{K}_{J}" count="1">\n<ingredient name="wood{Z}" count="2"/>\n<ingredient count="1"/><ingredient name="nail"/></recipe>', [(1, "y{K}_{J}", ""), (2, "reference", "item", "wood{Z}", "recipe_ingredient"), (3, "reference", "item", "nail", "recipe_ingredient")])]),
    "src_08_sounds": ("SoundDataNode", "sound", "name", None, "Sounds", [('<SoundDataNode name="s{K}_{J}"><AudioClip ClipName="c{Z}"/></SoundDataNode>', [(1, "s{K}_{J}", "")])]),
    "src_09_vehicles": ("vehicle", "vehicle", "name", None, "vehicles", [('<vehicle name="v{K}_{J}"><property name="Speed" value="{Z}"/></vehicle>', [(1, "v{K}_{J}", ""), (1, "property", "Speed", "{Z}", "")])]),
    "src_10_quests": ("quest", "quest", "id", None, "quests", [('<quest name="no{K}"/><quest id="t{K}_{J}">\n<property name="Tier" value="{Z}"/></quest>', [(1, "t{K}_{J}", ""), (2, "property", "Tier", "{Z}", "")])]),
    "src_11_game_events": ("action_sequence", "game_event", "name", None, "gameevents", [
        ('<action_sequence name="a{K}_{J}"><property name="BuffOnEat" value="b{Z}"/></action_sequence>', [(1, "a{K}_{J}", ""), (1, "property", "BuffOnEat", "b{Z}", ""), (1, "reference", "buff", "b{Z}", "property:BuffOnEat")])]),
    "src_12_progression": ("skill", "skill", "name", None, "progression", [
        ('<skills>\n<skill name="k{K}_{J}" max_level="{Z}"></skill>\n</skills><perks><perk name="pk{K}_{J}"/></perks>', [(2, "k{K}_{J}", ""), (3, "definition", "perk", "pk{K}_{J}", "")])]),
    "src_13_loot": ("lootgroup", "loot_group", "name", None, "lootcontainers", [
        ('<lootgroup name="l{K}_{J}">\n<item name="gun{Z}" count="1"/>\n<item group="no"/>\n</lootgroup><lootcontainer id="{Z}"/>', [(1, "l{K}_{J}", ""), (2, "reference", "item", "gun{Z}", "loot_entry"), (4, "definition", "loot_container", "{Z}", "")])]),
}
CONFIG_SHAPES = {name: config_shapes(*args) for name, args in CONFIGS.items()}
CONFIG_COLUMNS = "kind VARCHAR, what VARCHAR, value VARCHAR, context VARCHAR"
#: Documents without their last line end in an error there.
BROKEN = " UNION ALL SELECT PATH, CAST(lines AS INTEGER), 'error', '', '', '' FROM ends WHERE cut UNION ALL SELECT replace('f{K}.xml', '{K}', CAST(p_partkey AS VARCHAR)), 1, 'error', '', '', '' FROM part WHERE p_partkey % 17 IN (3, 5)"


def _config_rows(m: Model, shapes: Shapes) -> DataFrame:
    rows = xml_config.config_rows(shapes.documents(_part(m)))
    is_ = lambda kind: F.col("kind") == kind
    what = F.when(is_("definition"), F.col("definition_type")).when(is_("property"), F.col("property_name")).when(is_("reference"), F.col("target_type"))
    value = F.when(is_("definition"), F.col("name")).when(is_("property"), F.col("property_value")).when(is_("reference"), F.col("target_name"))
    context = F.when(is_("definition"), F.col("extends")).when(is_("property"), F.col("property_class")).when(is_("reference"), F.col("context"))
    empty = lambda c: F.coalesce(c, F.lit(""))
    return rows.select("path", F.col("line_number").cast("int").alias("line_number"), "kind", empty(what).alias("what"), empty(value).alias("value"), empty(context).alias("context"))


for _name, _shapes in CONFIG_SHAPES.items():
    query(_name, _shapes.sql(CONFIG_COLUMNS, BROKEN), shapes=_shapes)(_config_rows)


def _all_configs(m: Model) -> DataFrame:
    part = _part(m)
    return reduce(DataFrame.unionByName, (shapes.documents(part).withColumn("path", F.concat(F.lit(f"{name}/"), "path")) for name, shapes in CONFIG_SHAPES.items()))


@query("src_01_config_scan", "SELECT definition_type, count(*) AS n, count(DISTINCT path) AS files FROM (" + " UNION ALL ".join(f"SELECT '{name}/' || path AS path, what AS definition_type FROM ({shapes.sql(CONFIG_COLUMNS)}) q WHERE kind = 'definition'" for name, shapes in CONFIG_SHAPES.items()) + ") t GROUP BY 1")
def config_scan(m: Model) -> DataFrame:
    """All kinds of config files in one pass: definitions by type, and how many files hold some."""
    found = xml_config.config_rows(_all_configs(m)).filter("kind = 'definition'")
    return found.groupBy("definition_type").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("path").alias("files"))


@query("src_18_surrogate_ids", f"""
    WITH rows AS ({CONFIG_SHAPES["src_02_items"].sql(CONFIG_COLUMNS)}), d AS (SELECT path, value AS name, line_number FROM rows WHERE kind = 'definition'),
    p AS (SELECT path, count(*) AS n FROM rows WHERE kind = 'property' GROUP BY 1), r AS (SELECT path, count(*) AS n FROM rows WHERE kind = 'reference' GROUP BY 1)
    SELECT d.path, min(id) AS first_id, count(*) AS definitions, coalesce(max(p.n), 0) AS properties, coalesce(max(r.n), 0) AS refs
    FROM (SELECT path, row_number() OVER (ORDER BY path, line_number) AS id FROM d) d LEFT JOIN p ON p.path = d.path LEFT JOIN r ON r.path = d.path GROUP BY 1""")  # fmt: skip
def surrogate_ids(m: Model) -> DataFrame:
    """Ids by file and place: each file's first, and what hangs on its definitions."""
    rows = sinks.stored(xml_config.config_rows(CONFIG_SHAPES["src_02_items"].documents(_part(m))), "config_rows")
    defs = sinks.stored(xml_config.definitions(rows), "definitions")
    files = defs.select("id", F.col("file_path").alias("path"))
    props = xml_config.properties(rows, defs).join(files, F.col("definition_id") == F.col("id")).groupBy("path").agg(F.count(F.lit(1)).alias("properties"))
    refs = xml_config.references(rows, defs).join(files, F.col("source_def_id") == F.col("id")).groupBy("path").agg(F.count(F.lit(1)).alias("refs"))
    out = files.groupBy("path").agg(F.min("id").alias("first_id"), F.count(F.lit(1)).alias("definitions")).join(props, "path", "left").join(refs, "path", "left")
    return out.fillna(0, ["properties", "refs"])


@query("src_19_config_tree", f"""
    SELECT {KEY} AS file_path, 'item' AS element_type, 'i' || {KEY} AS element_name, '/items/item[@name="i' || {KEY} || '"]' AS element_xpath, '' AS property_value, 2 AS line_number FROM part
    UNION ALL SELECT {KEY}, 'property', '', '/items/item[@name="i' || {KEY} || '"]/property[1]', CAST(p_size AS VARCHAR), 3 FROM part
    UNION ALL SELECT {KEY}, 'property', 'Size', '/items/item[@name="i' || {KEY} || '"]/property[@name="Size"]', 'x', 4 FROM part""")  # fmt: skip
def config_tree(m: Model) -> DataFrame:
    """Elements of any config document with their paths."""
    document = '<items>\n<item name="i{K}">\n<property value="{Z}"/>\n<property name="Size" value="x"/></item></items>'
    files = _part(m).select(F.col("p_partkey").cast("string").alias("file_path"), _text(document, K=F.col("p_partkey"), Z=F.col("p_size")).alias("content"))
    rows = sc.scan(files, sc.tree, sc.TREE_COLUMNS)
    return rows.select("file_path", "element_type", F.coalesce("element_name", F.lit("")).alias("element_name"), "element_xpath", F.coalesce("property_value", F.lit("")).alias("property_value"), F.col("line_number").cast("int").alias("line_number"))


# --- Change files -----------------------------------------------------------------------------------------------------


@query("src_20_change_scan", """
    WITH r AS (SELECT target_type, target_name, count(*) AS n FROM xml_references GROUP BY 1, 2), d AS (SELECT DISTINCT definition_type, name FROM xml_definitions),
    o AS (SELECT id, operation, replace(xpath, '"', '''') AS xpath, CASE WHEN operation = 'remove' THEN '' ELSE new_value END AS new_value, target_type, target_name FROM mod_xml_operations)
    SELECT 'mod/' || CAST(o.id // 8 AS VARCHAR) || '.xml' AS path, operation, xpath, new_value, o.target_type, o.target_name,
      CASE WHEN d.name IS NULL THEN 'Safe' WHEN operation = 'remove' AND coalesce(r.n, 0) > 0 THEN 'Conflict' WHEN operation = 'remove' OR coalesce(r.n, 0) > 5 THEN 'Caution' ELSE 'Safe' END AS impact,
      CAST(1 + row_number() OVER (PARTITION BY o.id // 8 ORDER BY o.id, '<' || operation || ' xpath="' || xpath || '">' || new_value) AS INTEGER) AS line_number
    FROM o LEFT JOIN d ON d.definition_type = o.target_type AND d.name = o.target_name LEFT JOIN r ON r.target_type = o.target_type AND r.target_name = o.target_name""")  # fmt: skip
def change_scan(m: Model) -> DataFrame:
    """Every operation written into the change document of its file, one to three in each, and read back with its target and how
    dangerous it is."""
    ops = m.mod_xml_operations
    one = F.concat(F.lit("<"), "operation", F.lit(' xpath="'), F.replace("xpath", F.lit('"'), F.lit("'")), F.lit('">'), F.when(F.col("operation") == "remove", "").otherwise(F.col("new_value")), F.lit("</"), "operation", F.lit(">"))
    files = ops.groupBy(F.expr("id div 8").alias("k")).agg(F.array_sort(F.collect_list(F.struct("id", one.alias("text")))).alias("all"))  # three at most
    document = F.concat(F.lit("<configs>\n"), F.array_join(F.transform("all", lambda x: x["text"]), "\n"), F.lit('\n<!-- <set xpath="/no"/> --></configs>'))
    found = xml_config.change_operations(files.select(F.concat(F.lit("mod/"), F.col("k").cast("string"), F.lit(".xml")).alias("path"), document.alias("content")))
    known = m.xml_definitions.select(F.col("definition_type").alias("target_type"), F.col("name").alias("target_name"), F.lit(True).alias("known"))
    refs = m.xml_references.groupBy("target_type", "target_name").agg(F.count(F.lit(1)).alias("refs"))
    rows = found.join(known, ["target_type", "target_name"], "left").join(refs, ["target_type", "target_name"], "left")
    impact = ecosystem.impact_class(F.col("operation"), F.col("known").isNotNull(), F.coalesce("refs", F.lit(0)))
    return rows.select("path", "operation", "xpath", F.coalesce("new_value", F.lit("")).alias("new_value"), "target_type", "target_name", impact.alias("impact"), F.col("line_number").cast("int").alias("line_number"))


@query("src_21_second_change_parser", """
    SELECT CAST(s_suppkey AS VARCHAR) AS file_path, 'set' AS operation, '/items/item[@name=''' || s_name || ''']/property[@name=''Tags'']/@value' AS xpath, 'Tags' AS property_name, CAST(s_nationkey AS VARCHAR) AS new_value, 'items.xml' AS xml_file FROM supplier
    UNION ALL SELECT CAST(s_suppkey AS VARCHAR), 'append', '/entityclasses', '', '<entity_class name="' || s_name || '">...</entity_class>', 'entityclasses.xml' FROM supplier
    UNION ALL SELECT CAST(s_suppkey AS VARCHAR), 'append', '/perks', '', '<perk/>', 'perks.xml' FROM supplier
    UNION ALL SELECT CAST(s_suppkey AS VARCHAR), 'csv', '/loot/@count', 'count', 'a', 'loot.xml' FROM supplier
    UNION ALL SELECT CAST(s_suppkey AS VARCHAR), 'removeattribute', '/ui/window/@id', 'id', '', CAST(s_suppkey AS VARCHAR) FROM supplier""")  # fmt: skip
def second_change_parser(m: Model) -> DataFrame:
    """Operations with paths, paths under other names, and whole entities as additions."""
    supplier = m.spark.read.parquet(f"{m.sf_dir}/supplier.parquet")
    document = (
        "<configs><set xpath=\"/items/item[@name='{N}']/property[@name='Tags']/@value\">{V}</set>\n<Entity_Class name=\"{N}\"><x/></Entity_Class>\n<perk/>"
        '<csv xpath="/loot/@count">a</csv><window/><group><removeattribute xpath="/ui/window/@id"/></group></configs>'
    )
    files = supplier.select(F.col("s_suppkey").cast("string").alias("path"), _text(document, N=F.col("s_name"), V=F.col("s_nationkey")).alias("content"))
    empty = lambda c: F.coalesce(c, F.lit("")).alias(c)
    return xml_config.xml_changes(files).select("file_path", "operation", "xpath", empty("property_name"), empty("new_value"), "xml_file")


#: Info files of mods, by their key: full, with other quotes and case, with attributes left out, broken, empty.
INFOS = [
    '<xml>\n<Name value="{N}"/><DisplayName value="The {N}"/><Version value="1.{V}"/>\n<Author value="author"/><Description value="ü &amp; more"/><Website value="http://x/{V}"/></xml>', "<xml><name value='{N}'/><VERSION value='2.{V}'/></xml>",
    '<xml><Name value="{N}"/><Version value=""/><Author value="a b"/></xml>', '<xml><Name value="{N}"', '<xml><ModInfo><Name value="{N}" /><Version value="3.{V}" compat="A21" /></ModInfo></xml>', '<!-- nothing -->', '<xml><DisplayName value="{N}"/>\n\n<Author   value="z"/></xml>',
]


@query("src_22_mod_scan", """
    WITH s AS (SELECT s_suppkey AS k, s_name AS n, CAST(s_nationkey AS VARCHAR) AS v, CAST(s_suppkey % 7 AS INTEGER) AS shape FROM supplier)
    SELECT 'mod' || lpad(CAST(k AS VARCHAR), 9, '0') AS folder, CASE WHEN shape < 5 THEN n END AS name, CASE shape WHEN 0 THEN 'The ' || n WHEN 6 THEN n END AS display_name, CASE shape WHEN 0 THEN '1.' || v WHEN 1 THEN '2.' || v WHEN 4 THEN '3.' || v END AS version,
      CASE shape WHEN 0 THEN 'author' WHEN 2 THEN 'a b' WHEN 6 THEN 'z' END AS author, CASE WHEN shape = 0 THEN 'ü &amp; more' END AS description, CASE WHEN shape = 0 THEN 'http://x/' || v END AS website, k % 3 = 0 AS has_xml, k % 4 = 1 AS has_dll, row_number() OVER (ORDER BY k) AS load_order FROM s""")  # fmt: skip
def mod_scan(m: Model) -> DataFrame:
    """Mods from their folders' files, in load order."""
    s = m.spark.read.parquet(f"{m.sf_dir}/supplier.parquet")
    k = F.col("s_suppkey")
    root = F.concat(F.lit("/mods/mod"), F.lpad(k.cast("string"), 9, "0"))
    shape = F.get(F.array(*map(F.lit, INFOS)), (k % len(INFOS)).cast("int"))
    info = F.replace(F.replace(shape, F.lit("{N}"), F.col("s_name")), F.lit("{V}"), F.col("s_nationkey").cast("string"))
    file = lambda name, content: F.struct(F.concat(root, F.lit(name)).alias("path"), content.alias("content"))
    none = F.lit(None).cast("string")
    files = F.array(file("/ModInfo.xml", info), F.when(k % 3 == 0, file("/Config/items.xml", F.lit("<configs/>"))), F.when(k % 4 == 1, file("/Mod.dll", none)), F.when(k % 3 == 1, file("/UIAtlases/x.xml", none)), F.when(k % 4 == 2, file("/Libs/x.dll.txt", none)))
    return xml_config.mods(s.select(F.explode(F.array_compact(files)).alias("f")).select("f.*"))


# --- Source files -----------------------------------------------------------------------------------------------------

HEAD = """using System;
using Alias = System.Text.StringBuilder;
public class C{K} : BlockDoor, IModApi
{
    public event Action<int> OnBag{K}Changed;
    private static bool enableDebug = false;"""

#: Members of a class: the text, the member's name, and what each rule finds in it, by query: (line in the member, values).
MEMBERS: list[tuple[str, str, dict[str, list[tuple]]]] = [
    ("    public int Size { get; set; }", "Size (property)", {}),
    ("    public bool Ready => count > 0;", "Ready (property)", {}),
    ("""    public virtual List<int> Use(int n, string s)
    {
        // TODO: mend {Z}
        var i = ItemClass.GetItem("item{Z}");
        player.AddBuff("buff{Z}");
        // player.AddBuff("comment");
    }""", "Use", {
        "todo": [(3, "INFO", "medium")], "hard": [(4, "item", "item{Z}"), (5, "buff", "buff{Z}")], "rules": [(4, "item", "item{Z}"), (5, "buff", "buff{Z}")], "calls": [(4, "ItemClass", "GetItem")], "methods": [(1, "Use", "int n, string s", 6)]}),
    ("""    private void Play{J}()
    {
        if (speed == 1.5f && ready) Manager.Play(this, "bang{Z}");
        if (count == 15 && ready) Mathf.Abs(n);
        throw new NotImplementedException();
        Foo.Bar(n);
    }""", "Play{J}", {
        "unimplemented": [(5, "WARNING", "high")], "suspicious": [(3, "INFO", "low")], "hard": [(3, "sound", "bang{Z}")], "rules": [(3, "sound", "bang{Z}")], "unreachable": [(6, "Foo.Bar(n);")], "calls": [(3, "Manager", "Play"), (6, "Foo", "Bar")],
        "methods": [(1, "Play{J}", "", 6)]}),
    ("""    internal static bool Check(string name)
    {
        if (name == "x{Z}") Helper{Z}.Run();
        if (title.Equals("x{Z}", StringComparison.Ordinal)) return;
        try { Go(); } catch (Exception e) { }
        return false;
    }""", "Check", {"suspicious": [(3, "INFO", "low")], "catch": [(5, "WARNING")], "calls": [(3, "Helper{Z}", "Run")], "methods": [(1, "Check", "string name", 6)]}),
    ("""    protected override void Read(DataBag bag)
    {
        bag.Values.TryGetValue("prop{Z}", out var v);
        props.Properties.parseint(nameof(C.Size{Z}));
        other.GetInt("Nope");
    }""", "Read", {"access": [(3, "Read", "TryGetValue", "prop{Z}"), (4, "Read", "parseint", "Size{Z}")], "calls": [(3, "Values", "TryGetValue")], "methods": [(1, "Read", "DataBag bag", 5)]}),
    ("""    public void Fire(int n)
    {
        OnBag{K}Changed?.Invoke(n);
        OnPress(n);
        playerInventory.Backpack.OnBackpackItemsChangedInternal += HandleBag;
        toolbelt.SlotChanged -= new Handler(this.Slot{Z});
        counter += n;
    }""", "Fire", {
        "events": [(3, "fire", "C{K}", "C{K}", "OnBag{K}Changed", "Invoke", "", "true"), (4, "fire", "C{K}", "C{K}", "OnPress", "direct", "", "false"), (5, "subscription", "C{K}", "Bag", "OnBackpackItemsChangedInternal", "add", "HandleBag", "false"),
                   (6, "subscription", "C{K}", "Inventory", "SlotChanged", "remove", "Slot{Z}", "false")], "methods": [(1, "Fire", "int n", 7)]}),
    ("""    public string Text(int n)
    {
        var s = Localization.Get("key{Z}");
        new ConsoleCmdAbstract("cmd{Z}");
        return s;
    }""", "Text", {"rules": [(3, "localization", "key{Z}")], "secret": [(4, "OPPORTUNITY", "high")], "calls": [(3, "Localization", "Get")], "methods": [(1, "Text", "int n", 5)]}),
    ("    private string Stub{J}() { return null; }", "Stub{J}", {"stub": [(1, "INFO")], "methods": [(1, "Stub{J}", "", 0)]}),
    ("    private string Update() { return null; }", "Update", {"methods": [(1, "Update", "", 0)]}),
    ("""    internal void Debug{J}()
    {
#if DEBUG
        x = 2; /* BUG not a mark */ // FIXME: {Z}
#endif
    }""", "Debug{J}", {"secret": [(3, "OPPORTUNITY", "high")], "todo": [(4, "WARNING", "medium")], "methods": [(1, "Debug{J}", "", 5)]}),
    ("""    public int Brace{J}(string text)
    {
        var s = "{ not a brace }"; // } nor this
        /* catch { }
           throw elsewhere; */
        if (s == null) { return 0; }
        try { Go(); }
        catch
        {
        }
        return text.Length;
    }""", "Brace{J}", {"catch": [(4, "WARNING"), (8, "WARNING")], "methods": [(1, "Brace{J}", "string text", 11)]}),
]
SOURCE_SHAPES = Shapes(HEAD, "}", [(text, []) for text, _, _ in MEMBERS], "C{K}.cs")


def _sources(m: Model) -> DataFrame:
    return SOURCE_SHAPES.documents(_part(m)).withColumnRenamed("path", "file_path")


def _source_sql(rule: str, columns: str, head: list[tuple] = (), with_member: bool = False) -> str:
    """What a rule finds in all sources. head: (line, values) that every class begins with."""
    rows = [[(line, *values, *([name] if with_member else [])) for line, *values in found.get(rule, [])] for _, name, found in MEMBERS]
    names = [c.split() for c in columns.split(",")]
    cast = lambda v, t: f"CAST(replace(replace('{v}', '{{K}}', CAST(k AS VARCHAR)), '{{Z}}', CAST(z AS VARCHAR)) AS {t})"
    more = "".join(f" UNION ALL SELECT PATH, {line}, {', '.join(cast(v, t) for v, (_, t) in zip(values, names, strict=True))} FROM docs" for line, *values in head)
    return f"SELECT path AS file_path, CAST(line_number AS BIGINT) AS line_number, {', '.join(n for n, _ in names)} FROM ({SOURCE_SHAPES.sql(columns, more, rows)}) q"


def _rule(number: str, rule: str, name: str, head: list[tuple] = ()) -> None:
    def found(m: Model) -> DataFrame:
        return code.line_findings(_sources(m)).filter(F.col("analysis_type") == name).select("file_path", "line_number", "severity", "confidence", F.coalesce("member", F.lit("")).alias("member"))

    query(number, _source_sql(rule, "severity VARCHAR, confidence VARCHAR, member VARCHAR", head, True))(found)


_rule("cod_01_unimplemented", "unimplemented", "unimplemented")
_rule("cod_03_todo", "todo", "todo")
_rule("cod_06_suspicious", "suspicious", "suspicious")
_rule("cod_07_hidden_features", "secret", "secret", [(6, "OPPORTUNITY", "medium", "")])


@query("cod_02_empty_catch", _source_sql("catch", "severity VARCHAR"))
def empty_catch(m: Model) -> DataFrame:
    return code.block_findings(_sources(m)).filter("analysis_type = 'empty_catch'").select("file_path", "severity", F.col("line_number").cast("long").alias("line_number"))


@query("cod_04_stub_methods", _source_sql("stub", "severity VARCHAR"))
def stub_methods(m: Model) -> DataFrame:
    """Methods that only return nothing; not those that the engine calls."""
    return code.block_findings(_sources(m)).filter("analysis_type = 'stub_method'").select("file_path", "severity", F.col("line_number").cast("long").alias("line_number"))


@query("cod_05_unreachable", _source_sql("unreachable", "line VARCHAR"))
def unreachable(m: Model) -> DataFrame:
    return code.unreachable(_sources(m))


@query("cod_08_hardcoded_entities", _source_sql("hard", "entity_type VARCHAR, entity_name VARCHAR"))
def hardcoded_entities(m: Model) -> DataFrame:
    return code.hardcoded_entities(_sources(m))


@query("cod_09_entity_rules", _source_sql("rules", "entity_type VARCHAR, entity_name VARCHAR", [(3, "extends_block", "BlockDoor")]))
def entity_rules(m: Model) -> DataFrame:
    return code.entity_dependencies(_sources(m))


_MEMBER_LINES = [[(line, name) for line in range(1, text.count("\n") + 2)] for text, name, _ in MEMBERS]
_LAST = "[" + ", ".join(f"'{name}'" for _, name, _ in MEMBERS) + "]"


@query("cod_11_enclosing_members", "SELECT path AS file_path, CAST(line_number AS BIGINT) AS line_number, member FROM (" + SOURCE_SHAPES.sql("member VARCHAR", "".join(f" UNION ALL SELECT PATH, {n}, '' FROM docs" for n in range(1, 7)) + f"""
    UNION ALL SELECT PATH, CAST(lines + 1 AS INTEGER), coalesce(replace({_LAST}[s + 1], '{{J}}', CAST(j AS VARCHAR)), '') FROM (SELECT ends.k, ends.z, ends.cut, lines, max(j) AS j, arg_max(s, j) AS s FROM ends LEFT JOIN placed ON placed.k = ends.k GROUP BY 1, 2, 3, 4) t WHERE NOT cut""", _MEMBER_LINES) + ") q UNION ALL SELECT 'C' || CAST(p_partkey AS VARCHAR) || '.cs', 1, '' FROM part WHERE p_partkey % 17 IN (3, 5)")  # fmt: skip
def members(m: Model) -> DataFrame:
    """The member around each line."""
    return code.enclosing_members(code.lines(_sources(m))).select("file_path", "line_number", F.coalesce("member", F.lit("")).alias("member"))


@query("cod_13_call_graph", _source_sql("calls", "target_class VARCHAR, target_method VARCHAR"))
def call_graph(m: Model) -> DataFrame:
    """Static calls by line; common classes and methods are left out."""
    return code.static_calls(_sources(m))


@query("src_27_class_signatures", _source_sql("classes", "class_name VARCHAR, parent_class VARCHAR, interfaces VARCHAR", [(3, "C{K}", "BlockDoor", "IModApi")]))
def class_signatures(m: Model) -> DataFrame:
    return code.class_signatures(_sources(m))


@query("src_27_method_signatures", f"SELECT file_path, method, parameters, line_number AS first_line, line_number + more AS last_line FROM ({_source_sql('methods', 'method VARCHAR, parameters VARCHAR, more BIGINT')}) r")
def method_signatures(m: Model) -> DataFrame:
    """Methods with their parameters and the lines they span."""
    return sc.scan(_sources(m), sc.bodies, sc.BODY_COLUMNS).select("file_path", "method", "parameters", "first_line", "last_line")


@query("src_28_imports", f"SELECT file_path, alias, target FROM ({_source_sql('imports', 'alias VARCHAR, target VARCHAR', [(1, '', 'System'), (2, 'Alias', 'System.Text.StringBuilder')])}) r")
def imports(m: Model) -> DataFrame:
    return code.imports(_sources(m)).select("file_path", F.coalesce("alias", F.lit("")).alias("alias"), "target")


@query("flt_15_property_access", _source_sql("access", "member VARCHAR, access_method VARCHAR, property_name VARCHAR"))
def property_access(m: Model) -> DataFrame:
    return code.property_accesses(_sources(m))


@query("evt_04_event_extraction", _source_sql("events", "kind VARCHAR, type VARCHAR, owner_type VARCHAR, event_name VARCHAR, detail VARCHAR, handler VARCHAR, conditional BOOLEAN", [(5, "declaration", "C{K}", "C{K}", "OnBag{K}Changed", "Action<int>", "", "false")]))
def event_extraction(m: Model) -> DataFrame:
    """Declarations, subscriptions and fires of events in source files."""
    return events.event_rows(_sources(m)).withColumns({"handler": F.coalesce("handler", F.lit("")), "conditional": F.coalesce("conditional", F.lit(False))})


#: Classes of a file of patches: the text, and its patches: (line, kind, target class and method, priority, whether it returns a bool and
#: changes the result, the guard).
PATCHES: list[tuple[str, list[tuple]]] = [
    ("""[HarmonyPatch(typeof(Target{Z}), "Run")]
[HarmonyPriority(Priority.High)]
public class A{J}
{
    public static bool Prefix(int n, ref int __result)
    {
        if (n > {Z}) return true;
        return false;
    }
}""", [(5, "Prefix", "A{J}", "Target{Z}", "Run", 600, "true", "true", "n > {Z}")]),
    ("""[HarmonyPatch(typeof(Game.World{Z}), nameof(Game.World{Z}.Tick))]
internal static class B{J}
{
    private static void Postfix(World{Z} __instance) { Go(); }
    static IEnumerable<CodeInstruction> Transpiler(IEnumerable<CodeInstruction> all)
    {
        return all; // }
    }
}""", [(4, "Postfix", "B{J}", "Game.World{Z}", "Tick", 400, "false", "false", ""), (5, "Transpiler", "B{J}", "Game.World{Z}", "Tick", 400, "false", "false", "")]),
    ("""    [HarmonyPatch(typeof(Bag))]
    [HarmonyPatch("Add", new Type[] { typeof(int), typeof(List<string>) })]
    [HarmonyPriority({Z})]
    class D{J}
    {
        [HarmonyPrefix]
        public static void Prefix(ref Bag __result) { if (x) { return; } }
        public static Exception Finalizer(Exception e) { return null; }
    }""", [(7, "Prefix", "D{J}", "Bag", "Add", "{Z}", "false", "true", "x"), (8, "Finalizer", "D{J}", "Bag", "Add", "{Z}", "false", "false", "")]),
    ("""public class Plain{J}
{
    public static bool Prefix() { return true; }
}""", []),
    ("""[HarmonyPatch(typeof(Empty), "None")]
public class E{J}
{
    public static bool Prepare() { return true; }
    public bool Prefix() { return true; }
}""", []),
    ("""public class Init{J} { public void Go() { h.PatchAll(); h.Patch(AccessTools.Method(typeof(T{Z}), "M"), null); } }""", [(1, "PatchAll", "", "", "", 400, "", "", ""), (1, "Dynamic", "", "T{Z}", "M", 400, "", "", "")]),
    ("""[Serializable]
[HarmonyPatch(typeof(Door), "Open")] [HarmonyPriority(Priority.Last)]
public sealed class F{J} : Base
{
    public static bool Postfix(bool __state) { return __state; }
}""", [(5, "Postfix", "F{J}", "Door", "Open", 0, "true", "false", "")]),
    ("""// class Comment{J}
[HarmonyPatch(typeof(Ü{Z}), "Größe")]
public class G{J}
{
    public static void Prefix()
    {
        if (a && b)
            return;
    }
}""", [(5, "Prefix", "G{J}", "Ü{Z}", "Größe", 400, "false", "false", "a && b")]),
    ("""[HarmonyPatch(typeof(Cut{Z}), "Short")]
public class H{J} { static void Postfix() { var s = "}"; var c = '}'; } /* } */ }""", [(2, "Postfix", "H{J}", "Cut{Z}", "Short", 400, "false", "false", "")]),
    ("// nothing here", []),
]
PATCH_SHAPES = Shapes("using HarmonyLib;", "// the end", PATCHES, "P{K}.cs")
PATCH_COLUMNS = "patch_type VARCHAR, patch_class VARCHAR, target_class VARCHAR, target_method VARCHAR, harmony_priority INTEGER, returns_bool VARCHAR, modifies_result VARCHAR, guard_condition VARCHAR"
_PATCH_SQL = f"SELECT path AS file_path, CAST(line_number AS BIGINT) AS line_number, {', '.join(c.split()[0] for c in PATCH_COLUMNS.split(', '))} FROM ({PATCH_SHAPES.sql(PATCH_COLUMNS)}) q"


def _patches(m: Model) -> DataFrame:
    files = PATCH_SHAPES.documents(_part(m)).withColumnRenamed("path", "file_path")
    rows = sc.scan(files, sc.patches, sc.PATCH_COLUMNS)
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c)
    return rows.select("file_path", "line_number", "patch_type", text("patch_class"), text("target_class"), text("target_method"), "harmony_priority", text("returns_bool"), text("modifies_result"), text("guard_condition"))


@query("cod_16_patch_scan", f"SELECT * FROM ({_PATCH_SQL}) p WHERE patch_type NOT IN ('Dynamic', 'PatchAll')")
def patch_scan(m: Model) -> DataFrame:
    """Patches declared by attributes."""
    return _patches(m).filter("patch_type not in ('Dynamic', 'PatchAll')")


@query("cod_17_dynamic_patches", f"SELECT file_path, patch_type, target_class, target_method, line_number FROM ({_PATCH_SQL}) p WHERE patch_type IN ('Dynamic', 'PatchAll')")
def dynamic_patches(m: Model) -> DataFrame:
    """Patches made at run time."""
    return _patches(m).filter("patch_type in ('Dynamic', 'PatchAll')").select("file_path", "patch_type", "target_class", "target_method", "line_number")


@query("cod_15_patch_summary", f"SELECT patch_type, count(*) AS n, count(DISTINCT file_path) AS files FROM ({_PATCH_SQL}) p GROUP BY 1")
def patch_summary(m: Model) -> DataFrame:
    return _patches(m).groupBy("patch_type").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("file_path").alias("files"))
