"""Hand-made tables with the results that reading the definitions gives."""

import pytest

from strataweave.api import Engine
from strataweave.model import Model
from strataweave.operators import code, conflicts, graph, indirect, patches, relevance
from strataweave.sources import sinks, xml_config

OPS = "id long, mod_id long, operation string, xpath_hash string, xpath_normalized string, target_type string, target_name string, property_name string, new_value string"


@pytest.fixture(scope="module")
def ops(spark):
    mods = spark.createDataFrame([(1, "A", 1), (2, "B", 2), (3, "C", 3)], "id long, name string, load_order long")
    rows = [
        (1, 1, "set", "h1", "h1", "item", "gunT1", "Damage", "10"), (2, 2, "set", "h1", "h1", "item", "gunT1", "Damage", "20"), (3, 3, "remove", "h1", "h1", "item", "gunT1", None, None),
        (4, 1, "set", "h2", "h2", "item", "gunT2", "Ammo", "5"), (5, 2, "set", "h2", "h2", "item", "gunT2", "Ammo", "5"),
        (6, 1, "append", "h3", "h3", "entity_class", "zombieX", None, "a"), (7, 2, "append", "h4", "h4", "entity_class", "zombieX", None, "b"),
    ]
    defs = spark.createDataFrame([(1, "item", "gunT1", None), (2, "item", "gunT2", None), (3, "entity_class", "zombieX", None)], "id long, definition_type string, name string, extends string")
    return Model(spark, tables={"mods": mods, "mod_xml_operations": spark.createDataFrame(rows, OPS), "xml_definitions": defs})


def test_path_conflicts(ops):
    got = sorted((r["xpath_hash"], r["operation"], r["mod_count"], r["conflict_type"], r["base_severity"]) for r in conflicts.xpath_conflicts(ops).collect())
    assert got == [("h1", "set", 2, "REAL_CONFLICT", "LOW"), ("h2", "set", 2, "SAME_VALUE", "LOW")]


def test_destructive_contested_winners(ops):
    assert [r["winner"] for r in conflicts.destructive_conflicts(ops).collect()] == ["REMOVER_WINS"] * 2
    assert {r["target_name"]: r["risk_level"] for r in conflicts.contested_entities(ops).collect()} == {"gunT1": "HIGH", "gunT2": "LOW", "zombieX": "MEDIUM"}
    assert sorted((r["xpath_hash"], r["winning_mod"]) for r in conflicts.load_order_winners(ops).collect()) == [("h1", "B"), ("h2", "B")]


def test_conflicting_values(ops):
    got = [(r["mod1_id"], r["mod2_id"], r["entity"], r["property_name"]) for r in indirect.conflicting_base_values(ops).collect()]
    assert got == [(1, 2, "gunT1", "Damage")]


def test_closure(spark):
    defs = [(1, "item", "gunMaster", None), (2, "item", "gunT1", "gunMaster"), (3, "item", "gunT2", "gunT1"), (4, "item", "gunT3", "gunT2"), (5, "buff", "buffA", None), (6, "buff", "buffB", None)]
    refs = [(4, "buff", "buffA", "property:BuffOnEat"), (5, "buff", "buffB", "triggered_effect:AddBuff"), (6, "buff", "buffA", "triggered_effect:RemoveBuff"), (4, "item", "missing", "loot_entry")]
    m = Model(spark, tables={
        "xml_definitions": spark.createDataFrame(defs, "id long, definition_type string, name string, extends string"),
        "xml_references": spark.createDataFrame(refs, "source_def_id long, target_type string, target_name string, reference_context string"),
    })
    rows = {(r["source"], r["target"]): r for r in graph.closure(m).collect()}
    want = {(2, 1): 1, (3, 2): 1, (3, 1): 2, (4, 3): 1, (4, 5): 1, (4, 2): 2, (4, 6): 2, (4, 1): 3, (5, 6): 1, (6, 5): 1}
    assert {k: r["depth"] for k, r in rows.items()} == want
    assert rows[5, 6]["reference_types"] == "triggered_effect:AddBuff"
    assert rows[4, 6]["reference_types"] == "property,triggered_effect"
    assert rows[4, 1]["path"] == '["extends:3","extends:2","extends:1"]'


def test_patches(spark):
    rows = [
        (1, 1, "P", "C", "Run", "Prefix", '["int"]', 100, None, None, False, False, None), (2, 2, "P", "C", "Run", "Prefix", '["int"]', 800, None, None, True, False, None),
        (3, 1, "P", "C", "Run", "Postfix", '["int"]', 800, None, None, False, False, None), (4, 2, "P", "C", "Run", "Postfix", '["int"]', 100, None, None, False, True, "g"),
        (5, 1, "P", "D", "Go", "Transpiler", '["int"]', 400, None, None, False, False, None), (6, 2, "P", "D", "Go", "Transpiler", '["int"]', 400, '["A"]', None, False, False, None),
    ]
    schema = "id long, mod_id long, patch_class string, target_class string, target_method string, patch_type string, target_arg_types string, harmony_priority int, harmony_before string, harmony_after string, returns_bool boolean, is_guarded boolean, guard_condition string"
    m = Model(spark, tables={"mods": spark.createDataFrame([(1, "A", 1), (2, "B", 2)], "id long, name string, load_order long"), "harmony_patches": spark.createDataFrame(rows, schema)})
    assert {r["target_class"]: r["severity"] for r in patches.harmony_collisions(m).collect()} == {"C": "HIGH", "D": "CRITICAL"}
    assert [r["severity"] for r in patches.skip_conflicts(m).collect()] == ["HIGH"]
    order = {r["id"]: r["execution_order"] for r in patches.execution_order(m).collect()}
    assert (order[2], order[1], order[4], order[3]) == (1, 2, 1, 2)
    assert [(r["mod1"], r["mod2"]) for r in patches.order_conflicts(m).collect()] == [("B", "A")]


def test_scores(spark):
    names = ["ItemClass", "BlockManager", "EntityPlayer", "RecipeManager", "BuffClass", "XUiController", "SomeRandomClass"]
    from pyspark.sql import functions as F

    df = spark.createDataFrame([(n,) for n in names], "c string").select("c", relevance.entity_score(F.col("c"), F.lit(None)).alias("s"))
    assert {r["c"]: r["s"] for r in df.collect()} == dict(zip(names, [40, 35, 30, 25, 20, 10, 0], strict=True))
    cases = [("unimplemented", "Unreachable here", "X", -40), ("x", "", "DebugTool", -30), ("Todo", "", "X", -10), ("x", "ok", "X", 0)]
    df = spark.createDataFrame(cases, "t string, d string, c string, want int").select("want", relevance.artifact_penalty(F.col("t"), F.col("d"), F.col("c")).alias("s"))
    assert all(r["want"] == r["s"] for r in df.collect())


def test_config_documents(spark):
    files = [
        ("a/items.xml", '<items><item name="a"><property name="Extends" value="b"/><property class="Action0"><property name="Delay" value="1"/></property></item></items>'),
        ("a/groups.xml", '<g><entitygroup name="g1">zombieA, 1\nzombieB</entitygroup></g>'),
        ("a/recipes.xml", '<r>\n<recipe name="x"><ingredient name="p"/><ingredient name="q"/></recipe></r>'),
        ("a/loot.xml", '<l><lootgroup name="lg"><item name="i1"/><item name="i2"/></lootgroup></l>'),
        ("a/buffs.xml", '<b><buff name="bf"><triggered_effect action="AddBuff" buff="u, v"/></buff></b>'),
        ("a/broken.xml", "<items><item name='z'>"), ("a/none.xml", None),
    ]
    rows = xml_config.config_rows(spark.createDataFrame(files, "path string, content string")).cache()
    defs = xml_config.definitions(rows)
    assert {(r["definition_type"], r["name"], r["extends"]) for r in defs.collect()} == {("item", "a", "b"), ("entity_group", "g1", None), ("recipe", "x", None), ("loot_group", "lg", None), ("buff", "bf", None)}
    assert sorted(r["id"] for r in defs.collect()) == [1, 2, 3, 4, 5]
    refs = {(r["source_type"], r["target_name"], r["reference_context"]) for r in xml_config.references(rows, defs).collect()}
    assert refs == {("item", "b", "property:Extends"), ("item", "b", "extends"), ("entity_group", "zombieA", "group_member"), ("entity_group", "zombieB", "group_member"), ("recipe", "x", "recipe_output"), ("recipe", "p", "recipe_ingredient"), ("recipe", "q", "recipe_ingredient"), ("loot_group", "i1", "loot_entry"), ("loot_group", "i2", "loot_entry"), ("buff", "u", "triggered_effect:AddBuff"), ("buff", "v", "triggered_effect:AddBuff")}
    props = {(r["property_name"], r["property_value"], r["property_class"]) for r in xml_config.properties(rows, defs).collect()}
    assert props == {("Extends", "b", None), (None, None, "Action0"), ("Delay", "1", "Action0")}
    assert {r["path"] for r in rows.filter("kind = 'error'").collect()} == {"a/broken.xml", "a/none.xml"}
    assert rows.filter("definition_type = 'recipe'").first()["line_number"] == 2


def test_change_documents(spark):
    content = "<configs>\n<set xpath=\"/items/item[ @name = 'gunPistol' ]/property[@name='Damage']/@value\">12</set><remove xpath='/buffs/buff[@name=\"b1\"]'/></configs>"
    got = xml_config.change_operations(spark.createDataFrame([("m.xml", content)], "path string, content string")).orderBy("operation").collect()
    assert [(r["operation"], r["target_type"], r["target_name"], r["property_name"], r["new_value"], r["line_number"]) for r in got] == [("remove", "buff", "b1", None, "", 2), ("set", "item", "gunPistol", "Damage", "12", 2)]


def test_paths(spark):
    from pyspark.sql import functions as F

    from strataweave.functions import xpath as xp

    cases = [("/items/item[ @name = 'gunPistol' ]/", '/items/item[@name="gunPistol"]'), ("/i/x[last() and position()=1]", "/i/x[last() and position()=1]"), ("//x[position() = 1]", "//x[1]"), ("", ""), (None, "")]
    rows = spark.createDataFrame(cases, "p string, want string").select("want", xp.normalise(F.col("p")).alias("got"), xp.path_hash(F.col("p")).alias("h")).collect()
    assert [r["got"] for r in rows] == [r["want"] for r in rows]
    assert rows[3]["h"] == "" and len(rows[0]["h"]) == 16


def test_names(spark):
    from pyspark.sql import functions as F

    from strataweave.functions import text as tx

    row = spark.range(1).select(
        tx.name_tokens(F.lit("bridgeConcreteBlock")).alias("t"), tx.jaccard(tx.name_tokens(F.lit("concreteBlock")), tx.name_tokens(F.lit("bridgeConcreteBlock"))).alias("j"),
        tx.edit_similarity(F.lit("Gun"), F.lit("gun")).alias("e"), tx.affix_similarity(F.lit("abcxyz"), F.lit("abcyz")).alias("a"), tx.token_similarity(F.array(F.lit("gun")), F.array(F.lit("guns"))).alias("s"),
    ).first()
    assert row["t"] == ["bridge", "concrete", "block"] and abs(row["j"] - 2 / 3) < 1e-9 and row["e"] == 1 and abs(row["a"] - 5 / 6) < 1e-9 and row["s"] == 0.75


SOURCE = """using System;
using Alias = System.Text.Encoding;
public class ItemActionFoo : ItemAction, IModApi
{
    public bool Pressed
    {
        set {
            // TODO: fix this
            throw new NotImplementedException();
        }
    }
    protected virtual bool TryParse(string s)
    {
        try { Run(); } catch (Exception e) { }
        return false;
        x = 1;
    }
    public string Get() { return null; }
    void Use() { e.AddBuff("buffBurning"); // AddBuff("no")
        // e.AddBuff("buffCommented");
        GameManager.DoIt();
    }
}
"""


def test_code_rules(spark):
    files = spark.createDataFrame([("a.cs", SOURCE), ("b.cs", None)], "file_path string, content string")
    found = {(r["analysis_type"], r["line_number"]): (r["severity"], r["member"]) for r in code.line_findings(files).collect()}
    assert found == {("todo", 8): ("INFO", "Pressed (property)"), ("unimplemented", 9): ("WARNING", "Pressed (property)")}
    assert {(r["analysis_type"], r["line_number"]) for r in code.block_findings(files).collect()} == {("empty_catch", 14), ("stub_method", 18)}
    assert [(r["line_number"], r["line"]) for r in code.unreachable(files).collect()] == [(16, "x = 1;")]
    names = {(r["entity_type"], r["entity_name"]) for r in code.hardcoded_entities(files).collect()}
    assert ("buff", "buffBurning") in names and ("buff", "buffCommented") not in names
    built = {(r["entity_type"], r["entity_name"]) for r in code.entity_dependencies(files).collect()} - names
    assert built == {("extends_itemaction", "ItemAction")}
    assert ("GameManager", "DoIt") in {(r["target_class"], r["target_method"]) for r in code.static_calls(files).collect()}
    assert {(r["alias"], r["target"]) for r in code.imports(files).collect()} == {(None, "System"), ("Alias", "System.Text.Encoding")}
    assert [(r["class_name"], r["parent_class"], r["interfaces"]) for r in code.class_signatures(files).collect()] == [("ItemActionFoo", "ItemAction", "IModApi")]


def test_sinks(spark):
    old = spark.createDataFrame([(1, "a", None), (2, "b", "x")], "k int, v string, w string")
    new = spark.createDataFrame([(2, "B", None), (3, "C", "z")], "k int, v string, w string")
    rows = lambda df: sorted(tuple(r) for r in df.collect())
    assert [r[:2] for r in rows(sinks.upsert(old, new, ["k"]))] == [(1, "a"), (2, "B"), (3, "C")]
    assert [r[:2] for r in rows(sinks.insert_or_ignore(old, new, ["k"]))] == [(1, "a"), (2, "b"), (3, "C")]
    assert rows(sinks.keep_first(old, new, ["k"])) == [(1, "a", None), (2, "b", "x"), (3, "C", "z")]
    assert sinks.as_text(old.orderBy("k")).split("\n")[2] == "1 | a | NULL"
    assert sinks.as_text(old.limit(0)) == "(no results)"
    assert '{"k":1,"v":"a"}' in {r["json"] for r in sinks.as_json(old).collect()}
    assert "| 1 | a |  |" in sinks.as_markdown({"T": old})


def test_engine(spark, sf_dir):
    e = Engine(spark, sf_dir)
    assert e.sql("select count(*) as n from mods where id > :least", least=3).first()["n"] == 7
    assert set(e.detect_conflicts()) >= {"xpath_conflicts", "effect_summary"}
    assert e.report().startswith("## Stats")
    assert e.chain("Type1.Update", "Type5.M4", 3).count() >= 0
    assert indirect.persistable(e.model, e.indirect_conflicts()).select("pattern_id").distinct().count() >= 5


def test_stream_of_hashes(spark, tmp_path):
    from strataweave.streaming import hashes

    source, seen = tmp_path / "in", []
    source.mkdir()
    go = lambda: hashes.start(spark, str(source), str(tmp_path / "state"), str(tmp_path / "cp"), lambda df: seen.append(sorted(r["file_path"] for r in df.collect()))).awaitTermination()
    (source / "1.json").write_text('{"file_path": "a", "content": "1"}\n{"file_path": "b", "content": "2"}\n')
    go()
    (source / "2.json").write_text('{"file_path": "A", "content": "1"}\n{"file_path": "b", "content": "3"}\n')
    go()
    assert seen == [["a", "b"], ["b"]]


PATCHES = """
[HarmonyPatch(typeof(EntityPlayer), "Update", new Type[] { typeof(int), typeof(string) })]
[HarmonyPriority(Priority.High)]
[HarmonyBefore("other.mod")]
public class Patch_Update
{
    static bool Prefix(EntityPlayer __instance, ref int __result)
    {
        if (__instance == null) return true;
        var s = "}"; // }
        return false;
    }
    static void Postfix() { }
}
class Plain { void M() { harmony.Patch(AccessTools.Method(typeof(Block), "Place")); harmony.PatchAll(); } }
"""


def test_patch_scan(spark):
    from strataweave.sources import source_code as sc

    files = spark.createDataFrame([("p.cs", PATCHES), ("q.cs", None), ("r.cs", "class X")], "file_path string, content string")
    rows = {r["patch_type"]: r for r in sc.scan(files, sc.patches, sc.PATCH_COLUMNS).collect()}
    assert set(rows) == {"Prefix", "Postfix", "Dynamic", "PatchAll"}
    p = rows["Prefix"]
    assert (p["target_class"], p["target_method"], p["target_arg_types"], p["harmony_priority"], p["harmony_before"]) == ("EntityPlayer", "Update", '["int", "string"]', 600, '["other.mod"]')
    assert p["returns_bool"] and p["modifies_result"] and p["is_guarded"] and p["guard_condition"] == "__instance == null"
    assert (rows["Dynamic"]["target_class"], rows["Dynamic"]["target_method"]) == ("Block", "Place")


def test_bodies_and_trees(spark):
    from strataweave.sources import source_code as sc

    files = spark.createDataFrame([("a.cs", SOURCE), ("b.xml", '<r><a name="x"><b value="1"/><b/></a></r>')], "file_path string, content string")
    got = {r["method"]: (r["first_line"], r["last_line"]) for r in sc.scan(files, sc.bodies, sc.BODY_COLUMNS).collect()}
    assert got["TryParse"] == (12, 17) and got["Get"] == (18, 18)
    paths = [r["element_xpath"] for r in sc.scan(files.filter("file_path = 'b.xml'"), sc.tree, sc.TREE_COLUMNS).collect()]
    assert paths == ['/r/a[@name="x"]', '/r/a[@name="x"]/b[1]', '/r/a[@name="x"]/b[2]']


def test_types(spark):
    from pyspark.sql import functions as F

    from strataweave.functions import types as ty

    one = lambda c: spark.range(1).select(c).first()[0]
    assert one(ty.parameters(F.lit("Dictionary<int, string> a, int[] b"))) == ["Dictionary<int, string> a", "int[] b"]
    assert one(ty.resolved(F.lit("List<int?>[]"))) == "System.Collections.Generic.List<System.Nullable<System.Int32>>[]"
    assert one(ty.resolved(F.lit("Func<(int, Own.T<bool[ , ]>)?, nint>"))) == "Func<System.Nullable<(System.Int32,Own.T<System.Boolean[,]>)>,System.IntPtr>"
    assert one(ty.parameter_types(F.lit("ref int a, out List<string> b, params object[] c, float d = 1f"))) == ["System.Int32", "System.Collections.Generic.List<System.String>", "System.Object[]", "System.Single"]
    assert one(ty.parameter_types(F.lit("()"))) == [] and one(ty.resolved(F.lit(None).cast("string"))) is None
    df = spark.createDataFrame([("(int a, string b)", "(System.Int32 x, System.String y)"), ("(int a)", "(long a)"), (None, "()")], "a string, b string")
    assert [r[0] for r in df.select(ty.same_signature(F.col("a"), F.col("b"))).collect()] == [True, False, False]
    assert df.select(ty.parameters(F.lit("int a, List<b, c> d"))).first()[0] == ["int a", "List<b, c> d"]
    row = spark.range(1).select(ty.overload_matches(F.array(F.lit("Int32")), F.array(F.lit("System.Int32"), F.lit("__result"))).alias("m")).first()
    assert row["m"]
