"""What is kept on disk and changed in steps, and what SQL does not reach: odd input, scans, replays."""

import json
import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from strataweave.api import Engine
from strataweave.functions import xpath as xp
from strataweave.functions import xpath_grammar as xg
from strataweave.model import Model
from strataweave.operators import chains, enrichment, hierarchy, qa, rebuilds, relevance
from strataweave.operators.text_index import TextIndex
from strataweave.sources import reports, xml_config
from strataweave.streaming.file_tables import FileTables

BODIES = "method_id long, body string, extra string"


def ids(df):
    return sorted(r["method_id"] for r in df.collect())


def test_index_reads_only_its_terms_and_takes_in_changes(spark, tmp_path):
    index = TextIndex(spark, str(tmp_path), buckets=8)
    assert index.search("gun").count() == 0 and index.rank(["gun"]).count() == 0
    rows = [(1, "The guns of a gunner", ""), (2, "a gun, and bread", ""), (3, None, ""), (4, "", ""), (None, "gun", ""), (5, "bread and butter: a gun", ""), (5, "zzz", "")]
    first = {r["action"]: r["n"] for r in index.refresh(spark.createDataFrame(rows, BODIES)).collect()}
    assert first == {"added": 5}
    kept = 5 if min(rows[5][1], "zzz", key=lambda t: __import__("hashlib").sha256(t.encode()).hexdigest()) == rows[5][1] else None
    assert ids(index.search("gun")) == [x for x in (1, 2, kept) if x] and ids(index.search("gun", stemmed=False)) == [x for x in (2, kept) if x]
    assert ids(index.search('"a gunner"', stemmed=False)) == [1] and ids(index.search('gun* NOT bread', stemmed=False)) == [1] and ids(index.search("butte* OR gunner")) == [x for x in (1, kept) if x]
    assert index.search("nothing").count() == 0 and index.search("NOT gun").count() == 0 and index.search("").count() == 0
    held = index.postings(["gun"])
    plan = held._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters" in plan and len({r[0].split("bucket=")[1].split("/")[0] for r in held.select(F.input_file_name()).distinct().collect()}) == 1
    version = index.state()["version"]
    assert {r["action"] for r in index.refresh(spark.createDataFrame(rows, BODIES)).collect()} == {"unchanged"} and index.state()["version"] == version
    later = [(1, "The guns of a gunner", ""), (2, "now of bread alone", ""), (6, "six guns", "")]
    got = {r["action"]: r["n"] for r in index.refresh(spark.createDataFrame(later, BODIES)).collect()}
    assert got == {"unchanged": 1, "changed": 1, "added": 1, "removed": 3}
    assert ids(index.search("gun")) == [1, 6] and index.state()["stale"]
    before = dict(map(tuple, index.rank(["gun", "bread"]).collect()))
    index.compact()
    assert ids(index.search("gun")) == [1, 6] and not index.state()["stale"] and dict(map(tuple, index.rank(["gun", "bread"]).collect())) == pytest.approx(before)
    assert TextIndex(spark, str(tmp_path), buckets=8).state()["docs"] == 3
    index.refresh(spark.createDataFrame([], BODIES))
    assert index.search("gun").count() == 0 and index.live().count() == 0


def test_a_very_long_body_is_indexed_in_little_memory(spark, tmp_path):
    index = TextIndex(spark, str(tmp_path))
    index.refresh(spark.range(3).select(F.col("id").alias("method_id"), F.repeat(F.concat(F.lit("word w"), F.col("id").cast("string"), F.lit(" ")), 50_000).alias("body")))
    assert {r["tf"] for r in index.postings(["word"]).collect()} == {50_000} and index.search('"word w1 word"').count() == 1


def brute_chains(edges, source, target, depth, limit):
    out, open_ = [], [(source,)]
    while open_:
        path = open_.pop()
        for v in edges[path[-1]]:
            if v not in path and len(path) <= depth:
                (out if v == target else open_).append((*path, v))
    return sorted((len(p) - 1, ">".join(map(str, p))) for p in out)[:limit]


def test_chains_equal_search(spark):
    rng = random.Random(5)
    calls = [(rng.randrange(30), rng.randrange(30)) for _ in range(70)] + [(None, 1), (1, None), (3, 3), (4, 5), (4, 5)] + [(100 + i, 101 + i) for i in range(12)]
    pairs = [(rng.randrange(30), rng.randrange(30)) for _ in range(25)] + [(7, 7), (None, 1), (100, 110), (100, 111), (1, 100)]
    edges = defaultdict(set)
    for u, v in calls:
        if u is not None and v is not None and u != v:
            edges[u].add(v)
    got = defaultdict(list)
    frame = chains.shortest_chains(spark.createDataFrame(calls, "caller_id long, callee_id long"), spark.createDataFrame(pairs, "source long, target long"))
    for r in frame.orderBy("source", "target", "rank").collect():
        got[r["source"], r["target"]].append((r["depth"], r["path"]))
    want = {p: found for p in set(pairs) if None not in p and p[0] != p[1] and (found := brute_chains(edges, *p, 10, 5))}
    assert dict(got) == want and (100, 110) in want and (100, 111) not in want


def test_intervals_of_a_forest(spark):
    rows = [(1, "A", None), (2, "B", "A"), (3, "C", "B"), (4, "D", "A"), (5, "E", "Missing"), (6, "F", "G"), (7, "G", "F"), (8, "H", "G"), (9, "I", "I"), (10, "J", "I"), (11, "A", "E"), (12, "Ü", "C")]
    types = spark.createDataFrame(rows, "id long, name string, base_type string")
    got = {r["id"]: r for r in hierarchy.intervals(types).collect()}
    assert {k: r["path"] for k, r in got.items()} == {1: [1], 2: [1, 2], 3: [1, 2, 3], 4: [1, 4], 5: [5], 11: [5, 11], 12: [1, 2, 3, 12]}
    assert sorted(r["first"] for r in got.values()) == list(range(1, 8))
    for a in got.values():
        assert {k for k, r in got.items() if a["first"] <= r["first"] <= a["last"]} == {k for k, r in got.items() if a["id"] in r["path"]}
    assert {(r["name"], r["depth"]) for r in hierarchy.derived_types(types, "A").collect()} == {("B", 1), ("C", 2), ("D", 1), ("Ü", 3)}
    deep = spark.range(1, 101).selectExpr("id", "concat('T', id) as name", "if(id > 1, concat('T', id - 1), null) as base_type")
    assert hierarchy.intervals(deep).agg(F.max("depth")).first()[0] == 99 and hierarchy.intervals(types.limit(0)).count() == 0


def rows_of(tables):
    rows = tables.rows()
    return sorted((r["path"], r["kind"], r["line_number"], r["name"] or r["property_name"] or "") for r in rows.collect())


def test_file_tables_by_batches(spark, tmp_path):
    doc = lambda *names: "<items>" + "".join(f'<item name="{n}"/>' for n in names) + "</items>"
    files = lambda *rows: spark.createDataFrame(rows, "path string, content string, deleted boolean, seq long")
    t = FileTables(spark, str(tmp_path / "t"))
    assert t.rows().count() == 0
    acts = lambda b, f, **k: sorted((r["path"], r["action"]) for r in t.apply(b, f, **k).collect())
    assert acts(0, files(("A.xml", doc("a"), None, 1), ("a.xml", doc("a2"), None, 2), ("b.xml", doc("b", "c"), None, 1), ("c.xml", None, None, 1), (None, doc("x"), None, 1))) == [("a.xml", "added"), ("b.xml", "added"), ("c.xml", "added")]
    assert [n for *_, n in rows_of(t) if n] == ["a2", "b", "c"]
    assert acts(1, files(("B.xml", doc("b", "d"), None, 1), ("c.xml", None, True, 1), ("gone.xml", None, True, 1), ("a.xml", doc("a2"), None, 1))) == [("B.xml", "changed"), ("a.xml", "unchanged"), ("c.xml", "removed")]
    full = xml_config.config_rows(files(("a.xml", doc("a2"), None, 1), ("B.xml", doc("b", "d"), None, 1)))
    assert rows_of(t) == sorted((r["path"], r["kind"], r["line_number"], r["name"] or r["property_name"] or "") for r in full.collect())
    assert t.apply(1, files(("z.xml", doc("z"), None, 1))) is None and t.apply(0, files(("z.xml", doc("z"), None, 1))) is None
    # A try that died before its commit leaves rows that nobody reads, and is written over.
    t.parse(files(("a.xml", doc("half"), None, 1)).select("path", "content")).write.parquet(str(tmp_path / "t" / "rows" / "batch=2"))
    assert [n for *_, n in rows_of(t) if n] == ["b", "d", "a2"]
    assert acts(2, files(("n.xml", doc("n"), None, 1)), whole=True) == [("B.xml", "removed"), ("a.xml", "removed"), ("n.xml", "added")]
    assert [n for *_, n in rows_of(t) if n] == ["n"]
    source = tmp_path / "in"
    source.mkdir()
    s = FileTables(spark, str(tmp_path / "s"))
    (source / "1.json").write_text(json.dumps({"path": "a.xml", "content": doc("a")}) + "\n" + json.dumps({"path": "b.xml", "content": doc("b")}))
    s.follow(str(source), str(tmp_path / "ck")).awaitTermination()
    (source / "2.json").write_text(json.dumps({"path": "a.xml", "deleted": True}))
    s.follow(str(source), str(tmp_path / "ck")).awaitTermination()
    assert [n for *_, n in rows_of(s) if n] == ["b"]


def test_cache_puts_gets_and_forgets(spark, tmp_path):
    cache = rebuilds.EnrichmentCache(spark, str(tmp_path))
    rows = lambda *xs: spark.createDataFrame(xs, "id long, key string, json string")
    assert cache.all().count() == 0
    cache.put(rows((1, "k", "a"), (2, "k", "b")))
    cache.put(rows((2, "k2", "c"), (3, "k", "d")))
    assert sorted(map(tuple, cache.get(spark.createDataFrame([(2,), (2,), (9,)], "id long")).collect())) == [(2, "k2", "c")]
    assert sorted(r["id"] for r in cache.all().collect()) == [1, 2, 3]
    cache.put(rows(), keep=spark.createDataFrame([(3,)], "id long"))
    assert [r["id"] for r in cache.all().collect()] == [3]


VALID = ["/", "/a", "//a", "a", ".", "..", "@a", "a/@*", "*", "a:b/c:*", "a[1]", "a[b='x' and not(c)]", "-1", "--a", "a - b", "a-b", "1.5 + .5", "'x'", "id('a')/b", "$v/x", "(a|b)[2]", "a | /b", "child::a/following-sibling::*[last()]",
         "text()", "a/node()", "processing-instruction('x')", "and", "or/and", "a and and", "* * *", "div div div", "f(a, 'b')/c", "p:f()", "count(//a) > 3 or true()", "string-length() = 1", "a[@b][c]", "self::node()/..", "concat('a', 'b', 'c')",
         "/ = 'x'", "a[position() mod 2 = 1]", "substring('abc', 1)"]
BROKEN = [(None, 1), ("", 1), ("  ", 1), ("a[", 3), ("a]", 2), ("a//", 4), ("///a", 3), ("a/", 3), ("a[]", 3), ("@", 2), ("a@b", 2), ("a b", 3), ("(a", 3), ("a)", 2), ("f(a", 4), ("f(a,)", 5), ("f(,a)", 3), ("last(1)", 7), ("contains('a')", 13),
          ("concat('a')", 11), ("'a", 1), ("a[1", 4), ("=a", 1), ("a=", 3), ("a==b", 3), ("foo::a", 1), ("a::b", 1), (".[1]", 2), ("1[a]", 2), ("'x'/a", 4), ("true() | a", 8), ("a |", 4), ("a and", 6), ("#", 1), ("a[b)]", 4), ("/a/(b)", 4), ("text(a)", None), ("..a", 3)]


def test_paths_by_the_grammar(spark):
    cases = [(p, 0) for p in VALID] + [c for c in BROKEN if c[1] is not None]
    rows = spark.createDataFrame(list(enumerate(p for p, _ in cases)), "i int, p string").select("i", "p", xg.fault(F.col("p")).alias("at"), xg.is_valid(F.col("p")).alias("ok")).orderBy("i").collect()
    assert [(r["p"], r["at"]) for r in rows] == cases and [r["ok"] for r in rows] == [at == 0 for _, at in cases]


def test_targets_of_odd_paths(spark):
    paths = ["/items/item[@name='a']/x[@name='b']", "/x/items/item[@name='a']", "/items/item[@name='a' and @b='c']", "/items/item[@name='']", None, "", "/lootcontainers/lootcontainer[@id='3']", "/quests/quest[@id='q']/action[@type='t']", "item[@name='a']", "/items/item[@name='a']x"]
    rows = spark.createDataFrame([(i, p) for i, p in enumerate(paths)], "i int, p string").select("i", xp.change_target(F.col("p")).alias("c"), xp.normalised_target(F.col("p")).alias("n")).orderBy("i").collect()
    assert [(r["c"]["type"], r["c"]["name"]) if r["c"] else None for r in rows] == [("item", "a"), ("item", "a"), None, None, None, None, ("loot_container", "[id='3']"), ("quest", "q"), None, None]
    assert [(r["n"]["type"], r["n"]["name"]) for r in rows] == [("item", "a"), ("item", "a"), (None, None), (None, None), (None, None), (None, None), ("lootcontainer", "3"), ("quest", "q"), (None, None), ("item", "a")]


def test_reports_are_whole_documents(spark, sf_dir, tmp_path):
    m = Model(spark, sf_dir)
    sections = qa.conflict_sections(m)
    sections["none"] = (sections["contested_entities"][0].limit(0), ["target_name"])
    reports.write_document(reports.json_document(spark, sections), str(tmp_path / "c"))
    text = "\n".join(p.read_text().rstrip("\n") for p in sorted((tmp_path / "c").glob("part-*")) if p.stat().st_size)
    doc = json.loads(text)
    assert doc["counts"] == {k: len(doc[k]) for k in sections} and doc["none"] == [] and doc["counts"]["contested_entities"] == sections["contested_entities"][0].count()
    assert doc["contested_entities"] == sorted(doc["contested_entities"], key=lambda r: (r["target_type"], r["target_name"]))
    e = Engine(spark, sf_dir)
    passed = e.qa_report(str(tmp_path / "q"))
    lines = "\n".join(p.read_text().rstrip("\n") for p in sorted((tmp_path / "q").glob("part-*")) if p.stat().st_size).split("\n")
    heads = [x for x in lines if x.startswith("# QA report")]
    assert len(heads) == m.mods.count() and passed == all("fail" not in x for x in lines if x.startswith("Verdict"))
    assert lines.index(heads[0]) < lines.index("## Patches") < lines.index("## Event flows") < lines.index("## Gaps") < lines.index(heads[1])


def test_enrichment_of_odd_findings(spark, sf_dir):
    m = Model(spark, sf_dir)
    name = m.xml_definitions.filter("definition_type = 'item'").orderBy("id").first()["name"]
    rows = [
        (1, "hardcoded_entity", "Type1", "M0", "a.cs", 3, f'ItemClass.GetItem("{name.upper()}")', None), (2, "hardcoded_entity", None, None, None, None, f'x.AddBuff("{name}q")', None), (3, "todo", "No", "Such", "b.cs", 1, None, None),
        (4, None, "", "", "", 1, None, '{"entity_name": "zzz", "entity_type": "quest"}'), (5, "hookable_event", "Type1", "Start", "a.cs", 5, None, "broken {"),
    ]
    findings = spark.createDataFrame(rows, "id long, analysis_type string, class_name string, method_name string, file_path string, line_number long, code_snippet string, related_entities string")
    sources = spark.createDataFrame([("a.cs", "class A\n{\n    public int F()\n    {\n        return 1;\n    }\n}"), ("b.cs", None)], "file_path string, content string")
    got = {r["id"]: r for r in enrichment.enrichment_json(m, findings=findings, sources=sources).collect()}
    assert set(got) == {1, 2, 3, 4, 5}
    assert got[1]["xml_status"] == "found" and got[1]["fuzzy_matches"] is None and got[2]["xml_status"] == "code_only" and json.loads(got[2]["fuzzy_matches"])[0]["name"] == name
    assert json.loads(got[1]["source_context"])["method_end_line"] == 6 and got[3]["source_context"] is None and got[2]["usage_level"] is None and got[3]["usage_level"] == "unused"
    assert json.loads(got[5]["dead_code_analysis"])["confidence"] == 0.1 and json.loads(got[4]["semantic_context"])["category"] == "Code Pattern" and got[4]["entity_name"] == "zzz"
    assert json.loads(got[5]["semantic_context"])["moddability_level"] == "safe_to_extend"


def test_keywords_of_a_large_table_are_joined(spark, sf_dir, monkeypatch):
    m = Model(spark, sf_dir)
    small = sorted(map(tuple, relevance.tuned_scores(m).collect()))
    monkeypatch.setattr(relevance, "MOST_KEYWORDS", 3)
    assert sorted(map(tuple, relevance.tuned_scores(m).collect())) == small
