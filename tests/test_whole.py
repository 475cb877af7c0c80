"""Queries whose whole results are held against searches and sums in Python."""

import re
import sqlite3

import pytest
from pyspark.sql import functions as F

from strataweave.api import Engine
from strataweave.model import REGISTRY, Model
from strataweave.operators import indirect, patches, relevance, search, text

STEPS = 12


def chain_of(spark, steps):
    """Item 1 is extended by 2, 2 by 3 and so on; two mods set a property of each."""
    defs = [(i, "item", f"i{i}", f"i{i - 1}" if i > 1 else None) for i in range(1, steps + 1)]
    refs = spark.createDataFrame([], "id long, source_def_id long, target_type string, target_name string, reference_context string")
    ops = [(i * 2 + k, k + 1, "set", "item", f"i{i}", "p", str(k)) for i in range(1, steps + 1) for k in (0, 1)]
    return Model(spark, tables={
        "xml_definitions": spark.createDataFrame(defs, "id long, definition_type string, name string, extends string"), "xml_references": refs,
        "mods": spark.createDataFrame([(1, "A"), (2, "B")], "id long, name string"),
        "mod_xml_operations": spark.createDataFrame(ops, "id long, mod_id long, operation string, target_type string, target_name string, property_name string, new_value string"),
    })


@pytest.fixture(scope="module")
def chain(spark):
    return chain_of(spark, STEPS)


def reached(edges, depth=10):
    """source, target, depth by breadth-first search."""
    out = set()
    for start in {s for s, _ in edges}:
        seen, front = {start}, {start}
        for d in range(1, depth + 1):
            front = {t for s, t in edges if s in front} - seen
            seen |= front
            out |= {(start, t, d) for t in front}
    return out


def test_closure_goes_ten_steps(chain):
    want = reached([(i, i - 1) for i in range(2, STEPS + 1)])
    assert {tuple(r) for r in REGISTRY["grf_04_transitive_closure"][0](chain).select("source", "target", "depth").collect()} == want
    run = lambda name: REGISTRY[name][0](chain).collect()
    assert {(r["side"], r["entity_id"], r["depth"]) for r in run("grf_05_impact_analysis")} == {("dependent", i, i - 1) for i in range(2, 12)}
    assert {r["base_entity"]: r["dependent_count"] for r in run("grf_06_inheritance_hotspots")}["i1"] == 10
    assert {r["base_entity"]: len(r["dependents"].split(",")) for r in run("grf_07_hotspots_with_dependents")}["i1"] == 10
    assert {r["id"]: r["max_depth"] for r in run("grf_08_dependency_stats")}[STEPS] == 10
    assert {(r["parent_entity"], r["child_entity"], r["depth"]) for r in run("cnf_16_h2_broken_inheritance")} == {(f"i{t}", f"i{s}", d) for s, t, d in want if d > 1}
    assert max(r["depth"] for r in run("cnf_22_m1_transitive_property_override")) == 10
    assert [(r["entity_id"], r["dependent_count"]) for r in run("cnf_24_m3_shared_parent")] == [(1, 10)]


def test_engine_goes_ten_steps(chain):
    e = Engine(chain.spark, tables=chain._tables)
    assert e.impact("item", "i1").agg({"depth": "max"}).first()[0] == 10


def test_closure_of_tables_equals_search(spark, sf_dir):
    m = Model(spark, sf_dir)
    edges = [(r["source"], r["target"]) for r in REGISTRY["grf_02_direct_edges"][0](m).collect()]
    assert {(r["source"], r["target"], r["depth"]) for r in REGISTRY["grf_04_transitive_closure"][0](m).collect()} == reached(edges)


def score_of(a, b):
    """The reference's score, by its rule."""
    x, y = a.lower(), b.lower()
    row = list(range(len(y) + 1))
    for i, c in enumerate(x, 1):
        row, old = [i], row
        for j, d in enumerate(y, 1):
            row.append(min(old[j] + 1, row[-1] + 1, old[j - 1] + (c != d)))
    best = 1 - row[-1] / max(len(x), len(y))
    if x in y or y in x:
        best = max(best, 0.8)
    same = next((i for i, (c, d) in enumerate(zip(x, y, strict=False)) if c != d), min(len(x), len(y)))
    if same >= 4:
        best = max(best, 0.7 + same * 0.02)
    s, t = ([w.lower() for w in re.findall("^[^A-Z]+|[A-Z][^A-Z]*", re.sub("[^A-Za-z0-9]", "", z))] for z in (a, b))
    return max(best, sum(any(u in v or v in u for v in t) for u in s) / max(len(s), len(t)))


def test_fuzzy_match_scores_all_pairs(spark):
    names = ["pistl", "pistol", "concreteBlock", "zzz", "gunPistolT1", "ab_cd"]
    known = ["pistol", "pistols", "bridgeConcreteBlock", "gunPistol", "pistolGrip", "meleeToolAxe", "abcd_9", "rifle"]
    got = text.fuzzy_match(spark.createDataFrame([(x,) for x in names], "name string"), spark.createDataFrame([(x, "item") for x in known], "known string, kind string"))
    rows = {(r["name"], r["known"]): r["score"] for r in got.collect()}
    want = {}
    for a in names:
        all_ = sorted(((-round(score_of(a, b), 2), b) for b in known if score_of(a, b) >= 0.4))
        want |= {(a, b): -s for s, b in all_[:5]}
    assert rows == pytest.approx(want)
    assert rows["pistl", "pistol"] == 0.83 and rows["pistol", "pistols"] >= 0.8


def test_pairs_in_blocks_are_all_pairs(spark):
    a, b = spark.range(57).selectExpr("concat('n', id) as name"), spark.range(31).selectExpr("concat('k', id) as known", "'item' as kind")
    for rows in (5, 20, 40, 1000):
        got = [(r["name"], r["known"]) for r in text._in_blocks(a, b, rows).collect()]
        assert len(got) == len(set(got)) == 57 * 31
    assert text._in_blocks(a.limit(0), b, 5).count() == 0 and text._in_blocks(a, b.limit(0), 5).count() == 0


def test_fuzzy_match_takes_full_names(spark, sf_dir):
    m = Model(spark, sf_dir)
    best = {r["name"]: r["score"] for r in REGISTRY["scl_17_fuzzy_match"][0](m).filter("rank = 1").collect()}
    assert min(best.values()) >= 1 and set(best) == {r["dependency_name"] for r in m.csharp_deps.select("dependency_name").collect()}


def test_summaries_take_all_patterns(spark):
    """H2, H3, M1 and M3 meet in the chain; of these only pairs of mods can be stored."""
    m = chain_of(spark, 3)
    summary = {r["severity"]: r["patterns_found"].split(",") for r in REGISTRY["cnf_30_conflict_summary"][0](m).collect()}
    assert summary == {"high": ["H2", "H3"], "medium": ["M1", "M3"]}
    kept = {r["pattern_id"]: r["n"] for r in REGISTRY["cnf_29_persistable_conflicts"][0](m).collect()}
    assert set(kept) == {"H2", "H3", "M1"} and kept["H3"] == 3
    rows = {(r["mod1_name"], r["mod2_name"]): r for r in REGISTRY["cnf_30_mod_interaction_matrix"][0](m).collect()}
    assert rows["A", "A"]["medium_count"] > 0 and rows["B", "A"]["high_count"] > 0
    assert indirect.persistable(m, indirect.indirect_conflicts(m).withColumn("entity_id", F.lit(-1).cast("long"))).isEmpty()


def test_sorts_keep_all_rows(spark):
    ids = spark.range(1, 701)
    m = Model(spark, tables={
        "xml_definitions": ids.selectExpr("id", "'item' as definition_type", "lpad(701 - id, 4, '0') as name"), "xml_references": ids.selectExpr("id % 7 + 1 as source_def_id"),
        "game_code_analysis": ids.selectExpr("id", "case when id % 2 = 0 then 'BUG' else 'INFO' end as severity"),
    })
    run = lambda name: [tuple(r) for r in REGISTRY[name][0](m).collect()]
    assert run("srt_01_multi_key_sort") == [("item", f"{i:04}") for i in range(1, 701)]
    assert run("srt_02_ranked_severities") == [(i, "BUG") for i in range(2, 701, 2)] + [(i, "INFO") for i in range(1, 701, 2)]
    assert run("srt_05_sort_by_subquery") == [(i, 100 if i <= 7 else 0) for i in range(1, 701)]


def test_dependencies_of_all_orders(spark, sf_dir):
    m = Model(spark, sf_dir)
    assert m.csharp_deps.count() == spark.read.parquet(f"{sf_dir}/orders.parquet").count()
    assert sum(r["n"] for r in REGISTRY["cnf_49_code_rollup"][0](m).collect() if r["section"] == "dependencies") == m.csharp_deps.count()


def test_index_holds_all_terms(spark):
    m = Model(spark, tables={"method_bodies": spark.createDataFrame([(1, "Guns and a gun, 7 zebras"), (2, "zebra"), (3, ""), (4, None)], "method_id long, body string")})
    rows = {(r["method_id"], r["term"]): (r["tf"], r["doc_length"]) for r in REGISTRY["flt_06_stemmed_postings"][0](m).collect()}
    assert rows == {(1, "gun"): (2, 6), (1, "and"): (1, 6), (1, "a"): (1, 6), (1, "7"): (1, 6), (1, "zebra"): (1, 6), (2, "zebra"): (1, 1)}


def test_scores_and_kinds_are_whole(spark, sf_dir):
    m = Model(spark, sf_dir)
    score = {r["id"]: r["total_score"] for r in relevance.relevance_scores(m).collect()}
    grave = {r["id"] for r in m.game_code_analysis.filter("severity = 'BUG'").collect()}
    assert {r["id"]: r["total_score"] for r in REGISTRY["inc_07_score_only_missing"][0](m).collect()} == {k: v for k, v in score.items() if k not in grave}
    rows = REGISTRY["cod_32_scored_findings"][0](m).collect()
    assert {r["id"]: r["score"] for r in rows} == score and [r["score"] for r in rows] == sorted(score.values(), reverse=True)
    counts = REGISTRY["cnf_38_harmony_conflicts"][0](m).collect()
    assert len({r["conflict_type"] for r in counts}) > 2 and sum(r["n"] for r in counts) == patches.harmony_conflicts(m).count()


def test_stems_are_porters(spark):
    c = sqlite3.connect(":memory:")
    try:
        c.execute("create virtual table t using fts5(x, tokenize='porter')")
    except sqlite3.OperationalError:
        pytest.skip("no full-text search in this sqlite")
    heads = ["rel", "hop", "gener", "adopt", "sens", "capa", "conn", "fil", "st", "tro", "happ", "fall", "x", "toy", "syzyg", "control", "oscill", "ed", "a"]
    tails = ["", "s", "es", "ies", "sses", "ed", "eed", "ing", "y", "ly", "ation", "ational", "tional", "izer", "ization", "bility", "ibly", "alism", "fulness", "ousness", "iveness", "icate", "ative", "alize", "ical", "ness",
             "ance", "ement", "ment", "ent", "sion", "tion", "ism", "ate", "ous", "ive", "ize", "e", "ee", "ll", "lled", "tting", "ology"]
    words = [h + t for h in heads for t in tails]
    c.execute("create virtual table v using fts5vocab(t, 'instance')")
    c.execute("insert into t values (?)", (" ".join(words),))
    want = [r[0] for r in c.execute("select term from v order by doc, offset")]
    got = [r[0] for r in spark.createDataFrame(list(enumerate(words)), "i int, w string").select("i", search.stem(F.col("w")).alias("s")).orderBy("i").select("s").collect()]
    assert [x for x in zip(words, got, want, strict=True) if x[1] != x[2]] == []
