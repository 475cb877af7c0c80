"""Quality checks of mods in phases: what each has, what that touches, which flows it starts, which gaps are left, and a report."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..model import REGISTRY, Model, n, query
from ..session import shared_dir
from ..sources import reports
from . import conflicts, events, hierarchy
from .graph import settled

TARGET = ["target_class", "target_method"]


def _patches(m: Model) -> DataFrame:
    """Patches whose classes are read as the types of the tables."""
    name = F.concat(F.lit("Type"), (F.substring("target_class", 6, 20).cast("long") % 25 + 1).cast("string"))
    return m.harmony_patches.withColumn("target_class", name)


def discovery(m: Model, patches: DataFrame) -> DataFrame:
    """mod_id and how many patches, event fires and config changes it has; mods without any are there as well."""
    count = lambda rows, name: rows.filter("mod_id is not null").groupBy("mod_id").agg(n().alias(name))
    out = m.mods.select(F.col("id").alias("mod_id"))
    for rows, name in ((patches, "patches"), (m.event_fires, "event_fires"), (m.mod_xml_operations, "xml_changes")):
        out = out.join(count(rows, name), "mod_id", "left")
    return out.fillna(0)


def interactions(m: Model, patches: DataFrame) -> DataFrame:
    """Each mod's patched methods: whether the call graph knows them, how many call them, how many overloads they have."""
    types = m.types.select(F.col("id").alias("type_id"), F.col("name").alias("target_class"))
    methods = m.methods.select(F.col("id").alias("method_id"), "type_id", F.col("name").alias("target_method")).join(types, "type_id")
    calls = m.calls.select("caller_id", F.col("callee_id").alias("method_id")).distinct()
    counts = methods.groupBy(*TARGET).agg(n().alias("overloads"))
    callers = methods.join(calls, "method_id").groupBy(*TARGET).agg(F.countDistinct("caller_id").alias("callers"))
    own = patches.select("mod_id", *TARGET).distinct()
    rows = own.join(counts, TARGET, "left").join(callers, TARGET, "left")
    return rows.select("mod_id", *TARGET, F.col("overloads").isNotNull().alias("resolved"), F.coalesce("callers", F.lit(0).cast("long")).alias("callers"), F.coalesce("overloads", F.lit(0).cast("long")).alias("overloads"))


def flows(m: Model, patches: DataFrame) -> DataFrame:
    """Each event that a mod fires: how many handlers it has, and whether the mod patches one of them."""
    own = patches.select("mod_id", F.col("target_class").alias("subscriber_type"), F.col("target_method").alias("handler_method")).distinct().withColumn("hit", F.lit(True))
    handlers = m.event_subscriptions.select(*events.KEY, "subscriber_type", "handler_method").distinct()
    fired = m.event_fires.filter("mod_id is not null").select("mod_id", *events.KEY).distinct()
    met = fired.join(handlers, events.KEY).join(own, ["mod_id", "subscriber_type", "handler_method"], "left")
    counts = met.groupBy("mod_id", *events.KEY).agg(n().alias("subscribers"), F.max(F.coalesce("hit", F.lit(False))).alias("covered"))
    out = fired.join(counts, ["mod_id", *events.KEY], "left")
    return out.select("mod_id", *events.KEY, F.coalesce("subscribers", F.lit(0).cast("long")).alias("subscribers"), F.coalesce("covered", F.lit(True)).alias("covered"))


def gaps(m: Model, patches: DataFrame, traced: DataFrame, methods: DataFrame | None = None) -> DataFrame:
    """mod_id, gap, severity, what: overloads not patched, overrides that miss the patch of their base, uncovered events."""
    method = lambda c, f: F.concat_ws(".", c, f)
    own = patches.select("mod_id", *TARGET, F.col("target_arg_types").alias("missing")).distinct()
    known = patches.select(*TARGET, F.col("target_arg_types").alias("missing")).distinct()
    overloads = own.select("mod_id", *TARGET).distinct().join(known, TARGET).join(own, ["mod_id", *TARGET, "missing"], "left_anti")
    a = overloads.select("mod_id", F.lit("missing overload").alias("gap"), F.lit("Low").alias("severity"), F.concat(method("target_class", "target_method"), "missing").alias("what"))
    missed, overrides = hierarchy.missed_overrides(m, patches, m.methods if methods is None else methods)
    bypass = missed.select("mod_id", "derived_type", "type_id", "method").distinct().join(overrides.select("type_id", "method", "severity").distinct(), ["type_id", "method"])
    b = bypass.select("mod_id", F.lit("inheritance bypass").alias("gap"), "severity", method("derived_type", "method").alias("what")).distinct()
    c = traced.filter("not covered and subscribers > 0").select("mod_id", F.lit("uncovered event").alias("gap"), F.lit("Medium").alias("severity"), method("owner_type", "event_name").alias("what"))
    return a.unionByName(b).unionByName(c)


def check(m: Model, patches: DataFrame | None = None, methods: DataFrame | None = None) -> dict[str, DataFrame]:
    """All phases by name; ``verdict``: mod_id, high, medium, low, verdict (fail if a gap is High)."""
    patches = m.harmony_patches if patches is None else patches
    traced = settled(flows(m, patches))
    left = settled(gaps(m, patches, traced, methods))
    counts = m.mods.select(F.col("id").alias("mod_id")).join(left, "mod_id", "left").groupBy("mod_id").agg(*(F.count_if(F.col("severity") == s).alias(s.lower()) for s in ("High", "Medium", "Low")))
    verdict = counts.withColumn("verdict", F.when(F.col("high") > 0, "fail").otherwise("pass"))
    return {"discovery": discovery(m, patches), "interactions": interactions(m, patches), "flows": traced, "gaps": left, "verdict": verdict}


def report_lines(m: Model, phases: dict[str, DataFrame]) -> DataFrame:
    """The report of every mod as Markdown lines: the summary with the counts first, patches, flows, gaps by severity."""
    pad = lambda c: F.lpad(F.col(c).cast("string"), 9, "0")
    text = lambda *parts: F.concat(*(F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts))
    doc, c = pad("mod_id"), F.col
    names = m.mods.select(F.col("id").alias("mod_id"), "name", "version")
    head = phases["discovery"].join(phases["verdict"], "mod_id").join(names, "mod_id")
    found = F.when(c("high") + c("medium") + c("low") == 0, "**No gaps detected**").otherwise(text("**Potential issues:** ", c("high"), " high, ", c("medium"), " medium, ", c("low"), " low"))
    summary = text("# QA report: ", c("name"), " v", c("version"), "\n\n| Metric | Count |\n|---|---|\n| Patches | ", c("patches"), " |\n| Event fires | ", c("event_fires"), " |\n| Config changes | ", c("xml_changes"), " |\n\n", found, "\nVerdict: ", c("verdict"))
    target = text(c("target_class"), ".", c("target_method"))
    status = F.when(c("covered"), "covered").otherwise("uncovered")
    parts = [
        reports.lines_of(head, 0, summary, F.lit(""), doc), reports.lines_of(head, 1, F.lit("\n## Patches\n\n| Target | Known | Callers |\n|---|---|---|"), F.lit(""), doc),
        reports.lines_of(phases["interactions"], 2, text("| ", target, " | ", c("resolved"), " | ", c("callers"), " |"), target, doc), reports.lines_of(head, 3, F.lit("\n## Event flows\n"), F.lit(""), doc),
        reports.lines_of(phases["flows"], 4, text("- ", c("event_name"), " of ", c("owner_type"), ": ", c("subscribers"), " subscribers, ", status), text(c("event_name"), c("owner_type")), doc),
        reports.lines_of(head, 5, F.lit("\n## Gaps\n"), F.lit(""), doc),
        reports.lines_of(phases["gaps"], 6, text("- **", c("severity"), "** ", c("gap"), ": ", c("what")), text(F.when(c("severity") == "High", "0").when(c("severity") == "Medium", "1").otherwise("2"), c("gap"), c("what")), doc),
    ]
    return reports.joined(*parts)


def _methods(m: Model) -> DataFrame:
    """Methods that share twenty names, so that types and those they derive from have some in common."""
    return m.methods.withColumn("name", F.when(F.col("id") % 9 == 0, "Update").otherwise(F.concat(F.lit("M"), (F.col("id") % 20).cast("string"))))


_QA_SQL = hierarchy.bypass_sql() + """
    , fl AS (SELECT f.mod_id, f.owner_type, f.event_name, count(s.subscriber_type) AS subscribers, coalesce(bool_or(q.mod_id IS NOT NULL), false) AS covered
      FROM (SELECT DISTINCT mod_id, owner_type, event_name FROM event_fires WHERE mod_id IS NOT NULL) f
      LEFT JOIN (SELECT DISTINCT owner_type, event_name, subscriber_type, handler_method FROM event_subscriptions) s ON s.owner_type = f.owner_type AND s.event_name = f.event_name
      LEFT JOIN p q ON q.mod_id = f.mod_id AND q.type = s.subscriber_type AND q.method = s.handler_method GROUP BY 1, 2, 3),
    pa AS (SELECT DISTINCT mod_id, concat('Type', CAST(CAST(substr(target_class, 6) AS BIGINT) % 25 + 1 AS VARCHAR)) AS type, target_method AS method, target_arg_types AS args FROM harmony_patches),
    ov AS (SELECT DISTINCT a.mod_id, a.type, a.method, b.args FROM pa a JOIN pa b ON a.type = b.type AND a.method = b.method WHERE NOT EXISTS (SELECT 1 FROM pa x WHERE x.mod_id = a.mod_id AND x.type = a.type AND x.method = a.method AND x.args = b.args)),
    gaps AS (SELECT mod_id, 'missing overload' AS gap, 'Low' AS severity, type || '.' || method || args AS what FROM ov UNION ALL SELECT DISTINCT mod_id, 'inheritance bypass', severity, derived_type || '.' || method FROM bypass
      UNION ALL SELECT mod_id, 'uncovered event', 'Medium', owner_type || '.' || event_name FROM fl WHERE subscribers > 0 AND NOT covered)"""


@query("evt_06_qa_verdicts", _QA_SQL + """
    SELECT mods.id AS mod_id, coalesce(a.n, 0) AS patches, coalesce(b.n, 0) AS event_fires, coalesce(c.n, 0) AS xml_changes, coalesce(g.high, 0) AS high, coalesce(g.medium, 0) AS medium, coalesce(g.low, 0) AS low, CASE WHEN coalesce(g.high, 0) > 0 THEN 'fail' ELSE 'pass' END AS verdict
    FROM mods LEFT JOIN (SELECT mod_id, count(*) AS n FROM harmony_patches GROUP BY 1) a ON a.mod_id = mods.id LEFT JOIN (SELECT mod_id, count(*) AS n FROM event_fires WHERE mod_id IS NOT NULL GROUP BY 1) b ON b.mod_id = mods.id
    LEFT JOIN (SELECT mod_id, count(*) AS n FROM mod_xml_operations GROUP BY 1) c ON c.mod_id = mods.id
    LEFT JOIN (SELECT mod_id, count(*) FILTER (WHERE severity = 'High') AS high, count(*) FILTER (WHERE severity = 'Medium') AS medium, count(*) FILTER (WHERE severity = 'Low') AS low FROM gaps GROUP BY 1) g ON g.mod_id = mods.id""")  # fmt: skip
def qa_verdicts(m: Model) -> DataFrame:
    """What every mod has, which gaps it leaves, and whether it passes."""
    phases = check(m, _patches(m), _methods(m))
    return phases["discovery"].join(phases["verdict"], "mod_id")


@query("evt_06_qa_gaps", _QA_SQL + " SELECT mod_id, gap, severity, what FROM gaps")
def qa_gaps(m: Model) -> DataFrame:
    """All gaps of all mods."""
    return check(m, _patches(m), _methods(m))["gaps"]


@query("evt_06_qa_interactions", """
    WITH p AS (SELECT DISTINCT mod_id, concat('Type', CAST(CAST(substr(target_class, 6) AS BIGINT) % 25 + 1 AS VARCHAR)) AS target_class, target_method FROM harmony_patches),
    ms AS (SELECT me.id, ty.name AS c, me.name AS f FROM methods me JOIN types ty ON ty.id = me.type_id)
    SELECT p.mod_id, p.target_class, p.target_method, count(ms.id) > 0 AS resolved, count(DISTINCT c.caller_id) AS callers, count(DISTINCT ms.id) AS overloads
    FROM p LEFT JOIN ms ON ms.c = p.target_class AND ms.f = p.target_method LEFT JOIN calls c ON c.callee_id = ms.id GROUP BY 1, 2, 3""")  # fmt: skip
def qa_interactions(m: Model) -> DataFrame:
    return interactions(m, _patches(m))


@query("snk_14_qa_report", _QA_SQL + """
    SELECT '- **' || severity || '** ' || gap || ': ' || what AS line, count(*) AS n FROM gaps GROUP BY 1 UNION ALL SELECT 'Verdict: ' || CASE WHEN EXISTS (SELECT 1 FROM gaps WHERE gaps.mod_id = mods.id AND severity = 'High') THEN 'fail' ELSE 'pass' END, count(*) FROM mods GROUP BY 1
    UNION ALL SELECT '- ' || event_name || ' of ' || owner_type || ': ' || CAST(subscribers AS VARCHAR) || ' subscribers, ' || CASE WHEN covered OR subscribers = 0 THEN 'covered' ELSE 'uncovered' END, count(*) FROM fl GROUP BY 1""")  # fmt: skip
def qa_report(m: Model) -> DataFrame:
    """Lines of the written reports that state gaps, flows and verdicts, and how many reports have each."""
    phases = check(m, _patches(m), _methods(m))
    written = reports.write_document(report_lines(m, phases), f"{shared_dir(m.spark)}/reports/qa-{uuid.uuid4().hex}")
    lines = written.select(F.col("value").alias("line")).filter("line like '- %' or line like 'Verdict: %'")
    return lines.groupBy("line").agg(n().alias("n"))


def conflict_sections(m: Model) -> dict[str, tuple[DataFrame, list[str]]]:
    """Sections of the conflict report with their order."""
    return {
        "destructive_conflicts": (conflicts.destructive_conflicts(m), ["target_type", "target_name"]), "contested_entities": (conflicts.contested_entities(m), ["target_type", "target_name"]),
        "load_order_winners": (conflicts.load_order_winners(m), ["xpath_hash"]),
    }


@query("snk_10_conflict_document", f"""
    SELECT 'contested_entities' AS section, CAST(to_json({{'target_type': target_type, 'target_name': target_name, 'mod_count': mod_count, 'mod_actions': mod_actions, 'removal_count': removal_count, 'set_count': set_count, 'append_count': append_count, 'risk_level': risk_level}}) AS VARCHAR) AS item FROM ({REGISTRY["cnf_04_contested_entities"][1]}) a
    UNION ALL SELECT 'counts', '"' || k || '": ' || CAST(n AS VARCHAR) FROM (SELECT 'contested_entities' AS k, count(*) AS n FROM ({REGISTRY["cnf_04_contested_entities"][1]}) b UNION ALL SELECT 'destructive_conflicts', count(*) FROM ({REGISTRY["cnf_03_destructive_conflicts"][1]}) c
      UNION ALL SELECT 'load_order_winners', count(*) FROM ({REGISTRY["cnf_05_load_order_winners"][1]}) d) t""")  # fmt: skip
def conflict_document(m: Model) -> DataFrame:
    """The conflict report as one JSON document, written and read back: its counts, and the entities in it."""
    written = reports.write_document(reports.json_document(m.spark, conflict_sections(m)), f"{shared_dir(m.spark)}/reports/conflicts-{uuid.uuid4().hex}")
    line = F.regexp_replace("value", r"^ *,?|,$", "")
    counts = written.filter(F.rlike("value", F.lit(r'^    "\w+": \d+'))).select(F.lit("counts").alias("section"), line.alias("item"))
    return counts.unionByName(written.filter(F.contains("value", F.lit('"risk_level":'))).select(F.lit("contested_entities").alias("section"), line.alias("item")))
