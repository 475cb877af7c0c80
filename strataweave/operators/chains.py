"""Shortest simple call paths between many pairs of methods, met in the middle.

Walks of up to half the depth start from both ends; where they meet, a pair's distance is known, and pairs that don't meet are
done. The labels "steps left to the target" then go on backward, only through methods that a source of theirs reaches early enough.
Paths grow from the sources along labels: a step is taken only if the target can still be reached within the length looked for,
so nothing that misses the target is listed. First the shortest length: of the paths that reach a method in equally many steps
only the first ``limit`` by text can be among the best, since shortest walks never repeat a method. Pairs with fewer than ``limit``
paths are looked at again one step longer, and what is still short up to the full depth; there all simple paths along labels are
kept, for a repeated method may rule out any of them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..model import Model, n, query
from .graph import settled

DEPTH, LIMIT = 10, 5


def _walk(edges: DataFrame, starts: DataFrame, steps: int) -> DataFrame:
    """edges u -> v, starts (start) -> start, node, d: the least number of steps, up to ``steps``."""
    front = seen = settled(starts.select("start", F.col("start").alias("node"), F.lit(0).alias("d")))
    for d in range(1, steps + 1):
        more = front.join(edges, F.col("node") == F.col("u")).select("start", F.col("v").alias("node")).distinct()
        front = settled(more.join(seen, ["start", "node"], "left_anti").withColumn("d", F.lit(d)))
        if front.isEmpty():
            break
        seen = seen.unionByName(front)
    return seen


def _text(ids: str = "ids"):
    return F.array_join(F.col(ids).cast("array<string>"), ">")


def _grow(edges: DataFrame, pairs: DataFrame, left: DataFrame, limit: int, best_only: bool) -> DataFrame:
    """pairs (source, target, most) -> source, target, ids of simple paths of at most ``most`` steps."""
    front = settled(pairs.select("source", "target", "most", F.col("source").alias("node"), F.array("source").alias("ids")))
    found = None
    steps = front.agg(F.max("most")).first()[0] or 0
    labels = left.withColumnsRenamed({"start": "target", "node": "v", "d": "left"})
    for d in range(1, steps + 1):
        longer = front.join(edges, F.col("node") == F.col("u")).join(labels, ["target", "v"]).filter((F.col("left") + d <= F.col("most")) & ~F.array_contains("ids", F.col("v")))
        longer = longer.select("source", "target", "most", F.col("v").alias("node"), F.concat("ids", F.array("v")).alias("ids"))
        if best_only:
            order = Window.partitionBy("source", "target", "node").orderBy(_text())
            longer = longer.withColumn("k", F.row_number().over(order)).filter(F.col("k") <= limit).drop("k")
        held = settled(longer)
        done = held.filter("node = target").select("source", "target", "ids")
        found = done if found is None else found.unionByName(done)
        front = held.filter("node <> target")
        if front.isEmpty():
            break
    return found if found is not None else front.select("source", "target", "ids")


def shortest_chains(calls: DataFrame, pairs: DataFrame, depth: int = DEPTH, limit: int = LIMIT) -> DataFrame:
    """calls (caller_id, callee_id), pairs (source, target) -> source, target, rank, depth, path (ids joined by '>').

    A path has 1 to ``depth`` steps and repeats no method; the shortest come first, equally long ones by their text. A pair of a
    method with itself has none; repeated pairs and calls count once, nulls not at all.
    """
    edges = settled(calls.select(F.col("caller_id").alias("u"), F.col("callee_id").alias("v")).filter("u is not null and v is not null and u <> v").distinct())
    back = edges.select(F.col("v").alias("u"), F.col("u").alias("v"))
    pairs = settled(pairs.select("source", "target").filter("source is not null and target is not null and source <> target").distinct())
    half = depth // 2
    ahead = _walk(edges, pairs.select(F.col("source").alias("start")).distinct(), depth - half)
    behind = _walk(back, pairs.select(F.col("target").alias("start")).distinct(), half)
    one, two = ahead.withColumnsRenamed({"start": "source", "d": "x"}), behind.withColumnsRenamed({"start": "target", "d": "y"})
    met = settled(pairs.join(one, "source").join(two, ["target", "node"]).groupBy("source", "target").agg(F.min(F.col("x") + F.col("y")).alias("shortest")).filter(F.col("shortest") <= depth))

    # Labels beyond the half, through methods that some source of the target reaches in time.
    early = settled(met.select("source", F.col("target").alias("start")).join(one, "source").groupBy("start", "node").agg(F.min("x").alias("x")))
    left = front = behind.filter(F.col("d") <= half)
    front = front.filter(F.col("d") == half)
    for d in range(half + 1, depth + 1):
        more = front.join(back, F.col("node") == F.col("u")).select("start", F.col("v").alias("node")).distinct()
        more = more.join(early.filter(F.col("x") <= depth - d).select("start", "node"), ["start", "node"], "left_semi")
        front = settled(more.join(left, ["start", "node"], "left_anti").withColumn("d", F.lit(d)))
        if front.isEmpty():
            break
        left = left.unionByName(front)
    left = settled(left)

    shortest = settled(_grow(edges, met.withColumn("most", F.col("shortest")), left, limit, True))
    got = shortest
    for longer in (1, depth):
        full = got.groupBy("source", "target").agg(n().alias("n")).filter(F.col("n") >= limit)
        again = settled(met.join(full, ["source", "target"], "left_anti").filter(F.col("shortest") < depth).select("source", "target", F.least(F.col("shortest") + longer, F.lit(depth)).alias("most")))
        if again.isEmpty():
            break
        more = _grow(edges, again, left, limit, False)
        got = settled(got.join(again, ["source", "target"], "left_anti").unionByName(more))
    steps = (F.size("ids") - 1).alias("depth")
    order = Window.partitionBy("source", "target").orderBy("depth", "path")
    out = got.select("source", "target", steps, _text().alias("path")).withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= limit)
    return out.select("source", "target", "rank", "depth", "path")


@query("grf_01_shortest_chains", """
    WITH RECURSIVE e AS (SELECT DISTINCT caller_id AS s, callee_id AS t FROM calls WHERE caller_id <> callee_id),
    hot AS (SELECT callee_id AS t FROM calls GROUP BY 1 ORDER BY count(DISTINCT caller_id) DESC, 1 LIMIT 3),
    walk AS (SELECT me.id AS source, me.id AS node, [me.id] AS ids, 0 AS depth FROM methods me WHERE me.name IN ('Update', 'LateUpdate')
      UNION ALL SELECT w.source, e.t, list_append(w.ids, e.t), w.depth + 1 FROM walk w JOIN e ON e.s = w.node WHERE w.depth < 10 AND NOT list_contains(w.ids, e.t)),
    found AS (SELECT source, node AS target, depth, array_to_string(ids, '>') AS path FROM walk JOIN hot ON hot.t = walk.node WHERE depth > 0),
    ranked AS (SELECT *, row_number() OVER (PARTITION BY source, target ORDER BY depth, path) AS rank FROM found)
    SELECT source, target, rank, depth, path FROM ranked WHERE rank <= 5""")  # fmt: skip
def chains_to_hot_methods(m: Model) -> DataFrame:
    """How control gets from every entry that the engine calls to the three methods with most callers."""
    entries = m.methods.filter(F.col("name").isin("Update", "LateUpdate")).select(F.col("id").alias("source"))
    hot = m.calls.groupBy(F.col("callee_id").alias("target")).agg(F.countDistinct("caller_id").alias("n")).orderBy(F.desc("n"), "target").limit(3).select("target")
    return shortest_chains(m.calls, entries.crossJoin(F.broadcast(hot)))  # the stated pairs: three for each entry
