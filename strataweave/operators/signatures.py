"""Signatures of methods: parameter lists split, their types resolved and compared."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import types as ty
from ..model import Model, query
from .graph import settled

#: Shapes of a parameter list, with the types a and b put in, and the full types of its parameters.
SHAPES = [
    ("(ref {a} x, out {b} y)", "{A}|{B}"), ("(List<{a}> xs, Dictionary<{a}, {b}> d = null)", "System.Collections.Generic.List<{A}>|System.Collections.Generic.Dictionary<{A},{B}>"),
    ("({a}[] x, {b}?[] y)", "{A}[]|System.Nullable<{B}>[]"), ("()", ""), ("(params {a}[ , ] x)", "{A}[,]"), ("(this My.Own<{a}, List<{b}[]>> me, int n)", "My.Own<{A},System.Collections.Generic.List<{B}[]>>|System.Int32"),
    ("({a}, {b})", "{A}|{B}"), ("Func<({a}, {b})?, {a}> f", "Func<System.Nullable<({A},{B})>,{A}>"), ("(in {a} @event, NotKnown other = default)", "{A}|NotKnown"),
]
BLOCK = 1000  # ids of one list that are paired at once
_NAMES = list(ty.ALIASES)
_FULL = f"[{', '.join(repr(v) for v in ty.ALIASES.values())}]"
_SHORT = f"[{', '.join(repr(v) for v in _NAMES)}]"


def _signatures(m: Model) -> DataFrame:
    part = m.spark.read.parquet(f"{m.sf_dir}/part.parquet").select(F.col("p_partkey").alias("id"))
    names = F.array(*map(F.lit, _NAMES))
    at = lambda k: F.get(names, (k % len(_NAMES)).cast("int"))
    shape = F.get(F.array(*(F.lit(s) for s, _ in SHAPES)), (F.col("id") % len(SHAPES)).cast("int"))
    return part.select("id", F.replace(F.replace(shape, F.lit("{a}"), at(F.col("id"))), F.lit("{b}"), at(F.col("id") * 7 + 3)).alias("signature"))


_TYPED = f"""
    WITH t AS (SELECT p_partkey AS id, {_FULL}[p_partkey % {len(_NAMES)} + 1] AS a, {_FULL}[(p_partkey * 7 + 3) % {len(_NAMES)} + 1] AS b, [{', '.join(repr(full) for _, full in SHAPES)}][p_partkey % {len(SHAPES)} + 1] AS shape FROM part),
    r AS (SELECT id, replace(replace(shape, '{{A}}', a), '{{B}}', b) AS types, id % {len(SHAPES)} AS k FROM t)"""


@query("scl_22_parameter_types", _TYPED + " SELECT id, types, CAST(CASE WHEN types = '' THEN 0 ELSE len(string_split(types, '|')) END AS INTEGER) AS n FROM r")
def parameter_types(m: Model) -> DataFrame:
    """Full types of all parameters: every alias, arrays, nested generics, tuples, nullable and by-reference ones."""
    types = ty.parameter_types(F.col("signature"))
    return _signatures(m).select("id", F.array_join(types, "|").alias("types"), F.size(types).alias("n"))


@query("scl_21_same_signatures", _TYPED + " SELECT x.id, y.id AS other FROM r x JOIN r y ON x.types = y.types AND x.id < y.id")
def same_signatures(m: Model) -> DataFrame:
    """Pairs of parameter lists that mean the same types; each different list is looked at once."""
    rows = _signatures(m)
    tasks = m.spark.sparkContext.defaultParallelism * 4
    # Written, as a filter on the types would go before the ``distinct`` and read every row's list.
    lists = settled(rows.select("signature").distinct().repartition(tasks, "signature"))
    # The types stand for the list: ``ty.same_signature`` compares just these, and a null has none.
    known = settled(lists.withColumn("types", ty.parameter_types(F.col("signature"))).filter("types is not null"))
    typed = rows.join(known, "signature").select("id", "types")
    # One list may stand for very many ids: they go in blocks, and pairs of blocks are dealt out evenly.
    blocks = typed.groupBy("types").agg((F.count("id") / BLOCK).cast("long").alias("last"))
    dealt = typed.join(blocks, "types").groupBy("types", F.pmod(F.xxhash64("id"), F.col("last") + 1).alias("x")).agg(F.collect_list("id").alias("ids"))
    both = dealt.join(dealt.withColumnsRenamed({"x": "y", "ids": "others"}), "types").filter("x <= y").select("x", "y", "ids", "others").repartition(tasks)
    pairs = both.select((F.col("x") == F.col("y")).alias("own"), F.explode("ids").alias("id"), "others").select("own", "id", F.explode("others").alias("other"))
    return pairs.filter("not own or id < other").select(F.least("id", "other").alias("id"), F.greatest("id", "other").alias("other")).filter("id < other")
