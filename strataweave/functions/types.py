"""Type names of source code as column expressions: splitting, resolution and signature comparison, folds over characters or tokens."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Keywords, and short names by the namespace that they stand for.
KEYWORDS = {
    "bool": "System.Boolean", "byte": "System.Byte", "sbyte": "System.SByte", "char": "System.Char", "decimal": "System.Decimal", "double": "System.Double", "float": "System.Single", "int": "System.Int32",
    "uint": "System.UInt32", "long": "System.Int64", "ulong": "System.UInt64", "short": "System.Int16", "ushort": "System.UInt16", "object": "System.Object", "string": "System.String", "void": "System.Void",
    "nint": "System.IntPtr", "nuint": "System.UIntPtr",
}
NAMESPACES = {
    "UnityEngine": (
        "GameObject Transform Vector2 Vector3 Vector4 Quaternion Color Rect Bounds Ray RaycastHit Material Texture Texture2D Sprite AudioClip AudioSource Camera Rigidbody Collider BoxCollider "
        "SphereCollider CapsuleCollider MeshCollider MonoBehaviour ScriptableObject Coroutine AnimationCurve Animator Animation ParticleSystem"
    ),
    "System.Collections.Generic": "List Dictionary HashSet Queue Stack LinkedList SortedList SortedDictionary SortedSet IEnumerable ICollection IList IDictionary ISet KeyValuePair",
    "System.Collections": "ArrayList Hashtable",
}
ALIASES = KEYWORDS | {name: f"{space}.{name}" for space, names in NAMESPACES.items() for name in names.split()}
MODIFIERS = r"^(?:(?:ref|out|in|params|this)\s+)+"


def _names(known: dict[str, str] | None) -> Column:
    return F.create_map(*(F.lit(x) for kv in (ALIASES | (known or {})).items() for x in kv))


def parameters(text: Column) -> Column:
    """Parts at commas outside angle, round and square brackets, trimmed; empty ones are left out."""
    start = F.struct(F.array().cast("array<string>").alias("parts"), F.lit("").alias("part"), F.lit(0).alias("depth"))

    def step(acc: Column, c: Column) -> Column:
        depth = (acc["depth"] + F.when(c.isin("<", "(", "["), 1).when(c.isin(">", ")", "]"), -1).otherwise(0)).alias("depth")
        cut = (c == ",") & (acc["depth"] == 0)
        return F.struct(F.when(cut, F.concat(acc["parts"], F.array(acc["part"]))).otherwise(acc["parts"]).alias("parts"), F.when(cut, "").otherwise(F.concat(acc["part"], c)).alias("part"), depth)

    done = F.aggregate(F.split(text, ""), start, step)
    return F.filter(F.transform(F.concat(done["parts"], F.array(done["part"])), lambda p: F.trim(p)), lambda p: p != "")


def resolved(name: Column, known: dict[str, str] | None = None) -> Column:
    """Full name of a type: every name in it by the table, ``?`` around what it stands behind; an unknown name stays.

    One fold over the tokens; the stack holds where the type began that each open bracket stands in.
    """
    names = _names(known)
    tokens = F.regexp_extract_all(name, F.lit(r"\[[ ,]*\]|[<>(),?]|[^\s<>(),?\[\]]+"), F.lit(0))
    start = F.struct(F.lit("").alias("out"), F.array(F.lit(0)).alias("begins"))

    def step(acc: Column, t: Column) -> Column:
        out, begins = acc["out"], acc["begins"]
        own = F.element_at(begins, -1)
        below = F.slice(begins, F.lit(1), F.greatest(F.size(begins) - 1, F.lit(1)))
        longer = F.concat(out, t)
        wrapped = F.concat(F.substring(out, F.lit(1), own), F.lit("System.Nullable<"), F.substring(out, own + 1, F.length(out)), F.lit(">"))
        new = F.when(t == "?", wrapped).when(t.isin("<", ">", "(", ")", ","), longer).when(t.startswith("["), F.concat(out, F.replace(t, F.lit(" "), F.lit("")))).otherwise(F.concat(out, F.coalesce(F.try_element_at(names, t), t)))
        stack = F.when(t.isin("<", "("), F.concat(begins, F.array(F.length(longer)))).when(t.isin(">", ")"), below).when(t == ",", F.concat(F.slice(begins, F.lit(1), F.size(begins) - 1), F.array(F.length(longer)))).otherwise(begins)
        return F.struct(new.alias("out"), stack.alias("begins"))

    return F.aggregate(tokens, start, step, lambda acc: acc["out"])


def parameter_type(parameter: Column) -> Column:
    """The type of a parameter: without modifiers, default value and name."""
    p = F.trim(F.regexp_replace(F.trim(F.regexp_replace(parameter, r"=[^>].*$|=$", "")), MODIFIERS, ""))
    return F.trim(F.regexp_replace(p, r"(?<=[\w>\]?])\s+@?\w+$", ""))


def parameter_types(text: Column, known: dict[str, str] | None = None) -> Column:
    """Full types of a parameter list, with or without its parentheses."""
    inner = F.regexp_replace(F.regexp_replace(F.trim(text), r"^\(", ""), r"\)$", "")
    return F.transform(parameters(inner), lambda p: resolved(parameter_type(p), known))


def same_signature(a: Column, b: Column, known: dict[str, str] | None = None) -> Column:
    """Whether two parameter lists have the same types; never if one is null."""
    return F.coalesce(parameter_types(a, known) == parameter_types(b, known), F.lit(False))


def overload_matches(patched: Column, declared: Column) -> Column:
    """Whether declared parameter types fit a patch's, parameters that the patcher injects (``__…``) aside."""
    own = F.filter(declared, lambda p: ~p.startswith("__"))
    short = lambda xs: F.transform(xs, lambda p: F.lower(F.substring_index(p, ".", -1)))
    return short(patched) == short(own)
