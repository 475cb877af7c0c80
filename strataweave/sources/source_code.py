"""Scans of source files that need matching braces: patch classes, method bodies, config trees."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from xml.parsers import expat

import pyarrow as pa
from pyspark.sql import DataFrame

ATTRIBUTE = re.compile(r"\[HarmonyPatch\((.*)\)\]")
HEAD = re.compile(r"((?:[ \t]*\[[^\n]*\][ \t]*\r?\n)*)[\w \t]*$")
CLASS = re.compile(r"\bclass\s+(\w+)")
METHOD = re.compile(r"\b(?:public|private|internal|protected)?\s*static\s+([\w<>\[\],.]+)\s+(\w+)\s*\(([^)]*)\)\s*\{")
KINDS = ("Prefix", "Postfix", "Transpiler", "Finalizer")
DYNAMIC = re.compile(r"\.Patch\(\s*AccessTools\.Method\(\s*typeof\((\w+)\)\s*,\s*\"(\w+)\"")
PATCH_ALL = re.compile(r"\.PatchAll\(")


def closing(text: str, at: int) -> int:
    """Position after the brace that closes the one at ``at``; strings and comments are passed over."""
    depth, i = 0, at
    while i < len(text):
        two = text[i : i + 2]
        if two == "//":
            i = text.find("\n", i)
            if i < 0:
                return len(text)
        elif two == "/*":
            end = text.find("*/", i + 2)
            i = len(text) if end < 0 else end + 1
        elif text[i] in "\"'":
            quote, j = text[i], i + 1
            while j < len(text) and text[j] != quote and text[j] != "\n":
                j += 2 if text[j] == "\\" else 1
            i = j
        else:
            depth += (text[i] == "{") - (text[i] == "}")
            if depth == 0 and text[i] == "}":
                return i + 1
        i += 1
    return len(text)


def patches(text: str) -> list[dict]:
    """Patches of one file: attributes on classes, and patches made at run time."""
    out = []
    line = lambda at: text.count("\n", 0, at) + 1
    for c in CLASS.finditer(text):
        brace = text.find("{", c.end())
        if brace < 0:
            continue
        head, body = HEAD.search(text, max(0, c.start() - 4000), c.start())[1], text[brace : closing(text, brace)]
        target: dict = {}
        for a in ATTRIBUTE.findall(head):
            if m := re.search(r"typeof\(\s*([\w.]+)\s*\)", a):
                target.setdefault("target_class", m[1])
            if m := re.search(r"\"(\w+)\"|nameof\(\s*[\w.]*?(\w+)\s*\)", a):
                target.setdefault("target_method", m[1] or m[2])
            if m := re.search(r"new\s*(?:Type)?\[\]\s*\{([^}]*)\}", a):
                target["target_arg_types"] = json.dumps(re.findall(r"typeof\(\s*([\w.<>\[\]]+)\s*\)", m[1]))
        if not target:
            continue
        if m := re.search(r"\[HarmonyPriority\(\s*(?:Priority\.(\w+)|(\d+))\s*\)\]", head):
            named = {"First": 0, "VeryHigh": 700, "High": 600, "HigherThanNormal": 500, "Normal": 400, "LowerThanNormal": 300, "Low": 200, "VeryLow": 100, "Last": 0}
            target["harmony_priority"] = int(m[2]) if m[2] else 800 if m[1] == "First" else named.get(m[1], 400)
        for key, mark in (("harmony_before", "HarmonyBefore"), ("harmony_after", "HarmonyAfter")):
            if m := re.search(rf"\[{mark}\(([^)]*)\)\]", head):
                target[key] = json.dumps(re.findall(r"\"([^\"]+)\"", m[1]))
        for m in METHOD.finditer(body):
            if m[2] in KINDS:
                inner = body[m.end() - 1 : closing(body, m.end() - 1)]
                guard = re.search(r"^\{\s*if\s*\(([^)]*)\)\s*(?:\{\s*)?return\b", inner)
                out.append({
                    "patch_class": c[1], "patch_type": m[2], "harmony_priority": 400, "returns_bool": m[1] == "bool", "modifies_result": "ref " in m[3] and "__result" in m[3], "uses_state": "__state" in m[3],
                    "is_guarded": bool(guard), "guard_condition": guard[1] if guard else None, "line_number": line(brace + m.start()),
                } | target)
    for m in DYNAMIC.finditer(text):
        out.append({"patch_class": None, "patch_type": "Dynamic", "target_class": m[1], "target_method": m[2], "harmony_priority": 400, "line_number": line(m.start())})
    for m in PATCH_ALL.finditer(text):
        out.append({"patch_class": None, "patch_type": "PatchAll", "harmony_priority": 400, "line_number": line(m.start())})
    return out


def bodies(text: str) -> list[dict]:
    """Methods of one file with their text from declaration to closing brace."""
    out = []
    for m in re.finditer(r"\b(?:public|private|protected|internal)\s+(?:(?:static|virtual|override|async|sealed|new)\s+)*[\w<>\[\],.?]+\s+(\w+)\s*\(([^)]*)\)\s*\{", text):
        end = closing(text, m.end() - 1)
        out.append({"method": m[1], "parameters": m[2].strip(), "first_line": text.count("\n", 0, m.start()) + 1, "last_line": text.count("\n", 0, end) + 1, "body": text[m.start() : end]})
    return out


def tree(text: str) -> list[dict]:
    """Elements of a config document down to depth three with their paths: by name where there is one, else by place."""
    out, stack = [], []
    p = expat.ParserCreate()

    def start(tag: str, a: dict) -> None:
        if stack:
            seen = stack[-1]["seen"]
            seen[tag] = seen.get(tag, 0) + 1
            step = f'{tag}[@name="{a["name"]}"]' if "name" in a else f"{tag}[{seen[tag]}]"
            path = f"{stack[-1]['path']}/{step}"
        else:
            path = f"/{tag}"
        if 1 <= len(stack) <= 3:
            out.append({"element_type": tag, "element_name": a.get("name"), "element_xpath": path, "property_value": a.get("value"), "line_number": p.CurrentLineNumber})
        stack.append({"path": path, "seen": {}})

    p.StartElementHandler, p.EndElementHandler = start, lambda tag: stack.pop()
    try:
        p.Parse(text, True)
    except expat.ExpatError:
        pass  # the elements before the fault stand
    return out


PATCH_COLUMNS = "patch_class string, patch_type string, target_class string, target_method string, target_arg_types string, harmony_priority int, harmony_before string, harmony_after string, returns_bool boolean, modifies_result boolean, uses_state boolean, is_guarded boolean, guard_condition string, line_number long"
BODY_COLUMNS = "method string, parameters string, first_line long, last_line long, body string"
TREE_COLUMNS = "element_type string, element_name string, element_xpath string, property_value string, line_number long"


_ARROW = {"string": pa.string(), "int": pa.int32(), "long": pa.int64(), "boolean": pa.bool_()}


def scan(files: DataFrame, of, columns: str) -> DataFrame:
    """file_path, content -> file_path and the rows that ``of`` (patches, bodies, tree) finds."""
    schema = pa.schema([("file_path", pa.string()), *((c.split()[0], _ARROW[c.split()[1]]) for c in columns.split(", "))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [r | {"file_path": path} for path, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True) if content for r in of(content)]
            if rows:
                yield pa.RecordBatch.from_pylist(rows, schema)

    return files.select("file_path", "content").mapInArrow(run, "file_path string, " + columns)
