"""Config files and change documents: one streaming pass over each file, rows with line numbers.

Files come as (path, content) rows, by ``read_files`` or any other reader. A parser per file runs on the executors; a
file that is not well-formed gives the rows before its fault and one row of kind ``error``.
"""

from __future__ import annotations

from collections.abc import Iterator
from xml.parsers import expat

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .numbering import numbered

#: Element, entity type, attribute that names it, attribute (or None) that it extends by.
ENTITIES = {
    "item": ("item", "name", "parent"), "block": ("block", "name", None), "entity_class": ("entity_class", "name", "extends"), "entitygroup": ("entity_group", "name", None),
    "buff": ("buff", "name", None), "recipe": ("recipe", "name", None), "SoundDataNode": ("sound", "name", None), "vehicle": ("vehicle", "name", None), "quest": ("quest", "id", None),
    "action_sequence": ("game_event", "name", None), "skill": ("skill", "name", None), "perk": ("perk", "name", None), "lootcontainer": ("loot_container", "id", None), "lootgroup": ("loot_group", "name", None),
}
#: Property names that refer to another entity.
REFERRING = {
    "Extends": "item", "HandItem": "item", "BuffOnEat": "buff", "BuffOnExecute": "buff", "SpawnEntityName": "entity_class", "SoundIdle": "sound", "SoundDeath": "sound",
    "SoundAttack": "sound", "SoundRandom": "sound", "LootListOnDeath": "loot_group",
}
OPERATIONS = ("set", "append", "remove", "insertAfter", "insertBefore", "setattribute", "removeattribute", "csv")
SCHEMA = "path string, kind string, entity long, line_number long, definition_type string, name string, extends string, property_name string, property_value string, property_class string, target_type string, target_name string, context string"


def read_files(spark: SparkSession, path: str, glob: str = "*.xml") -> DataFrame:
    """(path, content) of the files below ``path``."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", "true").load(path)
    return files.select("path", F.col("content").cast("string").alias("content"))


class _Config:
    """Rows of one config document. Entities nest nowhere in these files; the open one collects what lies inside."""

    def __init__(self, path: str):
        self.path, self.rows, self.count, self.open, self.depth = path, [], 0, None, 0
        self.classes: list[tuple[int, str]] = []
        self.text = ""

    def row(self, kind: str, line: int, **values) -> None:
        self.rows.append({"path": self.path, "kind": kind, "entity": self.count, "line_number": line} | values)

    def refer(self, line: int, target: str, name: str, context: str) -> None:
        if name:
            self.row("reference", line, target_type=target, target_name=name, context=context)

    def start(self, tag: str, a: dict, line: int) -> None:
        self.depth += 1
        if self.open is None and tag in ENTITIES:
            kind, key, parent = ENTITIES[tag]
            if name := a.get(key):
                self.count += 1
                self.open = {"depth": self.depth, "kind": kind, "line": line, "name": name, "extends": a.get(parent) if parent else None}
                self.text = ""
                if kind == "recipe":
                    self.refer(line, "item", name, "recipe_output")
            return
        if self.open is None:
            return
        kind = self.open["kind"]
        if tag == "property":
            self._property(a, line)
        elif tag == "ingredient" and kind == "recipe":
            self.refer(line, "item", a.get("name", ""), "recipe_ingredient")
        elif tag == "item" and kind == "loot_group":
            self.refer(line, "item", a.get("name", ""), "loot_entry")
        elif tag == "triggered_effect":
            context = f"triggered_effect:{a.get('action', '')}"
            for buff in a.get("buff", "").split(","):
                self.refer(line, "buff", buff.strip(), context)
            self.refer(line, "sound", a.get("sound", ""), context)
            self.refer(line, "game_event", a.get("event", ""), context)

    def _property(self, a: dict, line: int) -> None:
        inside = [c for d, c in self.classes if d < self.depth]
        if "class" in a:
            self.classes.append((self.depth, a["class"]))
        if self.depth > self.open["depth"] + 2:
            return  # two levels of properties count
        name, value = a.get("name"), a.get("value")
        self.row("property", line, property_name=name, property_value=value, property_class=inside[-1] if inside else a.get("class"))
        if name == "Extends" and self.open["kind"] in ("item", "block") and not inside:
            self.open["extends"] = value
        if name in REFERRING and value:
            self.refer(line, REFERRING[name], value, f"property:{name}")

    def end(self, tag: str) -> None:
        self.classes = [(d, c) for d, c in self.classes if d < self.depth]
        if self.open is not None and self.depth == self.open["depth"]:
            o = self.open
            if o["kind"] == "entity_group":
                for text in self.text.split("\n"):
                    self.refer(o["line"], "entity_class", text.split(",")[0].strip(), "group_member")
            self.row("definition", o["line"], definition_type=o["kind"], name=o["name"], extends=o["extends"])
            if o["extends"]:
                self.refer(o["line"], o["kind"], o["extends"], "extends")
            self.open = None
        self.depth -= 1

    def data(self, text: str) -> None:
        if self.open is not None and self.open["kind"] == "entity_group":
            self.text += text


class _Changes(_Config):
    """Rows of one change document: an operation for each element with an xpath."""

    def start(self, tag: str, a: dict, line: int) -> None:
        self.depth += 1
        if self.open is None and "xpath" in a and tag in OPERATIONS:
            self.count += 1
            self.open, self.text = {"depth": self.depth, "kind": tag, "line": line, "name": a["xpath"], "attribute": a.get("name")}, ""
        elif self.open is not None:
            self.text += f"<{tag}" + "".join(f' {k}="{v}"' for k, v in a.items()) + ">"

    def end(self, tag: str) -> None:
        if self.open is not None and self.depth == self.open["depth"]:
            o, text = self.open, self.text.strip()
            self.row("operation", o["line"], definition_type=o["kind"], name=o["name"], property_name=o["attribute"], property_value=text[:500] + ("…" if len(text) > 500 else ""))
            self.open = None
        self.depth -= 1

    def data(self, text: str) -> None:
        if self.open is not None:
            self.text += text


def parse(path: str, content: str | None, handler: type[_Config] = _Config) -> list[dict]:
    """Rows of one document."""
    doc, p = handler(path), expat.ParserCreate()
    p.StartElementHandler = lambda tag, a: doc.start(tag, a, p.CurrentLineNumber)
    p.EndElementHandler = doc.end
    p.CharacterDataHandler = doc.data
    try:
        p.Parse(content or "", True)
    except expat.ExpatError as e:
        doc.row("error", e.lineno, context=str(e))
    return doc.rows


_ARROW = pa.schema([(c.split()[0], {"string": pa.string(), "long": pa.int64()}[c.split()[1]]) for c in SCHEMA.split(", ")])


def _scan(files: DataFrame, handler: type[_Config]) -> DataFrame:
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found: list[dict] = []
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                found.extend(parse(path, content, handler))
                if len(found) >= 10_000:
                    yield pa.RecordBatch.from_pylist(found, _ARROW)
                    found = []
            if found:
                yield pa.RecordBatch.from_pylist(found, _ARROW)

    return files.select("path", "content").mapInArrow(rows, SCHEMA)


def config_rows(files: DataFrame) -> DataFrame:
    """All rows of config documents; ``kind`` is definition, property, reference or error."""
    return _scan(files, _Config)


def definitions(rows: DataFrame) -> DataFrame:
    """xml_definitions with ids from 1 by file and line; numbered within files, then shifted by the files before."""
    found = rows.filter("kind = 'definition'")
    sizes = numbered(found.groupBy("path").agg(F.max("entity").alias("__n")), "path", name="__at", weight="__n")  # counted by ranges of paths
    bases = sizes.select("path", (F.col("__at") - F.col("__n")).alias("__base"))
    return found.join(bases, "path").select((F.col("__base") + F.col("entity")).alias("id"), "definition_type", "name", F.col("path").alias("file_path"), "line_number", "extends", "entity")


def properties(rows: DataFrame, defs: DataFrame) -> DataFrame:
    owner = defs.select(F.col("id").alias("definition_id"), F.col("file_path").alias("path"), "entity")
    return rows.filter("kind = 'property'").join(owner, ["path", "entity"]).select("definition_id", "property_name", "property_value", "property_class", "line_number")


def references(rows: DataFrame, defs: DataFrame) -> DataFrame:
    owner = defs.select(F.col("id").alias("source_def_id"), F.col("definition_type").alias("source_type"), F.col("file_path").alias("path"), "entity")
    refs = rows.filter("kind = 'reference'").drop("definition_type").join(owner, ["path", "entity"])
    return refs.select("source_def_id", "source_type", "target_type", "target_name", F.col("context").alias("reference_context"), F.col("path").alias("file_path"), "line_number")


def change_operations(files: DataFrame) -> DataFrame:
    """Operations of change documents with target, property, canonical path and hash."""
    from ..functions import xpath as xp

    path = F.col("xpath")
    rows = _scan(files, _Changes).filter("kind = 'operation'").select("path", "line_number", F.col("definition_type").alias("operation"), F.col("name").alias("xpath"), F.col("property_value").alias("new_value"))
    found = xp.target(path)
    return rows.select("*", xp.normalise(path).alias("xpath_normalized"), xp.path_hash(path).alias("xpath_hash"), found["type"].alias("target_type"), found["name"].alias("target_name"), xp.property_name(path).alias("property_name"), xp.effect(path).alias("effect"))


#: Elements that stand for an addition by themselves, and the parents whose names are not the element's plus s.
ADDED = ("item", "block", "recipe", "buff", "entity_class", "quest", "trader", "vehicle", "lootcontainer", "lootgroup", "progression", "skill", "perk", "book")
PARENTS = {"entity_class": "entityclasses"}
#: What in a path tells the file it aims at, in order.
TARGET_FILES = [
    (r"/items|/item\[", "items.xml"), (r"/blocks|/block\[", "blocks.xml"), (r"/recipes|/recipe\[", "recipes.xml"), (r"/buffs|/buff\[", "buffs.xml"),
    (r"/entityclasses|/entity_class\[", "entityclasses.xml"), ("/progression", "progression.xml"), ("/loot", "loot.xml"), ("/quests", "quests.xml"), ("/traders", "traders.xml"), ("/vehicles", "vehicles.xml"),
]


class _Additions(_Config):
    """Rows of one change document by the second parser: operations with a path anywhere, and right below the root elements
    with a path under other names and whole entities, which are added to their parents."""

    def start(self, tag: str, a: dict, line: int) -> None:
        self.depth += 1
        name = tag.lower()
        path = a.get("xpath")
        if self.open is None and path and (name in ("set", "append", "insertafter", "insertbefore", "remove", "removeattribute") or self.depth == 2):
            self.open, self.text = {"depth": self.depth, "operation": name, "path": path, "line": line}, ""
        elif self.open is None and self.depth == 2 and name in ADDED:
            label = a.get("name", a.get("id"))
            parent = PARENTS.get(name, name + "s")
            self.row("operation", line, definition_type="append", name=f"/{parent}", property_value=f'<{name} name="{label}">...</{name}>' if label else f"<{name}/>", context=f"{parent}.xml")

    def end(self, tag: str) -> None:
        if self.open is not None and self.depth == self.open["depth"]:
            o = self.open
            self.row("operation", o["line"], definition_type=o["operation"], name=o["path"], property_value=self.text or None)
            self.open = None
        self.depth -= 1

    def data(self, text: str) -> None:
        if self.open is not None:
            self.text += text


def xml_changes(files: DataFrame) -> DataFrame:
    """Changes of change documents by the second parser: operation, path, property, new value and the file aimed at."""
    path = F.col("name")
    rows = _scan(files, _Additions).filter("kind = 'operation'")
    named = F.nullif(F.regexp_extract(path, r"(?i)property\[@name=['\"]([^'\"]+)['\"]\]", 1), F.lit(""))
    attribute = F.nullif(F.nullif(F.regexp_extract(path, r"/@([A-Za-z_]\w*)$", 1), F.lit("")), F.lit("value"))
    target = F.coalesce("context", *(F.when(F.rlike(F.lower(path), F.lit(p)), f) for p, f in TARGET_FILES), F.substring_index("path", "/", -1))
    return rows.select(F.col("path").alias("file_path"), "line_number", F.col("definition_type").alias("operation"), path.alias("xpath"), F.coalesce(named, attribute).alias("property_name"), F.col("property_value").alias("new_value"), target.alias("xml_file"))


def mods(files: DataFrame) -> DataFrame:
    """One row for each folder with a ModInfo.xml: what that says, whether there are config files and libraries, and the load order by
    folder name. files: path, content of all files, of which only the info files need a content."""
    info = files.filter(F.col("path").endswith("/ModInfo.xml"))
    value = lambda tag: F.nullif(F.regexp_extract("content", rf"(?i)<{tag}\s+value=[\"']([^\"']*)[\"']", 1), F.lit("")).alias(tag)
    tags = ("name", "display_name", "version", "author", "description", "website")
    rows = info.select(F.regexp_replace("path", "/ModInfo.xml$", "").alias("root"), *(value(t.replace("_", "")).alias(t) for t in tags))
    part = F.regexp_extract("path", r"^(.*?)/(?:Config/.*\.xml|[^/]*\.dll)$", 1)
    held = files.select(part.alias("root"), F.col("path").endswith(".xml").alias("xml")).filter("root <> ''").groupBy("root").agg(F.max("xml").alias("has_xml"), F.max(~F.col("xml")).alias("has_dll"))
    known = rows.join(held, "root", "left").select(F.substring_index("root", "/", -1).alias("folder"), *tags, F.coalesce("has_xml", F.lit(False)).alias("has_xml"), F.coalesce("has_dll", F.lit(False)).alias("has_dll"))
    return numbered(known, "folder", name="load_order")


def semantic_mappings(spark: SparkSession, path: str) -> DataFrame:
    """Descriptions from JSON lines; of several for one entity the last by file and content stands."""
    rows = spark.read.schema("entity_type string, entity_name string, layman_description string, technical_description string, generated_at string").json(path)
    order = Window.partitionBy("entity_type", "entity_name").orderBy(F.desc("generated_at"), F.desc("layman_description"))
    return rows.filter("entity_type is not null and entity_name is not null").withColumn("r", F.row_number().over(order)).filter("r = 1").drop("r")
