"""One session facade: a method for each command, and ad-hoc SQL over the canonical tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .model import REGISTRY, Model
from .operators import chains, conflicts, ecosystem, events, graph, hierarchy, indirect, load, lookup, patches, qa, text_index
from .sources import reports, sinks

load()


class Engine:
    """Questions to one set of canonical tables."""

    def __init__(self, spark: SparkSession, sf_dir: str | None = None, tables: dict[str, DataFrame] | None = None):
        self.model = Model(spark, sf_dir, tables)
        self.spark = spark

    def sql(self, text: str, **args) -> DataFrame:
        """Ad-hoc SQL with named parameters; the canonical tables are views."""
        from .adapters import needed

        self.model.register(*[v for v in needed(text)] or ["mods"])
        return self.spark.sql(text, args=args or None)

    def run(self, name: str) -> DataFrame:
        """Any registered query by name."""
        return REGISTRY[name][0](self.model)

    def list(self, kind: str) -> DataFrame:
        return lookup.list_by_type(self.model, kind)

    def search(self, pattern: str) -> DataFrame:
        return lookup.search(self.model, pattern)

    def refs(self, kind: str, name: str) -> DataFrame:
        return lookup.references_to(self.model, kind, name)

    def callers(self, method: str) -> DataFrame:
        """Callers of the first method that ``Type.Method`` means, by id."""
        first = lookup.resolve_methods(self.model, method).orderBy("id").first()
        return lookup.callers(self.model, first["id"] if first else -1)

    def chain(self, source: str, target: str, depth: int = 10, limit: int = 5) -> DataFrame:
        """Shortest call paths between two methods; of several that a name means, the least id."""
        first = lambda name: lookup.resolve_methods(self.model, name).agg({"id": "min"}).toDF("id")
        pair = first(source).toDF("source").crossJoin(first(target).toDF("target"))  # one row
        return chains.shortest_chains(self.model.calls, pair, depth, limit)

    def find_text(self, text: str) -> DataFrame:
        """Methods whose body a full-text query matches, from the stored index."""
        return text_index.index_of(self.model).search(text)

    def derived(self, name: str) -> DataFrame:
        return hierarchy.derived_types(self.model.types, name)

    def impl(self, method: str) -> DataFrame:
        return graph.implementations(self.model, method)

    def compat(self) -> DataFrame:
        return patches.compat_check(self.model)

    def events(self, pattern: str) -> DataFrame:
        return events.event_lookup(self.model, pattern)

    def flow(self) -> DataFrame:
        return events.event_flow(self.model)

    def effective(self) -> DataFrame:
        return patches.effective_behaviour(self.model)

    def qa(self) -> dict[str, DataFrame]:
        """The phases of the quality check of all mods; ``verdict`` says which of them fail."""
        return qa.check(self.model)

    def qa_report(self, path: str) -> bool:
        """Write the report of every mod to text files below ``path``; whether all pass."""
        phases = qa.check(self.model)
        reports.write_document(qa.report_lines(self.model, phases), path)
        return phases["verdict"].filter("verdict = 'fail'").isEmpty()

    def conflict_document(self, path: str) -> DataFrame:
        """Write the conflict report as one JSON document to text files below ``path``."""
        return reports.write_document(reports.json_document(self.spark, qa.conflict_sections(self.model)), path)

    def detect_conflicts(self) -> dict[str, DataFrame]:
        return conflicts.conflict_report(self.model)

    def indirect_conflicts(self) -> DataFrame:
        return indirect.indirect_conflicts(self.model)

    def harmony_conflicts(self) -> DataFrame:
        return patches.harmony_conflicts(self.model)

    def dependency_graph(self, depth: int = 10) -> DataFrame:
        return graph.closure(self.model, None, depth)

    def impact(self, kind: str, name: str) -> DataFrame:
        entity = self.model.xml_definitions.filter((self.model.xml_definitions["definition_type"] == kind) & (self.model.xml_definitions["name"] == name)).select("id")
        return graph.impact(self.model, entity)

    def ecosystem(self) -> DataFrame:
        return ecosystem.ecosystem_entities(self.model)

    def stats(self) -> DataFrame:
        return ecosystem.stats(self.model)

    def mod_details(self, pattern: str) -> DataFrame:
        return lookup.mod_details(self.model, pattern)

    def report(self) -> str:
        """The main tables as Markdown."""
        m = self.model
        sections = {"Stats": ecosystem.stats(m), "Mods": ecosystem.mod_health(m), "Contested entities": conflicts.contested_entities(m), "Behaviour": ecosystem.mod_behaviour(m)}
        return sinks.as_markdown(sections)
