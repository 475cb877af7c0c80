"""Where results go: tables with upsert rules, JSON, text, Markdown."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import shared_dir


def write_table(rows: DataFrame, path: str, mode: str = "overwrite") -> DataFrame:
    """``rows`` as a Parquet table at ``path``, all or nothing, and what is stored there; ``append`` adds to it."""
    rows.write.mode(mode).parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)


def stored(rows: DataFrame, name: str) -> DataFrame:
    """``rows`` written once to a table of their own in the shared folder, and read from there."""
    return write_table(rows, f"{shared_dir(rows.sparkSession)}/tables/{name}-{uuid.uuid4().hex}", "error")


def rebuild(rows: DataFrame, path: str, old: DataFrame | None, stale: DataFrame, key: list[str]) -> DataFrame:
    """The table at ``path`` anew: ``old`` without the keys in ``stale``, then ``rows``. ``path`` must not be where ``old`` lies."""
    kept = rows if old is None else old.join(stale.select(*key).distinct(), key, "left_anti").select(*rows.columns).unionByName(rows)
    return write_table(kept, path)


def copy_if_changed(source: DataFrame, target: DataFrame | None, path: str, hash_of: list[str]) -> tuple[DataFrame, bool]:
    """``source`` copied to ``path`` unless ``target``, the copy of an earlier run, holds the same rows; the copy and whether it was made.

    Rows are compared by the order-free sum of their hashes over ``hash_of`` and by their number.
    """
    seal = lambda df: df.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.xxhash64(*hash_of).cast("decimal(38,0)")), F.lit(0))).first()
    if target is not None and seal(source) == seal(target):
        return target, False
    return write_table(source, path), True


def upsert(old: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    """``new`` over ``old``: of rows with one key the new one stands."""
    return old.join(new.select(*key), key, "left_anti").select(*old.columns).unionByName(new.select(*old.columns))


def insert_or_ignore(old: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    """Rows of ``new`` with keys that ``old`` lacks are added, one for each key."""
    fresh = new.dropDuplicates(key).join(old.select(*key), key, "left_anti")
    return old.unionByName(fresh.select(*old.columns))


def keep_first(old: DataFrame, new: DataFrame, key: list[str], order: str | None = None) -> DataFrame:
    """Old values stand, and nulls among them are filled from ``new``: from its first row by ``order`` that has a value."""
    values = [c for c in old.columns if c not in key]
    place = F.monotonically_increasing_id() if order is None else F.col(order)
    first = lambda c: F.min_by(c, F.when(F.col(c).isNotNull(), F.col("__place")))
    late = new.withColumn("__place", place).groupBy(*key).agg(*(first(c).alias(f"__new_{c}") for c in values)).withColumn("__added", F.lit(True))
    both = old.withColumn("__held", F.lit(True)).join(late, key, "full_outer")
    return both.select(*(c if c in key else F.coalesce(c, f"__new_{c}").alias(c) for c in old.columns))


def last_wins(rows: DataFrame, key: list[str], order: str) -> DataFrame:
    """One row for each key: the greatest by ``order``."""
    w = Window.partitionBy(*key).orderBy(F.desc(order))
    return rows.withColumn("__r", F.row_number().over(w)).filter("__r = 1").drop("__r")


def delete_by_file(rows: DataFrame, paths: DataFrame) -> DataFrame:
    """Rows whose file_path is not in ``paths`` (file_path)."""
    return rows.join(paths.select("file_path"), "file_path", "left_anti").select(*rows.columns)


def as_json(rows: DataFrame) -> DataFrame:
    """One JSON object a row, nulls left out."""
    return rows.select(F.to_json(F.struct(*rows.columns)).alias("json"))


def as_text(rows: DataFrame, limit: int = 100, width: int = 60) -> str:
    """A text table of the first ``limit`` rows, long cells cut; NULL for nulls."""
    found = rows.limit(limit).collect()
    if not found:
        return "(no results)"
    cell = lambda v: "NULL" if v is None else str(v) if len(str(v)) <= width else str(v)[: width - 1] + "…"
    table = [rows.columns, *([cell(v) for v in r] for r in found)]
    widths = [max(len(r[i]) for r in table) for i in range(len(rows.columns))]
    line = lambda r: " | ".join(v.ljust(w) for v, w in zip(r, widths, strict=True)).rstrip()
    return "\n".join([line(table[0]), "-+-".join("-" * w for w in widths), *map(line, table[1:])])


def as_markdown(sections: dict[str, DataFrame], limit: int = 100) -> str:
    """A report with one table a section."""
    out = []
    for title, rows in sections.items():
        found = rows.limit(limit).collect()
        out += [f"## {title}", ""]
        out += ["| " + " | ".join(rows.columns) + " |", "|" + "---|" * len(rows.columns)] if found else ["Nothing found."]
        out += ["| " + " | ".join("" if v is None else str(v).replace("|", "\\|") for v in r) + " |" for r in found] + [""]
    return "\n".join(out)
