"""The canonical tables as DataFrames, and small helpers that operators share."""

from __future__ import annotations

from collections.abc import Callable
from functools import partial

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import adapters


class Model:
    """Canonical tables by attribute: ``m.mods``, ``m.mod_xml_operations`` and so on.

    Tables come from the driver's files by the adapters, or from ``tables`` given by name (any source).
    """

    def __init__(self, spark: SparkSession, sf_dir: str | None = None, tables: dict[str, DataFrame] | None = None):
        self.spark, self.sf_dir, self._tables = spark, sf_dir, dict(tables or {})

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_") or name not in self._tables and (self.sf_dir is None or name not in adapters.VIEWS):
            raise AttributeError(name)
        if name not in self._tables:
            self._tables[name] = self.spark.sql(adapters.spark_sql(name, self.sf_dir))
        return self._tables[name]

    def register(self, *names: str) -> None:
        """Temp views, for ad-hoc SQL."""
        for n in names or adapters.VIEWS:
            getattr(self, n).createOrReplaceTempView(n)


REGISTRY: dict[str, tuple[Callable[[Model], DataFrame], str | None]] = {}


def query(name: str, sql: str | None = None, **args):
    """Register an operator over a Model, at ``args`` if given, as a query, with the SQL it equals."""

    def keep(f: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
        REGISTRY[name] = (partial(f, **args), sql)
        return f

    return keep


def csv(x: Column, sep: str = ",") -> Column:
    """Distinct values in order, joined; nulls are left out."""
    return F.array_join(F.array_sort(F.collect_set(x)), sep)


def csv_all(x: Column, sep: str = ",") -> Column:
    return F.array_join(F.array_sort(F.collect_list(x)), sep)


def total(condition: Column) -> Column:
    """How many rows meet a condition."""
    return F.coalesce(F.sum(F.when(condition, 1).otherwise(0)), F.lit(0)).cast("long")


def n() -> Column:
    return F.count(F.lit(1))


REMOVALS = ("remove", "removeattribute")
EDITS = ("set", "append", "setattribute", "insertAfter", "insertBefore")
EFFECTS = ("perc_add", "perc_set", "base_add", "base_set", "perc_subtract", "base_subtract")


def with_mod(m: Model, rows: DataFrame, **named: str) -> DataFrame:
    """rows with columns of their mod: keyword = new name, value = column of mods."""
    mods = m.mods.select(F.col("id").alias("__mod"), *(F.col(v).alias(k) for k, v in named.items()))
    return rows.join(mods, rows["mod_id"] == mods["__mod"]).drop("__mod")
