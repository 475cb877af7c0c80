"""Every query by name, with its SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .. import operators
from ..adapters import oracle
from ..model import REGISTRY, Model

operators.load()


def _bound(f: Callable[[Model], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: f(Model(spark, sf_dir))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: _bound(f) for name, (f, _) in REGISTRY.items()}


def oracle_sql() -> dict[str, str]:
    return {name: oracle(sql) for name, (_, sql) in REGISTRY.items() if sql}
