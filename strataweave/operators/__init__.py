"""Operators over the canonical tables; importing a module registers its queries."""

import importlib
import pkgutil


def load() -> None:
    for found in pkgutil.iter_modules(__path__):
        importlib.import_module(f"{__name__}.{found.name}")
