"""Compositions of the operators and their registered queries."""
from __future__ import annotations

import importlib
import pkgutil


def load_all():
    """Import every plan module once and return the catalog."""
    for found in pkgutil.iter_modules(__path__):
        importlib.import_module(f"{__name__}.{found.name}")
    return importlib.import_module(f"{__name__}.catalog")
