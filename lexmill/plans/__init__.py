"""Registered queries, grouped by job."""

from __future__ import annotations

import importlib

MODULES = ["facts", "labels", "scores", "cuts", "trust", "search", "manage", "migration"]


def load_all():
    for name in MODULES:
        importlib.import_module(f"{__name__}.{name}")
    return importlib.import_module(f"{__name__}.registry")
