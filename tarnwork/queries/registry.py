"""The query modules of the core."""

from __future__ import annotations

import importlib

NAMES = ("general", "log", "assay", "search", "retrieval", "knowledge", "outside")


def modules() -> list:
    return [importlib.import_module(f"tarnwork.queries.{name}") for name in NAMES]
