"""Registry of this subpackage's queries; every family adds its own."""

from __future__ import annotations

import importlib

from corpusloom.registry import Registry

FAMILIES = ("similar", "splitting", "clusters", "credentials", "terms", "leakage", "mixing", "subjects")


def _merge() -> Registry:
    merged = Registry()
    for family in FAMILIES:
        part = importlib.import_module(f"corpusloom.llm.queries_{family}").REGISTRY
        for name, fn in part.queries.items():
            merged.query(name, part.oracles.get(name))(fn)
    return merged


REGISTRY = _merge()
