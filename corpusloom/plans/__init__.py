"""Registered queries of the core, one module a family."""

from __future__ import annotations

import importlib

from corpusloom.registry import Registry

FAMILIES = ("text", "dense", "retrieval", "events", "structure", "scalars", "incremental")


def all_queries() -> Registry:
    """One registry with the queries of every family."""
    merged = Registry()
    for family in FAMILIES:
        part = importlib.import_module(f"corpusloom.plans.{family}").REGISTRY
        for name, fn in part.queries.items():
            merged.query(name, part.oracles.get(name))(fn)
    return merged
