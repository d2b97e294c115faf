"""All registered queries and twins, in inventory order."""

from __future__ import annotations

from importlib import import_module

MODULES = ["feature_queries", "variant_queries", "relational_queries", "quality_queries", "segment_queries", "build_queries", "increment_queries"]


def _merged(attribute: str) -> dict:
    merged: dict = {}
    for name in MODULES:
        part = getattr(import_module(f"backflow.catalog.{name}"), attribute)
        clash = merged.keys() & part.keys()
        if clash:
            raise ValueError(f"registered twice: {sorted(clash)}")
        merged.update(part)
    return merged


def queries() -> dict:
    return _merged("QUERIES")


def twins() -> dict[str, str]:
    return _merged("TWINS")
