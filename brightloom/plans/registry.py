"""All registered queries and oracles."""

from __future__ import annotations

from importlib import import_module

FAMILIES = (
    "sql_queries", "text_queries", "series_queries", "scoring_queries", "quality_queries", "retrieval_queries",
    "evaluation_queries",
)


def _merged(attribute: str) -> dict:
    merged: dict = {}
    for family in FAMILIES:
        part = getattr(import_module(f"brightloom.plans.{family}"), attribute)
        clash = merged.keys() & part.keys()
        if clash:
            raise ValueError(f"registered twice: {sorted(clash)}")
        merged.update(part)
    return merged


def queries() -> dict:
    return _merged("QUERIES")


def oracle_sql() -> dict:
    return _merged("ORACLES")
