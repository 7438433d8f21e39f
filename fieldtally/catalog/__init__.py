"""The named-query catalogue: every operator as a query over the input tables."""

from __future__ import annotations

import importlib

from fieldtally.catalog.registry import ORACLES, QUERIES

SECTIONS = (
    "q_sources",
    "q_columns",
    "q_joins",
    "q_aggregates",
    "q_windows",
    "q_questions",
    "q_spatial",
    "q_marts",
    "q_quality",
    "q_statistics",
    "q_forecast",
    "q_routes",
    "q_graph",
    "q_kpi",
)


def load() -> None:
    for section in SECTIONS:
        importlib.import_module(f"fieldtally.catalog.{section}")


load()

__all__ = ["ORACLES", "QUERIES"]
