"""Registered queries of the geometry operators, and DuckDB SQL for each."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}
FLAGSHIP = "m2_match_ratio_test"


def register(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return add


MODULES = ("camera", "matching", "cloud", "pose", "render", "mesh", "kernel", "scene", "depth", "two_view", "reconstruction", "fusion", "surface", "field", "compare")


def load() -> tuple[dict[str, Query], dict[str, str]]:
    """All queries and their SQL. The modules register themselves, and each can also be imported alone."""
    for module in MODULES:
        importlib.import_module(f"prismlake.plans.{module}_queries")
    return QUERIES, ORACLES
