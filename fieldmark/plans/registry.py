"""All registered queries and their SQL twins, gathered from the modules of this package."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

MODULES: tuple[str, ...] = ("lookup", "grid", "aggregate", "vectors", "spatial", "text")


def _modules():
    from importlib import import_module

    return [import_module(f"fieldmark.plans.{name}") for name in MODULES]


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    out: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
    for m in _modules():
        if both := out.keys() & m.QUERIES.keys():
            raise ValueError(f"registered twice: {sorted(both)}")
        out |= m.QUERIES
    return out


def oracle_sql() -> dict[str, str]:
    return {k: sql for m in _modules() for k, sql in m.SQL.items()}
