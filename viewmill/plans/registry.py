"""All registered queries of the core library."""

from __future__ import annotations

from collections.abc import Callable
from types import ModuleType

from pyspark.sql import DataFrame, SparkSession

from viewmill.plans import candidates, coverage, curation, fits, nesting, planning, records, relational, sequences, shapes, stats, streams

MODULES: tuple[ModuleType, ...] = (curation, stats, relational, sequences, nesting, fits, coverage, shapes, planning, streams, records, candidates)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: query for module in MODULES for name, query in module.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for module in MODULES for name, sql in module.SQL.items()}
