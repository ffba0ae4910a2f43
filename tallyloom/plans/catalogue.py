"""The registered queries and the SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tallyloom.plans import alignment, cells, checks, objects, packages, parts, references, reviewing

Query = Callable[[SparkSession, str], DataFrame]
MODULES = (alignment, cells, checks, objects, packages, parts, references, reviewing)


def queries() -> dict[str, Query]:
    return {k: v for m in MODULES for k, v in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {k: v for m in MODULES for k, v in m.SQL.items()}
