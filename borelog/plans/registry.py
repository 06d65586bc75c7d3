"""All queries over the driver's tables, with the SQL that each is checked against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import assists, checks, hazards, parsing, passages, proposals, ranking, records, reviews, signals

MODULES = (records, hazards, signals, passages, reviews, checks, assists, parsing, ranking, proposals)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: f for m in MODULES for k, f in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {k: x for m in MODULES for k, x in m.SQL.items()}
