"""All registered queries of the traffic engine and their oracle SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from packetloom.plans import details, entities, histories, reports, rollups, streams, tools, traffic, upkeep

MODULES = (traffic, entities, details, tools, upkeep, streams, rollups, histories, reports)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found: dict = {}
    for module in MODULES:
        found.update(module.QUERIES)
    return found


def oracle_sql() -> dict[str, str]:
    found: dict = {}
    for module in MODULES:
        found.update(module.ORACLE)
    return found
