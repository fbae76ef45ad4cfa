"""All queries of the core, with their SQL counterparts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from legistra.plans import analysis, connectors, corpus, reading, records, search

Query = Callable[[SparkSession, str], DataFrame]
GROUPS = (corpus, search, analysis, reading, connectors, records)


def queries() -> dict[str, Query]:
    found: dict[str, Query] = {}
    for group in GROUPS:
        found.update(group.QUERIES)
    return found


def oracle_sql() -> dict[str, str]:
    found: dict[str, str] = {}
    for group in GROUPS:
        found.update(group.ORACLES)
    return found


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.QUERIES["m_by_type"](spark, sf_dir)
