"""Every query of the library by name, with the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from motrac.plans import cell_queries, library_queries, lineage_queries, markov_queries, more_queries, motion_queries, numeric_queries, stats_queries

MODULES = (lineage_queries, motion_queries, cell_queries, markov_queries, stats_queries, numeric_queries, more_queries, library_queries)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: v for m in MODULES for k, v in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {k: v for m in MODULES for k, v in m.SQL.items()}
