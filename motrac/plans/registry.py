"""A small registry that each module of queries fills."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def registry() -> tuple[dict, dict, Callable]:
    queries: dict = {}
    sql: dict[str, str] = {}

    def query(text: str | None = None) -> Callable:
        def add(f: Callable) -> Callable:
            queries[f.__name__] = f
            if text:
                sql[f.__name__] = text
            return f

        return add

    return queries, sql, query


def r(c: str | Column, digits: int = 6) -> Column:
    """Rounded, so that the order of sums does not show; negative zero as zero."""
    c = F.col(c) if isinstance(c, str) else c
    return F.round(c, digits) + F.lit(0.0)


def r_plain(c: str | Column, digits: int = 6) -> Column:
    """r for numbers of zero or more, half up, as the SQL does it, without a decimal number for each row; from 1e9 on r itself."""
    c = F.col(c) if isinstance(c, str) else c
    return F.when(c < 1e9, F.floor(c * 10.0**digits + 0.5) / 10.0**digits).otherwise(r(c, digits))


def r_signed(c: str | Column, digits: int = 6) -> Column:
    """r_plain for numbers of either sign; others than numbers go to r."""
    c = F.col(c) if isinstance(c, str) else c
    return F.when((c < 0) & (c > -1e9), -F.floor(-c * 10.0**digits + 0.5) / 10.0**digits).otherwise(r_plain(c, digits))
