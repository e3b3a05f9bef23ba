"""The register of queries and their SQL twins."""

from __future__ import annotations

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a function (spark, sf_dir) -> DataFrame by its name, with the SQL that gives the same rows."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def rounded(column, digits: int = 6):
    """Rounded, without a negative zero."""
    from pyspark.sql import functions as F

    return F.round(column, digits) + F.lit(0.0)
