"""Where queries and their SQL are registered."""

from __future__ import annotations

from pyspark.sql import functions as F

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(name: str, text: str | None = None):
    def add(f):
        QUERIES[name] = f
        if text:
            ORACLE_SQL[name] = text
        return f

    return add


def r9(x):
    return F.round(x, 9)
