"""Queries by name, each with the SQL that a second engine runs."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..functions.rules import Rules, re

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


def sql_case(rules: Rules, otherwise: str | None = None, **names: str) -> str:
    """A rule table as CASE text for the second engine."""
    end = "NULL" if otherwise is None else f"'{otherwise}'"
    text = "CASE " + " ".join(f"WHEN {c} THEN '{r}'" for r, c in rules) + f" ELSE {end} END"
    text = re.sub(r"\brx\((\w+), ", r"regexp_matches(\1, ", text)
    for k, v in names.items():
        text = re.sub(rf"(?<![\w'\\])\b{k}\b(?= (?:LIKE|IN|=|AND|OR|THEN)|, ')", lambda _, v=v: v, text)
    return text
