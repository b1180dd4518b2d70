"""The register of queries, each beside the SQL that gives the same rows in DuckDB, and what writing them takes."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources import readers

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Callable[..., DataFrame]], Query]:
    """Registers a function of a table reader under its own name, with its SQL if there is one."""

    def add(f: Callable[..., DataFrame]) -> Query:
        QUERIES[f.__name__] = lambda spark, sf_dir: f(lambda name: readers.table(spark, sf_dir, name))
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def _q(pattern: str) -> str:
    return "'" + pattern.replace("'", "''") + "'"


def _all(pattern: str, column: str = "text", group: int = 0) -> str:
    return f"regexp_extract_all({column}, {_q(pattern)}, {group})"


def _join(listed: str) -> str:
    return f"coalesce(array_to_string(list_sort(list_distinct({listed})), '|'), '')"


def labelled(lists: dict[str, F.Column]) -> F.Column:
    """All entries of the lists as kind and value."""

    def pairs(kind: str, values: F.Column) -> F.Column:
        return F.transform(values, lambda v: F.struct(F.lit(kind).alias("kind"), v.alias("value")))

    return F.flatten(F.array(*(pairs(k, v) for k, v in lists.items())))
