"""Registered questions: each pairs a DataFrame query with the SQL that checks it."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from catalog.views_sql import VIEWS
from tapeloom.sources.views import Views

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def plain(df: DataFrame) -> DataFrame:
    """Decimals as doubles and timestamps as text, so both engines return the same values."""
    out = []
    for field in df.schema:
        column = F.col(f"`{field.name}`")
        if isinstance(field.dataType, T.DecimalType):
            column = column.cast("double")
        elif isinstance(field.dataType, (T.TimestampType, T.TimestampNTZType)):
            column = F.date_format(column, "yyyy-MM-dd HH:mm:ss")
        out.append(column.alias(field.name))
    return df.select(*out)


def with_views(sql: str) -> str:
    """Prefix a statement with the view definitions it mentions, in dependency order."""
    needed: list[str] = []

    def visit(text: str) -> None:
        for name in VIEWS:
            if name not in needed and re.search(rf"\b{name}\b", text):
                visit(VIEWS[name])
                if name not in needed:
                    needed.append(name)

    visit(sql)
    body = sql.strip()
    if not needed:
        return body
    views = ",\n".join(f"{n} AS ({VIEWS[n].strip()})" for n in needed)
    if body[:15].upper().startswith("WITH RECURSIVE"):
        return f"WITH RECURSIVE {views},\n{body[14:]}"
    if body[:5].upper() == "WITH ":
        return f"WITH {views},\n{body[5:]}"
    return f"WITH {views}\n{body}"


def query(name: str, sql: str | None = None) -> Callable:
    def register(fn: Callable[[Views], DataFrame]) -> Callable[[Views], DataFrame]:
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = lambda spark, folder: plain(fn(Views(spark, folder)))
        if sql is not None:
            ORACLES[name] = with_views(sql)
        return fn
    return register


def load() -> None:
    """Import every module that registers queries."""
    from catalog import aggregates, dedup, filters, joins, operations, publishing  # noqa: F401
    from catalog import market, pipelines, quality, ranking, scalars  # noqa: F401
