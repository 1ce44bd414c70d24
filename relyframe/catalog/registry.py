"""Named queries, each a Spark job with the SQL that must give the same rows."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from relyframe.catalog.views import VIEWS

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(fn: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = with_views(sql)
        return fn

    return add


def _used(text: str) -> list[str]:
    return [v for v in VIEWS if re.search(rf"\b{v}\b", text)]


def with_views(sql: str) -> str:
    """Prefix the views a statement names, in dependency order."""
    ordered: list[str] = []

    def visit(text: str) -> None:
        for v in _used(text):
            if v not in ordered:
                visit(VIEWS[v].replace(v, ""))
                if v not in ordered:
                    ordered.append(v)

    visit(sql)
    body = sql.strip()
    if not ordered:
        return body
    head = ", ".join(f"{v} AS ({VIEWS[v].strip()})" for v in ordered)
    own = re.match(r"WITH\s+(RECURSIVE\s+)?", body)
    if own:
        return f"WITH RECURSIVE {head}, {body[own.end():]}"
    return f"WITH RECURSIVE {head} {body}"


def r4(df: DataFrame, digits: int = 4) -> DataFrame:
    """Doubles at four decimals (and no negative zero), timestamps as text."""
    out = []
    for f in df.schema.fields:
        kind = f.dataType.typeName()
        c = F.col(f"`{f.name}`")
        if kind in ("double", "float"):
            c = F.round(c, digits) + F.lit(0.0)
        elif kind in ("timestamp", "timestamp_ntz", "date"):
            c = c.cast("string")
        out.append(c.alias(f.name))
    return df.select(*out)
