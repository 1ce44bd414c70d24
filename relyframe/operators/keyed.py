"""Joins on group keys in which NULL is a group of its own, as it is for groupBy and windows."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def match(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Join on equal keys, NULL equal to NULL; the keys of ``left`` stay. Without keys, ``right`` must be one row.

    Spark turns the null-safe comparison into plain equality on a default and
    a null flag, so it is hashed, sorted and broadcast like any other join.
    """
    names = {k: f"_same_{k}" for k in keys}
    pairs = [F.col(f"`{k}`").eqNullSafe(F.col(f"`{n}`")) for k, n in names.items()]
    out = left.join(right.withColumnsRenamed(names), reduce(and_, pairs, F.lit(True)), how)
    return out if how in ("left_semi", "left_anti") else out.drop(*names.values())
