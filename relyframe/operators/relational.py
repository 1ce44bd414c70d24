"""Small relational building blocks shared by the reports."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from relyframe.operators.keyed import match
from relyframe.session import with_broadcast


def search_any_column(df: DataFrame, text: str) -> DataFrame:
    """Case-insensitive "contains" over every column."""
    hits = [F.lower(F.col(c).cast("string")).contains(text.lower()) for c in df.columns]
    return df.where(reduce(or_, [F.coalesce(h, F.lit(False)) for h in hits]))


def compare(value: Column, operator: Column, limit: Column) -> Column:
    """The comparison a rule names; an unknown operator is no match."""
    return (
        F.when(operator == ">", value > limit)
        .when(operator == "<", value < limit)
        .when(operator == ">=", value >= limit)
        .when(operator == "<=", value <= limit)
        .when(operator == "==", value == limit)
        .otherwise(F.lit(False))
    )


def page(df: DataFrame, order: list, skip: int, limit: int) -> DataFrame:
    return df.orderBy(*order).offset(skip).limit(limit)


def latest_per_key(df: DataFrame, keys: list[str], order: list) -> DataFrame:
    """First row of each key in the given order. Spark keeps one row per task and key."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


def share_of_total(counts: DataFrame, keys: list[str], count: str) -> DataFrame:
    """Each count over the total of its keys.

    Totals are one row per key and joined by a size-checked broadcast, so the
    counts keep their spread by value.
    """
    totals = with_broadcast(counts.groupBy(*keys).agg(F.sum(count).alias("_total")))
    return match(counts, totals, keys).withColumn("share", F.col(count) / F.col("_total")).drop("_total")


def most_common(df: DataFrame, keys: list[str], column: str) -> DataFrame:
    """The most frequent value per key, ties by value: counted first, then one max."""
    counted = df.where(F.col(column).isNotNull()).groupBy(*keys, column).agg(F.count(F.lit(1)).alias("cnt"))
    return latest_per_key(counted, keys, [F.desc("cnt"), F.asc(column)])


def numeric_names(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType)]


def common_columns(left: DataFrame, right: DataFrame) -> list[str]:
    return [c for c in left.columns if c in set(right.columns)]
