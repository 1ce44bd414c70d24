"""Exact quantiles, ranks and previous rows that never gather a group in one task.

There is one route for every size. Rows (for quantiles: distinct values around
the wanted ranks, and spans between them, with their counts) are range partitioned by group and order and stored; each range
is numbered by itself and shifted by the totals of the ranges before it, one
small row per group and range. A hot group is spread over as many ranges as it
needs, a value that repeats is one row, and NULL is a group like any other.
The number of ranges is ``spark.sql.shuffle.partitions``, which adaptive
execution merges by bytes.
"""

from __future__ import annotations

from functools import reduce
from operator import add, or_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from relyframe.operators.keyed import match
from relyframe.session import settle, with_broadcast


# The sample that brackets quantiles, and the margins in ranks: the smallest that is five deviations of the sample's ranks.
_SHARE, _SEED = 1 / 16, 42
_MARGINS = (0.064, 0.032, 0.016, 0.008, 0.004)


def _ranges(df: DataFrame, keys: list[str], order: list) -> DataFrame:
    """The rows in stored ranges, ``_p`` ascending with the order inside each group."""
    return settle(df.repartitionByRange(*[F.col(k) for k in keys], *order).withColumn("_p", F.spark_partition_id()))


def _shifts(ranged: DataFrame, keys: list[str], weight: Column) -> DataFrame:
    """Per group and range: rows in it (``_here``), before it (``_before``) and in the group (``n``)."""
    group = Window.partitionBy(*keys)
    before = group.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    here = ranged.groupBy(*keys, "_p").agg(F.sum(weight).alias("_here"))
    return here.withColumns({"_before": F.coalesce(F.sum("_here").over(before), F.lit(0)), "n": F.sum("_here").over(group)})


def _brackets(rows: DataFrame, keys: list[str], probs: list[float]) -> DataFrame:
    """Values ``_lo`` and ``_hi`` around each quantile, five deviations of a sample's ranks apart from it; no row for small groups."""
    cuts = [min(max(p + side * m, 0.0), 1.0) for m in _MARGINS for side in (-1, 1) for p in probs]
    some = rows.where(F.rand(_SEED) < _SHARE).groupBy(*keys).agg(F.count(F.lit(1)).alias("_m"), F.percentile_approx("_v", cuts, 10_000).alias("_s"))
    edges = {}
    for name, side, far in (("_lo", -1, float("-inf")), ("_hi", 1, float("inf"))):
        choice = F.lit(None)
        for j, m in enumerate(_MARGINS):
            at = (2 * j + (side > 0)) * len(probs)
            edge = F.array(*[F.get("_s", F.lit(at + i)) if 0 < p + side * m < 1 else F.lit(far) for i, p in enumerate(probs)])
            choice = F.when(F.col("_m") >= (2.5 / m) ** 2, edge).otherwise(choice)
        edges[name] = choice
    return some.select(*keys, *[c.alias(n) for n, c in edges.items()]).where("_lo IS NOT NULL")


def _narrowed(rows: DataFrame, keys: list[str], probs: list[float]) -> DataFrame:
    """Rows (keys, ``_v``, ``_to``, ``_c``): values around the wanted quantiles one by one, all others as the spans between them.

    Brackets of a sample only choose which values stay apart; all rows are counted.
    """
    bounds, v = with_broadcast(_brackets(rows, keys, probs)), F.col("_v")
    lo, hi = ([F.get(c, F.lit(i)) for i in range(len(probs))] for c in ("_lo", "_hi"))
    inside = F.col("_lo").isNull() | reduce(or_, [(v >= a) & (v <= z) for a, z in zip(lo, hi)])
    passed = reduce(add, [F.when(v > z, 1).otherwise(0) for z in hi])
    spans = match(rows, bounds, keys, "left").select(*keys, "_v", passed.alias("_span"), F.when(inside, v).alias("_own"))
    counted = spans.groupBy(*keys, "_span", "_own").agg(F.min("_v").alias("_v"), F.max("_v").alias("_to"), F.count(F.lit(1)).alias("_c"))
    return counted.select(*keys, "_v", "_to", "_c")


def exact_quantiles(rows: DataFrame, keys: list[str], value: str, probs: list[float]) -> DataFrame:
    """Linear-interpolated quantiles of the non-null values of each group.

    Returns ``keys``, ``n`` and ``q``, an array in the order of ``probs``. Only
    the ranges that hold a wanted rank are numbered. If a wanted rank fell into
    a span between the values that were kept, all values are counted instead.
    """
    whole = not keys
    if whole:
        rows, keys = rows.withColumn("_all", F.lit(0)), ["_all"]
    rows = rows.select(*keys, F.col(value).cast("double").alias("_v")).where("_v IS NOT NULL AND NOT isnan(_v)")
    found = settle(_at_ranks(_narrowed(rows, keys, probs), keys, probs))
    if found.where("NOT _exact").take(1):
        counted = rows.groupBy(*keys, "_v").agg(F.col("_v").alias("_to"), F.count(F.lit(1)).alias("_c"))
        found = _at_ranks(counted, keys, probs)
    found = found.drop("_exact")
    return found.drop("_all") if whole else found


def _at_ranks(counted: DataFrame, keys: list[str], probs: list[float]) -> DataFrame:
    """The quantiles from counted values; ``_exact`` is false where a wanted rank lies in a span of several values."""
    ranged = _ranges(counted, keys, [F.col("_v")])
    wanted = [(i, up, fn(F.lit(float(p)) * (F.col("n") - 1))) for i, p in enumerate(probs) for up, fn in ((0, F.floor), (1, F.ceil))]
    within = lambda lo, hi: reduce(or_, [(r >= lo) & (r < hi) for _, _, r in wanted])
    shifts = _shifts(ranged, keys, F.col("_c")).where(within(F.col("_before"), F.col("_before") + F.col("_here")))
    upto = F.sum("_c").over(Window.partitionBy(*keys, "_p").orderBy("_v").rowsBetween(Window.unboundedPreceding, 0)) + F.col("_before")
    placed = match(ranged, with_broadcast(shifts), [*keys, "_p"]).withColumn("_upto", upto)
    lo, hi = F.col("_upto") - F.col("_c"), F.col("_upto")
    held = placed.where(within(lo, hi))

    at = {(i, up): F.max(F.when((r >= lo) & (r < hi), F.col("_v"))) for i, up, r in wanted}
    out = []
    for i, p in enumerate(probs):
        pos = F.lit(float(p)) * (F.max("n") - 1)
        out.append(at[i, 0] + (at[i, 1] - at[i, 0]) * (pos - F.floor(pos)))
    return held.groupBy(*keys).agg(F.max("n").alias("n"), F.array(*out).alias("q"), F.bool_and(F.col("_v") == F.col("_to")).alias("_exact"))


def rank_in_groups(df: DataFrame, keys: list[str], order: list, name: str = "rank") -> DataFrame:
    """Row numbers 1..n (bigint) per group in the given order, which must be total."""
    ranged = _ranges(df, keys, order)
    shifts = with_broadcast(_shifts(ranged, keys, F.lit(1)).select(*keys, "_p", "_before"))
    local = F.row_number().over(Window.partitionBy(*keys, "_p").orderBy(*order))
    return match(ranged, shifts, [*keys, "_p"]).withColumn(name, local + F.col("_before")).drop("_p", "_before")


def previous_in_groups(df: DataFrame, keys: list[str], order: list, value: str, name: str, default=None) -> DataFrame:
    """``value`` of the row before, per group and order; ``default`` where there is none.

    Inside a range the row before is at hand; the first row of a range takes
    the last value of the range before it in its group.
    """
    ranged = _ranges(df, keys, order)
    local = Window.partitionBy(*keys, "_p").orderBy(*order)
    placed = ranged.withColumns({"_first": F.row_number().over(local) == 1, "_last": F.lead(F.lit(1)).over(local).isNull(), name: F.lag(value).over(local)})
    group = Window.partitionBy(*keys).orderBy("_p")
    ends = placed.where("_last").select(*keys, "_p", F.col(value).alias("_end"))
    edges = with_broadcast(ends.select(*keys, "_p", F.lag(F.struct("_end")).over(group).alias("_edge")))
    found = match(placed, edges, [*keys, "_p"])
    start = F.when(F.col("_edge").isNotNull(), F.col("_edge._end")).otherwise(F.lit(default))
    return found.withColumn(name, F.when(F.col("_first"), start).otherwise(F.col(name))).drop("_p", "_first", "_last", "_edge")
