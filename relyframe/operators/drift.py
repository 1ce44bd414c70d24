"""Drift of every dataset version against its baseline version."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from relyframe.operators.profile import long_numbers, nan_to_null, numeric_columns, value_columns, value_counts
from relyframe.operators.keyed import match
from relyframe.operators.quantiles import exact_quantiles
from relyframe.session import with_broadcast

# Limits above which drift counts as medium and as high.
LIMITS = {
    "PSI": (0.10, 0.25),
    "DIST_DRIFT": (0.10, 0.25),
    "MEAN_SHIFT": (0.10, 0.25),
    "STD_SHIFT": (0.10, 0.25),
    "CARD_DRIFT": (0.10, 0.30),
}
BINS = 10
_EDGE = 1e-5
_EPS = 1e-4

DATASET, VERSION = "dataset_id", "version_number"


def pick_baselines(versions: DataFrame, registered: DataFrame | None = None, explicit: DataFrame | None = None) -> DataFrame:
    """Baseline per dataset: the one asked for, else the registered one, else the earliest."""
    out = versions.groupBy(DATASET).agg(F.min(VERSION).alias("_first"))
    choice = [F.col("_first")]
    if registered is not None:
        out = out.join(registered.select(DATASET, F.col("baseline_version").alias("_reg")), DATASET, "left")
        choice.insert(0, F.col("_reg"))
    if explicit is not None:
        out = out.join(explicit.select(DATASET, F.col("baseline_version").alias("_ask")), DATASET, "left")
        choice.insert(0, F.col("_ask"))
    return out.select(DATASET, F.coalesce(*choice).alias("baseline_version"))


def severity(metric: Column, score: Column) -> Column:
    out = F.lit("LOW")
    for names, (low, high) in (
        (("PSI", "DIST_DRIFT", "MEAN_SHIFT", "STD_SHIFT"), LIMITS["PSI"]),
        (("CARD_DRIFT",), LIMITS["CARD_DRIFT"]),
    ):
        hit = metric.isin(*names)
        out = F.when(hit & (score > high), "HIGH").when(hit & (score > low), "MEDIUM").otherwise(out)
    return out


def bin_edges(base_rows: DataFrame, by: list[str]) -> DataFrame:
    """Decile edges of the baseline without repeats, both ends pushed out a little."""
    q = exact_quantiles(base_rows, by, "value", [i / BINS for i in range(BINS + 1)])
    e = q.select(*by, F.array_sort(F.array_distinct("q")).alias("e"))
    last = F.size("e") - 1
    moved = F.transform(
        "e",
        lambda x, i: F.when(i == 0, x - _EDGE).when(i == last, x + _EDGE).otherwise(x),
    )
    return e.where("size(e) >= 2").select(*by, moved.alias("edges"))


def bin_of(value: Column, edges: Column) -> Column:
    """Index of the half-open bin holding the value, the last bin closed; NULL outside."""
    at_or_below = sum(F.coalesce((value >= F.get(edges, F.lit(i))).cast("int"), F.lit(0)) for i in range(BINS + 1))
    top = F.element_at(edges, -1)
    return F.when(value == top, F.size(edges) - 2).when(
        (value >= F.get(edges, F.lit(0))) & (value < top), at_or_below - 1
    )


def histogram(rows: DataFrame, edges: DataFrame, by: list[str], group: list[str]) -> DataFrame:
    """Counts per bin (zero where a bin is empty) and the number of rows, per group."""
    placed = match(rows, edges, by).withColumn("_b", bin_of(F.col("value"), F.col("edges")))
    wide = placed.groupBy(*group, "edges").agg(
        F.count(F.lit(1)).alias("total"), *[F.count_if(F.col("_b") == i).alias(f"b{i}") for i in range(BINS)]
    )
    return wide.select(
        *group, "total", F.slice(F.array(*[f"b{i}" for i in range(BINS)]), 1, F.size("edges") - 1).alias("counts")
    )


def add_psi(df: DataFrame, base: str, base_n: str, targ: str, targ_n: str) -> DataFrame:
    """Column ``psi``: Σ (t−b)·ln(t/b) over the smoothed, re-normalised bin shares."""
    plus = lambda a, x: a + x
    smooth = lambda counts, n: F.transform(counts, lambda c: c / F.col(n) + _EPS)
    df = df.withColumns({"_bs": smooth(base, base_n), "_ts": smooth(targ, targ_n)})
    df = df.withColumns(
        {"_bt": F.aggregate("_bs", F.lit(0.0), plus), "_tt": F.aggregate("_ts", F.lit(0.0), plus)}
    )
    terms = F.zip_with(
        F.transform("_bs", lambda x: x / F.col("_bt")),
        F.transform("_ts", lambda x: x / F.col("_tt")),
        lambda b, t: (t - b) * F.ln(t / b),
    )
    return df.withColumn("psi", F.aggregate(terms, F.lit(0.0), plus)).drop("_bs", "_ts", "_bt", "_tt")


def numeric_drift(df: DataFrame, baselines: DataFrame, cols: list[str]) -> DataFrame:
    """PSI, mean shift and deviation shift for every version but the baseline."""
    by, group = [DATASET, "column_name"], [DATASET, VERSION, "column_name"]
    rows = long_numbers(df, [DATASET, VERSION], cols)
    base_rows = match(rows, baselines, [DATASET]).where(F.col(VERSION) == F.col("baseline_version"))
    edges = with_broadcast(bin_edges(base_rows, by))
    # One pass gives moments and bin counts of the baseline and all targets.
    placed = match(rows, edges, by, "left").withColumn("_b", bin_of(F.col("value"), F.col("edges")))
    stats = placed.groupBy(*group).agg(
        F.count(F.lit(1)).alias("n"),
        F.avg("value").alias("mean"),
        F.stddev_samp("value").alias("std"),
        F.max(F.size("edges")).alias("edge_count"),
        F.array(*[F.count_if(F.col("_b") == i) for i in range(BINS)]).alias("counts"),
    )
    stats = match(with_broadcast(stats), baselines, [DATASET])
    base = stats.where(F.col(VERSION) == F.col("baseline_version")).select(
        *by, *[F.col(c).alias(f"b_{c}") for c in ("n", "mean", "std", "counts")]
    )
    pair = stats.where(F.col(VERSION) != F.col("baseline_version"))
    pair = match(pair, base, by)
    bins = F.greatest(F.coalesce("edge_count", F.lit(0)) - 1, F.lit(0))
    pair = pair.withColumns({"_b": F.slice("b_counts", F.lit(1), bins), "_t": F.slice("counts", F.lit(1), bins)})
    pair = add_psi(pair, "_b", "b_n", "_t", "n")  # no bins: an empty sum, 0
    b_std = F.when(F.col("b_std") > 0, F.col("b_std")).otherwise(F.lit(1.0))
    b_mean = F.when(F.col("b_mean") != 0, F.abs("b_mean")).otherwise(F.lit(1.0))
    found = {
        "PSI": F.col("psi"),
        "MEAN_SHIFT": F.abs(F.col("mean") - F.col("b_mean")) / b_mean,
        "STD_SHIFT": F.abs(F.coalesce("std", F.lit(0.0)) - b_std) / b_std,
    }
    return _metric_rows(pair, found)


def text_drift(df: DataFrame, baselines: DataFrame, cols: list[str]) -> DataFrame:
    """Share difference and change in distinct values for every version but the baseline.

    Values are counted once. Each then looks up its baseline share among the
    versions of the same value, so hot groups stay spread by value. Values only
    the baseline has need no outer join: their total share is one minus the
    baseline share of the values both sides have.
    """
    by, group = [DATASET, "column_name"], [DATASET, VERSION, "column_name"]
    filled = df.groupBy(DATASET, VERSION).agg(*[F.count(c).alias(c) for c in cols])
    totals = with_broadcast(filled.unpivot([DATASET, VERSION], cols, "column_name", "total").where("total > 0"))
    counts = match(match(value_counts(df, [DATASET, VERSION], cols), totals, group), baselines, [DATASET])
    is_base = F.col(VERSION) == F.col("baseline_version")
    share = F.col("cnt") / F.col("total")
    same_value = Window.partitionBy(*by, "value")
    shares = counts.select(*group, "value", is_base.alias("is_base"), share.alias("p")).withColumn(
        "bp", F.coalesce(F.max(F.when(F.col("is_base"), F.col("p"))).over(same_value), F.lit(0.0))
    )
    stats = with_broadcast(
        shares.groupBy(*group, "is_base").agg(
            (F.sum(F.abs(F.col("p") - F.col("bp"))) + 1 - F.sum("bp")).alias("total_diff"),
            F.count(F.lit(1)).alias("card"),
        )
    )
    base = stats.where("is_base").select(*by, F.col("card").alias("b_card"))
    pair = match(stats.where("NOT is_base"), base, by)
    found = {
        "DIST_DRIFT": F.least(F.greatest(F.col("total_diff"), F.lit(0.0)) / 2, F.lit(1.0)),
        "CARD_DRIFT": F.abs(F.col("card") - F.col("b_card")) / F.greatest(F.col("b_card"), F.lit(1)),
    }
    return _metric_rows(pair, found)


def _metric_rows(pair: DataFrame, found: dict[str, Column]) -> DataFrame:
    each = F.array(
        *[F.struct(F.lit(m).alias("drift_metric"), c.cast("double").alias("drift_score")) for m, c in found.items()]
    )
    return (
        pair.select(DATASET, VERSION, "column_name", F.explode(each).alias("e"))
        .select(DATASET, VERSION, "column_name", "e.*")
        .withColumn("severity", severity(F.col("drift_metric"), F.col("drift_score")))
    )


def calculate_drift(df: DataFrame, baselines: DataFrame) -> DataFrame:
    """All drift figures per (dataset, version, column)."""
    df = nan_to_null(df)
    baselines = with_broadcast(baselines)
    keys = [DATASET, VERSION]
    numeric = numeric_columns(df, keys)
    text = [c for c in value_columns(df, keys) if c not in numeric]
    parts = []
    if numeric:
        parts.append(numeric_drift(df, baselines, numeric))
    if text:
        parts.append(text_drift(df, baselines, text))
    return reduce(DataFrame.unionByName, parts)


def overall_drift(results: DataFrame) -> DataFrame:
    """Mean of the capped PSI and share-difference scores of each version."""
    return (
        results.where(F.col("drift_metric").isin("PSI", "DIST_DRIFT"))
        .groupBy(DATASET, VERSION)
        .agg(F.avg(F.least("drift_score", F.lit(1.0))).alias("overall_drift_score"))
    )
