"""Column and table profiles for every dataset version in one job."""

from __future__ import annotations

from functools import reduce
from operator import add

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from relyframe.operators.keyed import match
from relyframe.operators.quantiles import exact_quantiles
from relyframe.session import with_broadcast

TOP_VALUES = 10


def named(name: str) -> Column:
    """A column by its exact name, dots and quotes included."""
    return F.col(quoted(name))


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def percent(part: Column, whole: Column) -> Column:
    return F.when(whole > 0, part * F.lit(100.0) / whole).otherwise(F.lit(0.0))


def nan_to_null(df: DataFrame) -> DataFrame:
    """Missing numbers have one form from here on."""
    return df.select(
        *[
            F.nanvl(named(f.name), F.lit(None).cast(f.dataType)).alias(f.name)
            if isinstance(f.dataType, (T.DoubleType, T.FloatType))
            else named(f.name)
            for f in df.schema.fields
        ]
    )


def numeric_columns(df: DataFrame, skip: list[str]) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType) and f.name not in skip]


def value_columns(df: DataFrame, skip: list[str]) -> list[str]:
    return [c for c in df.columns if c not in skip]


def long_numbers(df: DataFrame, keep: list[str], cols: list[str]) -> DataFrame:
    """One row per numeric cell: ``keep``, ``column_name``, ``value``; nulls dropped."""
    wide = df.select(*keep, *[named(c).cast("double").alias(c) for c in cols])
    return wide.unpivot(keep, [named(c) for c in cols], "column_name", "value").where("value IS NOT NULL AND NOT isnan(value)")


def long_text(df: DataFrame, keep: list[str], cols: list[str]) -> DataFrame:
    """One row per cell as text; nulls dropped."""
    wide = df.select(*keep, *[named(c).cast("string").alias(c) for c in cols])
    return wide.unpivot(keep, [named(c) for c in cols], "column_name", "value").where("value IS NOT NULL")


def table_summary(df: DataFrame, keys: list[str]) -> DataFrame:
    """Row, column, duplicate and missing-cell figures per group.

    Rows beyond the first of each set of identical rows are duplicates (nulls
    are equal). Grouping by the whole row combines copies before the shuffle,
    so one very frequent row costs one record per task; the same grouped rows
    also give the missing cells.
    """
    df = nan_to_null(df)
    cols = value_columns(df, keys)
    nulls = reduce(add, [F.when(named(c).isNull(), 1).otherwise(0) for c in cols])
    same = df.groupBy(*[named(c) for c in df.columns]).agg(F.count(F.lit(1)).alias("_c"))
    total = F.col("row_count") * len(cols)
    return (
        same.groupBy(*keys)
        .agg(
            F.coalesce(F.sum("_c"), F.lit(0)).alias("row_count"),
            F.coalesce(F.sum(F.col("_c") - 1), F.lit(0)).alias("duplicate_rows_count"),
            F.coalesce(F.sum(F.col("_c") * nulls), F.lit(0)).alias("missing_cells_count"),
        )
        .select(
            *keys,
            "row_count",
            F.lit(len(cols)).alias("column_count"),
            "duplicate_rows_count",
            percent(F.col("duplicate_rows_count"), F.col("row_count")).alias("duplicate_rows_percent"),
            total.alias("total_cells"),
            "missing_cells_count",
            percent(F.col("missing_cells_count"), total).alias("missing_cells_percent"),
        )
    )


def column_stats(df: DataFrame, keys: list[str]) -> DataFrame:
    """Null count and, for numbers, min / max / mean / std: one pass, no row blow-up."""
    df = nan_to_null(df)
    cols = value_columns(df, keys)
    numeric = set(numeric_columns(df, keys))
    aggs = ["count(1) AS row_count"]
    for c in cols:
        q = quoted(c)
        text = c.replace("\\", "\\\\").replace("'", "\\'")
        figures = dict.fromkeys(("min", "max", "mean", "std"), "double(NULL)")
        if c in numeric:
            figures = {
                "min": f"min(double({q}))",
                "max": f"max(double({q}))",
                "mean": f"avg(double({q}))",
                "std": f"CASE WHEN count({q}) = 0 THEN NULL WHEN count({q}) < 2 THEN 0D ELSE stddev_samp(double({q})) END",
            }
        fields = {
            "column_name": f"'{text}'",
            "missing_count": f"count_if({q} IS NULL)",
            "is_numeric": str(c in numeric).lower(),
            **figures,
        }
        body = ", ".join(f"'{n}', {e}" for n, e in fields.items())
        aggs.append(f"named_struct({body}) AS {q}")
    wide = df.groupBy(*keys).agg(*[F.expr(a) for a in aggs])
    each = F.explode(F.array(*[named(c) for c in cols])).alias("e")
    return wide.select(*keys, "row_count", each).select(
        *keys, "row_count", "e.*", percent(F.col("e.missing_count"), F.col("row_count")).alias("missing_percent")
    )


def value_counts(df: DataFrame, keys: list[str], cols: list[str]) -> DataFrame:
    """How often each value occurs; copies combine before the shuffle."""
    return long_text(df, keys, cols).groupBy(*keys, "column_name", "value").agg(F.count(F.lit(1)).alias("cnt"))


def _families(df: DataFrame, cols: list[str]) -> list[tuple[str, list[str]]]:
    """Columns by the type their values are compared in; numbers are not turned to text."""
    kinds: dict[str, list[str]] = {}
    for c in cols:
        t = df.schema[c].dataType
        kind = "bigint" if isinstance(t, T.IntegralType) else "double" if isinstance(t, (T.DoubleType, T.FloatType)) else "string"
        kinds.setdefault(kind, []).append(c)
    return list(kinds.items())


def distinct_counts(df: DataFrame, keys: list[str], cols: list[str], approximate: bool = False) -> DataFrame:
    """Non-null distinct values per column.

    Long form keeps many columns in one shuffle, keyed by group and value, so
    a hot group is spread by its values.
    """
    df = nan_to_null(df.select(*keys, *[named(c) for c in cols]))
    by, parts = [*keys, "column_name"], []
    for kind, names in _families(df, cols):
        wide = df.select(*keys, *[named(c).cast(kind).alias(c) for c in names])
        rows = wide.unpivot(keys, [named(c) for c in names], "column_name", "value").where("value IS NOT NULL")
        if approximate:
            parts.append(rows.groupBy(*by).agg(F.approx_count_distinct("value").alias("unique_count")))
        else:
            parts.append(rows.distinct().groupBy(*by).agg(F.count(F.lit(1)).alias("unique_count")))
    return reduce(DataFrame.unionByName, parts)


def top_values(counts: DataFrame, keys: list[str], k: int = TOP_VALUES) -> DataFrame:
    """The k most frequent values. Spark limits each task to k rows before the shuffle."""
    w = Window.partitionBy(*keys, "column_name").orderBy(F.desc("cnt"), F.asc("value"))
    return counts.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def iqr_bounds(df: DataFrame, keys: list[str], cols: list[str]) -> DataFrame:
    """Quartiles, median and the 1.5-IQR fence of each numeric column."""
    by = [*keys, "column_name"]
    q = exact_quantiles(long_numbers(df, keys, cols), by, "value", [0.25, 0.5, 0.75])
    p25, p50, p75 = (F.get("q", F.lit(i)) for i in range(3))
    iqr = p75 - p25
    return q.select(
        *by,
        "n",
        p25.alias("p25"),
        p50.alias("median"),
        p75.alias("p75"),
        iqr.alias("iqr"),
        (p25 - 1.5 * iqr).alias("lower_bound"),
        (p75 + 1.5 * iqr).alias("upper_bound"),
    )


def outlier_counts(df: DataFrame, keys: list[str], cols: list[str], bounds: DataFrame | None = None) -> DataFrame:
    """Quartile table with the number of values outside the fence."""
    by = [*keys, "column_name"]
    bounds = with_broadcast(iqr_bounds(df, keys, cols) if bounds is None else bounds)
    outside = (F.col("value") < F.col("lower_bound")) | (F.col("value") > F.col("upper_bound"))
    counted = (
        match(long_numbers(df, keys, cols), bounds.select(*by, "lower_bound", "upper_bound"), by)
        .groupBy(*by)
        .agg(F.count_if(outside).alias("outlier_count"))
    )
    return match(bounds, counted, by)


def profile(df: DataFrame, keys: list[str]) -> DataFrame:
    """Full column profile: counts, spread, quartiles, outliers and top values."""
    df = nan_to_null(df)
    cols = value_columns(df, keys)
    numeric = numeric_columns(df, keys)
    by = [*keys, "column_name"]
    text = [c for c in cols if c not in numeric]
    unique = distinct_counts(df, keys, cols)
    tops = (
        top_values(value_counts(df, keys, text or cols[:1]).where(F.lit(bool(text))), keys)
        .groupBy(*by)
        .agg(F.sort_array(F.collect_list(F.struct("rank", "value", "cnt"))).alias("t"))
        .select(*by, F.transform("t", lambda r: F.concat(r["value"], F.lit("="), r["cnt"])).alias("t"))
        .select(*by, F.array_join("t", "|").alias("top_values"))
    )
    out = match(match(column_stats(df, keys), unique, by, "left"), tops, by, "left")
    if numeric:
        out = match(out, outlier_counts(df, keys, numeric), by, "left")
    else:
        none = F.lit(None).cast("double")
        out = out.select("*", *[none.alias(c) for c in ("p25", "median", "p75")], none.cast("bigint").alias("outlier_count"))
    return out.select(
        *by,
        "is_numeric",
        "row_count",
        "missing_count",
        "missing_percent",
        F.coalesce("unique_count", F.lit(0)).alias("unique_count"),
        percent(F.coalesce("unique_count", F.lit(0)), F.col("row_count")).alias("unique_percent"),
        "min",
        "max",
        "mean",
        "median",
        "std",
        "p25",
        "p75",
        F.when(F.col("is_numeric"), F.coalesce("outlier_count", F.lit(0))).alias("outlier_count"),
        "top_values",
    )


def impute_median(df: DataFrame, keys: list[str], cols: list[str]) -> DataFrame:
    """Numeric nulls become the exact column median of the group, else 0.

    One cheap pass first finds the columns that have nulls at all.
    """
    df = nan_to_null(df)
    keep = [c for c in df.columns if c not in cols]
    gaps = df.agg(*[F.max(F.col(c).isNull()).alias(c) for c in cols]).first()
    holes = [c for c in cols if gaps[c]]
    if not holes:
        return df.select(*keep, *[F.col(c).cast("double").alias(c) for c in cols])
    by = [*keys, "column_name"]
    med = exact_quantiles(long_numbers(df, keys, holes), by, "value", [0.5]).select(*by, F.get("q", F.lit(0)).alias("m"))
    wide = med.groupBy(*keys).agg(*[F.max(F.when(F.col("column_name") == c, F.col("m"))).alias(f"_m_{c}") for c in holes])
    if keys:
        joined = match(df, with_broadcast(wide), keys, "left")
    else:  # one row of medians for the whole table
        one = wide.first() or [None] * len(holes)
        joined = df.select("*", *[F.lit(m).cast("double").alias(f"_m_{c}") for c, m in zip(holes, one)])
    fill = {c: F.coalesce(F.col(c).cast("double"), F.col(f"_m_{c}"), F.lit(0.0)) for c in holes}
    return joined.select(*keep, *[fill.get(c, F.col(c).cast("double")).alias(c) for c in cols])
