"""Schemas as rows: inference, hashes, changes, semantic classes, comparison."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from relyframe.operators.keyed import match
from relyframe.operators.profile import long_text, percent, value_columns

KEYS = ["dataset_id", "version_number"]

# Words in a column name and the class they stand for, first match wins.
NAME_CLASSES = [
    (["id"], "IDENTIFIER", "NONE", "Unique database identifier or foreign reference key."),
    (["email"], "PII", "EMAIL", "Personally identifiable email address contact field."),
    (["phone", "mobile"], "PII", "PHONE", "Personally identifiable telephone contact field."),
    (["name"], "PII", "NAME", "Personally identifiable name descriptor."),
    (["address"], "PII", "ADDRESS", "Personally identifiable postal street address."),
    (["ip"], "PII", "IP", "Network server Internet Protocol address."),
    (
        ["revenue", "amount", "price", "sales", "cost", "salary"],
        "FINANCIAL",
        "NONE",
        "Corporate financial ledger metric currency value.",
    ),
    (
        ["country", "city", "state", "zip", "region", "postal"],
        "GEOGRAPHY",
        "NONE",
        "Geographical territorial location metadata.",
    ),
    (
        ["date", "time", "created", "updated", "timestamp"],
        "TEMPORAL",
        "NONE",
        "Temporal transaction audit log datetime marker.",
    ),
]

_INTEGER = r"^[+-]?[0-9]+$"
_DECIMAL = r"^[+-]?([0-9]+[.]?[0-9]*|[.][0-9]+)([eE][+-]?[0-9]+)?$"
_BOOLEAN = r"^(True|False|TRUE|FALSE|true|false)$"


def infer_types(df: DataFrame, keys: list[str]) -> DataFrame:
    """Column types of each group from the text of its values.

    Whole numbers without gaps are int64, numbers float64, true/false bool,
    anything else object. A column with no value in a group is not part of
    that group's schema.
    """
    cols = value_columns(df, keys)
    rows = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("row_count"))
    v = F.col("value")
    kinds = long_text(df, keys, cols).groupBy(*keys, "column_name").agg(
        F.count(F.lit(1)).alias("filled"),
        F.bool_and(v.rlike(_INTEGER)).alias("ints"),
        F.bool_and(v.rlike(_DECIMAL)).alias("nums"),
        F.bool_and(v.rlike(_BOOLEAN)).alias("bools"),
    )
    full = F.col("filled") == F.col("row_count")
    return match(kinds, rows, keys).select(
        *keys,
        "column_name",
        F.when(F.col("ints") & full, "int64")
        .when(F.col("nums"), "float64")
        .when(F.col("bools") & full, "bool")
        .otherwise("object")
        .alias("data_type"),
    )


def declared_types(df: DataFrame, keys: list[str]) -> DataFrame:
    """Schema rows of a typed table: its columns for each group it holds."""
    cols = [f for f in df.schema.fields if f.name not in keys]
    each = F.array(
        *[F.struct(F.lit(f.name).alias("column_name"), F.lit(f.dataType.simpleString()).alias("data_type")) for f in cols]
    )
    return df.select(*keys).distinct().select(*keys, F.explode(each).alias("e")).select(*keys, "e.*")


def schema_hash(schema: DataFrame, keys: list[str]) -> DataFrame:
    """MD5 of the sorted name: type pairs written as one JSON object."""
    pair = F.concat(F.lit('"'), F.col("column_name"), F.lit('": "'), F.col("data_type"), F.lit('"'))
    body = F.concat_ws(", ", F.sort_array(F.collect_set(pair)))
    return schema.groupBy(*keys).agg(F.md5(F.concat(F.lit("{"), body, F.lit("}"))).alias("schema_hash"))


def previous_versions(versions: DataFrame) -> DataFrame:
    """Each version with the greatest smaller version number of its dataset."""
    w = Window.partitionBy("dataset_id").orderBy("version_number")
    return versions.select(*KEYS).distinct().withColumn("previous_version", F.lag("version_number").over(w))


def schema_changes(schema: DataFrame) -> DataFrame:
    """Columns added, removed or retyped since the previous version."""
    order = previous_versions(schema).where("previous_version IS NOT NULL")
    now = schema.join(order, KEYS).select("dataset_id", "version_number", "column_name", F.col("data_type").alias("new_value"))
    before = schema.withColumnRenamed("version_number", "previous_version").join(
        order, ["dataset_id", "previous_version"]
    ).select("dataset_id", "version_number", "column_name", F.col("data_type").alias("old_value"))
    both = now.join(before, [*KEYS, "column_name"], "full")
    old, new = F.col("old_value"), F.col("new_value")
    kind = F.when(old.isNull(), "ADDED").when(new.isNull(), "REMOVED").when(old != new, "TYPE_CHANGE")
    return (
        both.withColumn("change_type", kind)
        .where("change_type IS NOT NULL")
        .select(*KEYS, "column_name", "change_type", "old_value", "new_value", (F.col("change_type") != "ADDED").alias("is_breaking"))
    )


def _by_name(name: Column, pick, otherwise: Column) -> Column:
    low = F.lower(name)
    out = otherwise
    for entry in reversed(NAME_CLASSES):
        hit = None
        for w in entry[0]:
            hit = low.contains(w) if hit is None else hit | low.contains(w)
        out = F.when(hit, F.lit(pick(entry))).otherwise(out)
    return out


def semantic_catalog(schema: DataFrame) -> DataFrame:
    """Class, personal-data kind and meaning of each column, from its name."""
    name = F.col("column_name")
    plain = F.concat(F.lit("Column containing raw "), name, F.lit(" values."))
    return schema.select(
        "*",
        _by_name(name, lambda e: e[1], F.lit("QUANTITY")).alias("semantic_type"),
        _by_name(name, lambda e: e[2], F.lit("NONE")).alias("pii_class"),
        _by_name(name, lambda e: e[3], plain).alias("meaning"),
    )


def sensitivity(catalog: DataFrame, prior: DataFrame | None = None) -> DataFrame:
    """CONFIDENTIAL once any column is personal data; a prior level is never lowered."""
    now = catalog.groupBy("dataset_id").agg(
        F.bool_or(F.col("semantic_type") == "PII").alias("has_pii"),
        F.count_if(F.col("semantic_type") == "PII").alias("pii_columns"),
    )
    level = F.when(F.col("has_pii"), "CONFIDENTIAL")
    if prior is not None:
        now = now.join(prior.select("dataset_id", F.col("sensitivity_level").alias("_old")), "dataset_id", "left")
        level = level.when(F.col("_old") == "CONFIDENTIAL", "CONFIDENTIAL")
    return now.select("dataset_id", "pii_columns", level.otherwise("PUBLIC").alias("sensitivity_level"))


def present_summary(stats: DataFrame, schema: DataFrame) -> DataFrame:
    """Rows, columns and missing cells of each version over the columns it has.

    ``stats``: row_count and missing_count per version and column; ``schema``:
    the columns of each version. Versions share one wide table, in which a
    column that a version lacks would otherwise count as missing throughout.
    """
    own = match(stats, schema.select(*KEYS, "column_name").distinct(), [*KEYS, "column_name"], "left_semi")
    missing, cells = F.sum("missing_count"), F.max("row_count") * F.count(F.lit(1))
    return own.groupBy(*KEYS).agg(
        F.max("row_count").alias("row_count"),
        F.count(F.lit(1)).alias("column_count"),
        missing.alias("missing_cells_count"),
        percent(missing, cells).alias("missing_cells_percent"),
    )


def version_deltas(summary: DataFrame, reports: DataFrame, pairs: DataFrame) -> DataFrame:
    """Row, column and score differences between the two versions of each pair; ``summary`` counts the columns a version has."""
    scores = ["health_score", "quality_score", "anomaly_score", "drift_score"]
    facts = summary.select(*KEYS, "row_count", "column_count").join(reports.select(*KEYS, *scores), KEYS, "left")

    def side(prefix: str) -> DataFrame:
        return facts.select(
            "dataset_id",
            F.col("version_number").alias(f"{prefix}_version"),
            *[F.col(c).alias(f"{prefix}_{c}") for c in ("row_count", "column_count", *scores)],
        )

    both = pairs.join(side("source"), ["dataset_id", "source_version"]).join(side("target"), ["dataset_id", "target_version"])
    diff = lambda c: F.col(f"target_{c}") - F.col(f"source_{c}")
    return both.select(
        "dataset_id",
        "source_version",
        "target_version",
        diff("row_count").alias("row_delta"),
        diff("column_count").alias("column_delta"),
        *[F.coalesce(diff(s), F.lit(0.0)).alias(s.replace("_score", "_delta")) for s in scores],
    )


def column_deltas(profiles: DataFrame, pairs: DataFrame) -> DataFrame:
    """Differences of the profile figures for the columns both versions have."""
    figures = ["missing_percent", "unique_count", "mean", "median", "std"]

    def side(prefix: str) -> DataFrame:
        return profiles.select(
            "dataset_id",
            F.col("version_number").alias(f"{prefix}_version"),
            "column_name",
            *[F.col(c).alias(f"{prefix}_{c}") for c in figures],
        )

    both = pairs.join(side("source"), ["dataset_id", "source_version"]).join(
        side("target"), ["dataset_id", "target_version", "column_name"]
    )
    diff = lambda c: F.coalesce(F.col(f"target_{c}") - F.col(f"source_{c}"), F.lit(0))
    return both.select(
        "dataset_id",
        "source_version",
        "target_version",
        "column_name",
        diff("missing_percent").cast("double").alias("null_delta"),
        diff("unique_count").alias("cardinality_delta"),
        diff("mean").cast("double").alias("mean_delta"),
        diff("median").cast("double").alias("median_delta"),
        diff("std").cast("double").alias("std_delta"),
    )
