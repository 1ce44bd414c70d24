"""Writers: append, upsert, replace by key, CSV export, version registration."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from relyframe.operators.keyed import match
from relyframe.session import settle


def append_findings(df: DataFrame, path: str, by: list[str]) -> None:
    """Add rows to a fact table laid out by its run keys.

    A rebalance gathers rows by those keys, so each task writes few files, and
    splits a hot key by bytes.
    """
    df.hint("rebalance", *by).write.mode("append").partitionBy(*by).parquet(path)


def upsert(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of ``new`` replace rows of ``old`` with the same key; NULL is a key.

    Of several new rows with one key, the greatest by their other columns in
    order stays.
    """
    rest = [F.col(c) for c in new.columns if c not in keys]
    one = new.groupBy(*keys).agg(F.max(F.struct(*rest)).alias("_row")).select(*keys, "_row.*") if rest else new.distinct()
    kept = match(old, one.select(*keys), keys, "left_anti")
    return kept.unionByName(one, allowMissingColumns=True)


def upsert_table(new: DataFrame, path: str, keys: list[str], by: list[str]) -> None:
    """Upsert into a stored table laid out by ``by``, which are among the keys; only partitions that ``new`` touches are rewritten."""
    old = new.sparkSession.read.parquet(path)
    touched = match(old, new.select(*by).distinct(), by, "left_semi")
    replace_by_key(settle(upsert(touched, new, keys)), path, by)


def replace_by_key(df: DataFrame, path: str, by: list[str]) -> None:
    """Overwrite only the partitions whose keys appear in ``df``."""
    (
        df.hint("rebalance", *by)
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy(*by)
        .parquet(path)
    )


def export_csv(df: DataFrame, path: str) -> None:
    """Write the view a user sees: header row, nested cells as JSON text."""
    nested = (T.StructType, T.ArrayType, T.MapType)
    flat = df.select(
        *[
            F.to_json(f.name).alias(f.name) if isinstance(f.dataType, nested) else F.col(f.name)
            for f in df.schema.fields
        ]
    )
    flat.write.option("header", True).option("escape", '"').option("quoteAll", True).csv(path)


def next_versions(datasets: DataFrame, versions: DataFrame) -> DataFrame:
    """The number the next upload of each dataset gets: latest + 1, else 1."""
    top = versions.groupBy("dataset_id").agg(F.max("version_number").alias("latest"))
    return datasets.join(top, "dataset_id", "left").select(
        "dataset_id", (F.coalesce("latest", F.lit(0)) + 1).cast("int").alias("next_version")
    )


def append_log(df: DataFrame, path: str) -> None:
    df.write.mode("append").parquet(path)


def read_back(spark: SparkSession, path: str, schema: T.StructType | str | None = None) -> DataFrame:
    reader = spark.read
    if schema is not None:
        reader = reader.schema(schema)
    return reader.parquet(path)
