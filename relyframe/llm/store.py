"""Intermediate tables in the shared folder, and joins by size."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from relyframe.session import scratch

# A table is broadcast when its rows, written as JSON, stay below this.
BROADCAST_CHARS = 64 << 20
BATCH_BYTES = 4 << 20
# Rows of ids, keys and counts that make a task of their own.
TASK_ROWS = 50_000


def stored(df: DataFrame, label: str) -> DataFrame:
    """Write once to the shared folder and read back, so that lost executors cost only the reading task."""
    path = scratch(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def slim(df: DataFrame, rows: int) -> DataFrame:
    """No more tasks than a table of about so many short rows needs: ``rows`` is measured, or a bound from a measured table."""
    return df.coalesce(max(8, -(-rows // TASK_ROWS)))


def sized(df: DataFrame, limit: int = BROADCAST_CHARS) -> DataFrame:
    """A stored table, hinted for broadcast only when its measured size stays below ``limit``; beyond it, both sides are shuffled."""
    chars = df.agg(F.sum(F.length(F.to_json(F.struct("*"))))).first()[0] or 0
    return F.broadcast(df) if chars <= limit else df


def small_batches(spark: SparkSession) -> None:
    """Keep Arrow batches of long texts to a few MB in the tasks of this session."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if int(spark.conf.get(key).rstrip("bB")) > BATCH_BYTES:
        spark.conf.set(key, str(BATCH_BYTES))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/documents.parquet")
