"""From raw documents to tokens: identify the language, delete repeated lines, drop near-duplicates and benchmark leaks, encode.

The stages are operators of ``relyframe.llm``; without that folder this file cannot be imported.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from relyframe.llm import decontaminate, language_id, line_dedup, near_dup, sentencepiece_codec
from relyframe.llm.store import documents, sized, small_batches, stored

# Texts whose shingle sets are this similar are near-duplicates; op1 has a limit of its own.
NEAR_PERCENT = 80

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is identified; rejected ones go."""
    small_batches(spark)
    return language_id.keep_identified(docs)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without lines of runs that occurred before, single lines of a few words among them; texts of which no word is left go, ``n_chars`` follows the text."""
    out = line_dedup.dedup_lines(docs)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return out.filter(F.col("text").rlike(r"[^\x20\x09-\x0D]")).select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near-duplicates, the one with the smallest doc_id; a null doc_id comes last.

    Every text counts by itself: rows that share a doc_id but not the text can
    be in different groups, and of repeated rows one stays. A text without words
    is near to nothing but its own repetitions.
    """
    row = F.xxhash64("doc_id", F.lit("/"), "text")
    texts = stored(docs.select(row.alias("doc_id"), "text", F.col("doc_id").alias("name")), "texts")
    groups = near_dup.near_duplicates(texts.select("doc_id", "text"), NEAR_PERCENT).select("doc_id", "component_id")
    ranked = groups.distinct().join(texts.select("doc_id", "name").distinct(), "doc_id")
    first = ranked.groupBy("component_id").agg(F.count("*").alias("size"), F.min(F.struct(F.col("name").isNull(), "name", "doc_id")).alias("first"))
    grouped = ranked.join(first.filter("size > 1"), "component_id")
    copies = stored(grouped.filter("doc_id <> first.doc_id").select(F.col("doc_id").alias("relyframe_row")), "copies")
    again = stored(texts.groupBy("doc_id").agg(F.count("*").alias("times")).filter("times > 1").select(F.col("doc_id").alias("relyframe_again")), "again")
    kept = docs.withColumn("relyframe_row", row).join(sized(copies), "relyframe_row", "left_anti")
    once = kept.join(sized(again), F.col("relyframe_row") == F.col("relyframe_again"), "left_anti")
    several = kept.join(sized(again), F.col("relyframe_row") == F.col("relyframe_again"), "left_semi").dropDuplicates(["relyframe_row"])
    return once.union(several).select(*docs.columns)


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that no benchmark item contaminates."""
    return decontaminate.drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")).select(*docs.columns)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every text, with their count and the checks of the codec."""
    return sentencepiece_codec.encode_documents(docs, with_ids=True)


STAGES: list[tuple[str, Stage]] = [
    ("language_id", language), ("line_dedup", lines), ("minhash_near_dedup", near_duplicates), ("benchmark_decontamination", benchmark), ("sentencepiece", tokens),
]

# Nearest centroids, signatures and byte-pair merges have no SQL form; tests compare every stage with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
