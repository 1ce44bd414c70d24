"""The named queries of the training-data operators, with check SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import corpus_pipeline
from relyframe.llm import chat, check_words, decontaminate, language_id, language_model, licenses, line_dedup, mtree, near_dup, periods, sentencepiece_codec, simhash, spelling, substring
from relyframe.llm.check_sql import CHECKS
from relyframe.llm.store import documents

Query = Callable[[SparkSession, str], DataFrame]


def op1_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dup.near_duplicates(documents(spark, sf_dir), near_dup.PERCENT).select("doc_id", "n_shingles", "component_id", "kept")


def op2_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.contaminated(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return found.select("doc_id", "item_id", "covered", "item_tokens", "slots", "consistent")


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text", F.size(F.split("text", "\n")).cast("long").alias("n_lines"))
    out = line_dedup.dedup_lines(docs, count_as="n_deleted")
    return out.select("doc_id", "n_lines", F.col("n_deleted").cast("long").alias("n_deleted"), F.sha2("text", 256).alias("text_sha256"))


def op4_mtree_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = mtree.whole_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    return mtree.top_inner_products(vectors, vectors.filter(F.col("vec_id") % mtree.QUERY_STEP == 0)).select("query_id", "rank", "vec_id", "score")


def op5_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    probe = F.lit("\\### Assistant: </turn> ok")
    extra = spark.range(2).select(
        F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), probe.alias("text"),
    )
    return chat.digests(chat.format_conversations(rows.union(extra)))


def op6_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents are the files of a folder per source; pages lie under their host and path, without their tags."""
    docs = documents(spark, sf_dir)
    files = docs.select(F.concat_ws("/", F.lit("doc"), "doc_id").alias("file"), F.concat_ws("/", F.lit("documents"), "source", "doc_id").alias("path"), "text")
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    path = F.regexp_replace(F.regexp_replace("url", r"^[a-z]+://", ""), r"[?#].*$", "")
    plain = F.regexp_replace(F.regexp_replace("html", r"(?is)<(script|style)\b.*?</\1>|<!--.*?-->", " "), r"(?i)</?(p|br|div|li|h[1-6]|tr|article|ul|ol|table|footer|title)\b[^>]*>", "\n")
    sites = pages.select(F.concat_ws("/", F.lit("page"), "page_id").alias("file"), F.concat(F.lit("pages/"), path).alias("path"), F.regexp_replace(plain, r"<[^>]*>", " ").alias("text"))
    out = licenses.scan_licences(files.union(sites))
    return out.select(F.split("file", "/")[0].alias("kind"), F.get(F.split("file", "/"), F.lit(1)).cast("long").alias("id"), "licence", "cosine", "origin", "depth")


def op7_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_model.score_documents(documents(spark, sf_dir))


def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.remove_repeats(documents(spark, sf_dir)).select("doc_id", "n_words", "n_removed", "kept_sha256")


def op9_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentencepiece_codec.encode_documents(documents(spark, sf_dir))


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.identify(documents(spark, sf_dir))


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.spelling_variants(documents(spark, sf_dir), delete_every=spelling.DELETE_EVERY)


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = periods.periodic_runs(documents(spark, sf_dir), repeat=True)
    line = F.transform(F.arrays_zip("starts", "lengths", "periods"), lambda r: F.concat(F.concat_ws(",", r["starts"], r["lengths"], r["periods"]), F.lit("\n")))
    return found.select(
        "doc_id", "n_runs", "start", "length", "period", "exponent_milli",
        F.sha2(F.array_join(line, ""), 256).alias("runs_sha256"), F.sha2("text", 256).alias("collapsed_sha256"),
    )


def op13_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(documents(spark, sf_dir)).select("doc_id", "fingerprint", "component_id")


def queries() -> dict[str, Query]:
    own = (
        op1_minhash_near_dedup, op2_benchmark_decontamination, op3_line_dedup, op4_mtree_top_k, op5_chat_formatting, op6_license_scan,
        op7_lm_scoring, op8_substring_dedup, op9_sentencepiece, op10_language_id, op11_spelling_variants, op12_periodic_runs, op13_simhash_near_dedup,
    )
    return {f.__name__: f for f in own} | {"pipeline": corpus_pipeline.run}


def oracle_sql() -> dict[str, str]:
    return CHECKS | check_words.CHECKS
