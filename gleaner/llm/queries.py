"""The registered queries of this package: each applies one operator to its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleaner.llm import decontamination, language_id, mixing, near_duplicates, ngram_lm, quality, secrets, sharding, token_output, topk_search
from gleaner.llm.common import table


def op1_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk_search.top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).drop("source", "tie")


def op3_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The law is rows: counts of shards differ by one at most. grown_shard belongs to the law key alone."""
    shards = sharding.shard(table(spark, sf_dir, "documents"))
    return shards.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op4_ngram_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_lm.train_and_score(table(spark, sf_dir, "documents"))


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.train_and_identify(table(spark, sf_dir, "documents"))


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontamination.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    items, words = F.col("items"), F.transform("matches", lambda m: m["words"])
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size(items).cast("long").alias("n_items"),
        F.sha2(F.array_join(items, ","), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
        F.size("matches").cast("long").alias("n_matches"),
        F.coalesce(F.array_max(words), F.lit(0)).cast("long").alias("longest"),
    )


def op7_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_output.round_trip(table(spark, sf_dir, "documents"))


def op8_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found, spans = secrets.scan(table(spark, sf_dir, "documents")), F.col("spans")
    counts = [secrets.count_kind(spans, k).alias(f"n_{k}") for k in secrets.BASE]
    return found.select("doc_id", *counts, F.sha2(secrets.written(spans, list(secrets.BASE)), 256).alias("base_sha256"), secrets.written(spans, secrets.KINDS).alias("spans"))


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.train_and_score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op10_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates.near_duplicates(table(spark, sf_dir, "documents"))


def queries() -> dict:
    found = (op1_exact_topk, op2_mixing, op3_sharding, op4_ngram_lm, op5_language_id, op6_decontamination, op7_token_output, op8_secret_scan, op9_quality, op10_near_duplicates)
    return {f.__name__: f for f in found}
