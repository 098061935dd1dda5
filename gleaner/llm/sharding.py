"""Sharding by proportional stratified interleaving.

Rows are shuffled within their source by a seeded hash and ranked; a row's place is its rank as a fraction of
its source's rows, and each source begins at a phase of its own within its first step, so that many small
sources don't share a place. Sorted by place all sources advance together, so cutting the sorted rows into
equal runs gives shards that each hold every source in the proportion of the whole. Runs differ by one row at
most.

Ranks come from bucket counts, so neither a large source nor the whole table is sorted in one task.

Cases: a null text has no bytes and the checksum of none; null sources are one source, last in order. Repeated
rows are rows of their own. Fewer rows than shards leave some shards empty. An empty table gives no rows.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleaner.llm.common import bounded, stash, uniform
from gleaner.llm.ranking import BUCKET_ROWS, sum_before

SHARDS = 24
SEED = 29


def shard(docs: DataFrame, *, shards: int = SHARDS, seed: int = SEED) -> DataFrame:
    """doc_id, size, text_crc32, source, shard, slot and tie (a hash of the text) for every row of docs (doc_id, text, source)."""
    data = F.coalesce(F.col("text").cast("binary"), F.lit(b""))
    rows = stash(
        docs.select(
            "doc_id",
            F.col("source").isNull().alias("src_null"),
            F.coalesce(F.col("source").cast("string"), F.lit("")).alias("src"),
            (F.octet_length(data) + 8).cast("long").alias("size"),
            F.crc32(data).alias("text_crc32"),
            F.xxhash64(data).alias("tie"),
            uniform(seed, F.col("doc_id")).alias("u"),
        ),
        "shard",
    )
    src, one = ["src_null", "src"], F.lit(1)
    totals = stash(rows.groupBy(*src).agg(F.count("*").alias("n")), "shard-sources")
    n = totals.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    buckets = F.ceil(F.col("n") / BUCKET_ROWS)
    rows = rows.join(bounded(totals), src).withColumn("bucket", F.least(F.floor(F.col("u") * buckets), buckets - 1))
    rows = sum_before(rows, src, "bucket", [F.col("u"), F.col("doc_id"), F.col("tie")], one, "rank")
    rows = rows.withColumn("place", (F.col("rank") + uniform(seed + 1, F.col("src_null"), F.col("src"))) / F.col("n"))
    cells = max(1, math.ceil(n / BUCKET_ROWS))
    rows = rows.drop("bucket").withColumn("all", F.lit(0)).withColumn("cell", F.least(F.floor(F.col("place") * cells), F.lit(cells - 1)))
    rows = sum_before(rows, ["all"], "cell", [F.col("place"), F.col("src_null"), F.col("src")], one, "at")
    cut = F.expr(f"(at * {shards}L) div {max(n, 1)}L")
    rows = rows.withColumn("shard", cut.cast("int"))
    slot = F.expr(f"at - (shard * {n}L + {shards - 1}L) div {shards}L")
    return rows.select("doc_id", "size", "text_crc32", F.when(~F.col("src_null"), F.col("src")).alias("source"), "shard", slot.cast("long").alias("slot"), "tie")


def write_shards(docs: DataFrame, path: str, *, shards: int = SHARDS, seed: int = SEED) -> None:
    """Write docs under path as shard=K folders. Rows of the same id, source and text all go to their first shard."""
    key = [F.col("doc_id"), F.col("source").cast("string"), F.xxhash64(F.coalesce(F.col("text").cast("binary"), F.lit(b"")))]
    plan = shard(docs, shards=shards, seed=seed).groupBy("doc_id", "source", "tie").agg(F.min(F.struct("shard", "slot")).alias("at"))
    plan = plan.select(F.col("doc_id").alias("gleaner_id"), F.col("source").alias("gleaner_source"), F.col("tie").alias("gleaner_tie"), F.col("at.shard").alias("gleaner_shard"), F.col("at.slot").alias("gleaner_slot"))
    same = [a.eqNullSafe(F.col(b)) for a, b in zip(key, ("gleaner_id", "gleaner_source", "gleaner_tie"), strict=True)]
    rows = docs.join(plan, same).drop("gleaner_id", "gleaner_source", "gleaner_tie", "shard").withColumnRenamed("gleaner_shard", "shard")
    rows.repartition("shard", F.floor(F.col("gleaner_slot") / BUCKET_ROWS)).sortWithinPartitions("shard", "gleaner_slot").drop("gleaner_slot").write.partitionBy("shard").parquet(path)
