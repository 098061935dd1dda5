"""From raw documents to token files: the stages of the training-data pipeline.

Each stage takes (spark, docs, sf_dir), works on all that its predecessor kept, and returns a DataFrame; all but
the last return the columns of documents. The driver of a pipeline writes each result as Parquet and reads it
again; run() does so in the shared folder.

Cases: a null text is empty. Empty texts stay, as long as the classifier takes them, until the mixture, which has no
words of theirs to take. Rows that repeat an id are rows of their own: of a group of near-duplicates one row of
the least id stays, null only where no member has another. Without labels nothing is rejected, without benchmark
items nothing is contaminated. Columns of any name pass through all stages but the last. Empty documents give
no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from gleaner.llm import decontamination, mixing, near_duplicates, quality, token_output
from gleaner.llm.common import stash, table

#: Stages on shingles link texts of this similarity, in per cent, or more.
NEAR = 80


def good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts."""
    return quality.good_documents(docs, table(spark, sf_dir, "labels"))


def different(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates."""
    return near_duplicates.distinct_documents(docs, percent=NEAR)


def unseen(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of the benchmark."""
    return decontamination.clean_documents(docs, table(spark, sf_dir, "benchmark"))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents of the mixture, each as often as it is taken."""
    return mixing.mixed_documents(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The token files' rows, read back: doc_id, start, n_tokens, ids_crc32."""
    return token_output.round_trip(docs)


STAGES = [("quality", good), ("near_duplicates", different), ("decontamination", unseen), ("mixing", mixed), ("tokens", tokens)]

#: SQL can't express the classifier or the tokenizer.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stash(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
