"""Mixing sources to target weights, with DataFrame functions only.

Every source gets a share of all words by its weight, up to a number of epochs of its own words; what a
capped source leaves is shared again among the others by weight. Within a source documents are drawn by
Efraimidis-Spirakis sampling: a document of quality weight w gets the exponential key -ln(u) / w, where u
depends on the seed and the id alone, documents are sorted by key, and their sizes are summed up until the
word budget is used. Complete epochs take every document; only the rest of the budget is drawn.

The document at the boundary gives just the words that are left, so that every source meets its target to
the word.

A source may hold most rows: keys are dealt to buckets by their distribution function, which the counts of
the few weight grades give exactly, so buckets are even, and only buckets are sorted.

Cases: a null text has no words; documents without words are never taken; null sources are one source, last
in order. Repeated rows count as often as they are there. Equal keys (repeated ids) are ordered by a hash of
the text. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gleaner.llm.common import WORD, bounded, stash, uniform
from gleaner.llm.ranking import BUCKET_ROWS, sum_before

WEIGHTS = (5, 2, 1)
MAX_EPOCHS = 3
SEED = 17
#: Quality weights are grade / GRADES.
GRADES = 8
#: Characters that count against a text's quality weight: marks and digits that prose has few of.
MARKS = "#$%&*|!@^~<>{}[]\\/_=+0123456789"


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def quality_grade(text: Column) -> Column:
    """1 to GRADES: the share of characters that aren't marks, in steps; an empty text has 1."""
    kept = F.length(F.translate(text, MARKS, "")).cast("double")
    share = kept / F.greatest(F.length(text), F.lit(1))
    return F.coalesce(F.greatest(F.ceil(share * GRADES), F.lit(1)), F.lit(1)).cast("int")


def source_targets(totals: DataFrame, weights: Sequence[float], max_epochs: int) -> DataFrame:
    """totals (src_null, src, source_size) with target: weighted shares of all words under the caps.

    In order of cap / weight a source is capped as long as the water level, what is left over the weights
    that are left, lies above its cap / weight; from the first source on that isn't, the level holds.
    """
    order = Window.orderBy("src_null", "src")
    rank = F.pmod(F.row_number().over(order) - 1, F.lit(len(weights))) + 1
    rows = totals.withColumn("w", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), rank))
    rows = rows.withColumn("cap", F.col("source_size") * F.lit(float(max_epochs)))
    rows = rows.withColumn("ratio", F.col("cap") / F.col("w"))
    by_ratio = Window.orderBy("ratio", "src_null", "src")
    before = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    rest = by_ratio.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    everything = Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    total = F.sum("source_size").over(everything).cast("double")
    rows = rows.withColumn("level", (total - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("w").over(rest))
    level = F.min(F.when(F.col("level") <= F.col("ratio"), F.struct("ratio", "level"))).over(everything)["level"]
    return rows.withColumn("water", level).select("src_null", "src", "source_size", F.least(F.col("w") * F.col("water"), F.col("cap")).alias("target"))


def mix(docs: DataFrame, *, weights: Sequence[float] = WEIGHTS, max_epochs: int = MAX_EPOCHS, seed: int = SEED) -> DataFrame:
    """doc_id, size, source_size, target, taken, source and tie (a hash of the text) for every row of docs (doc_id, text, source)."""
    text = F.col("text")
    rows = stash(
        docs.select(
            "doc_id",
            F.col("source").isNull().alias("src_null"),
            F.coalesce(F.col("source").cast("string"), F.lit("")).alias("src"),
            n_words(text).alias("size"),
            quality_grade(text).alias("grade"),
            uniform(seed, F.col("doc_id")).alias("u"),
            F.xxhash64(text).alias("tie"),
        ).withColumn("key", -F.log("u") * GRADES / F.col("grade")),
        "mix",
    )
    src = ["src_null", "src"]
    totals = rows.groupBy(*src).agg(F.sum("size").alias("source_size"), F.count("*").alias("n"), *[F.count_if(F.col("grade") == g).alias(f"g{g}") for g in range(1, GRADES + 1)])
    totals = stash(totals, "mix-sources")
    plan = source_targets(totals.select(*src, "source_size"), weights, max_epochs).join(totals.drop("source_size"), src)
    later = sum((F.col(f"g{g}") * F.exp(-F.col("key") * g / GRADES) for g in range(1, GRADES + 1)), F.lit(0.0)) / F.col("n")
    buckets = F.ceil(F.col("n") / BUCKET_ROWS)
    rows = rows.join(bounded(plan), src).withColumn("bucket", F.least(F.floor((1 - later) * buckets), buckets - 1))
    rows = sum_before(rows, src, "bucket", [F.col("key"), F.col("tie"), F.col("size")], F.col("size"), "before")
    budget = F.round("target").cast("long")
    epochs = F.when(F.col("source_size") > 0, F.floor(budget / F.col("source_size"))).otherwise(0).cast("long")
    rest = budget - epochs * F.col("source_size")
    taken = epochs * F.col("size") + F.greatest(F.lit(0), F.least(F.col("size"), rest - F.col("before")))
    return rows.select("doc_id", "size", "source_size", F.col("target").cast("double").alias("target"), taken.cast("long").alias("taken"), F.when(~F.col("src_null"), F.col("src")).alias("source"), "tie")


def mixed_documents(docs: DataFrame, **options) -> DataFrame:
    """The mixture itself: each row of docs as often as the mix takes it, begun epochs included, whole texts.

    Documents that the mix takes no word of are left out.
    """
    columns = docs.columns
    copies = mix(docs, **options).filter("taken > 0").select(F.col("doc_id").alias("gleaner_id"), F.col("source").alias("gleaner_source"), F.col("tie").alias("gleaner_tie"), F.ceil(F.col("taken") / F.col("size")).cast("int").alias("gleaner_copies"))
    # rows of the same id, source and text can't be told apart: their copies are summed and shared evenly, rounded up
    key = ["gleaner_id", "gleaner_source", "gleaner_tie"]
    copies = copies.groupBy(*key).agg(F.sum("gleaner_copies").alias("gleaner_copies"), F.count("*").alias("gleaner_rows"))
    own = [F.col("doc_id"), F.col("source").cast("string"), F.xxhash64("text")]
    joined = docs.join(copies, [a.eqNullSafe(F.col(b)) for a, b in zip(own, key, strict=True)])
    return joined.withColumn("gleaner_copy", F.explode(F.sequence(F.lit(1), F.ceil(F.col("gleaner_copies") / F.col("gleaner_rows")).cast("int")))).select(*columns)
