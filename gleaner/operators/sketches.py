"""Mergeable sketches, as aggregates."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gleaner.plans.scratch import bounded, stash


def count_min(df: DataFrame, key: str, *, width: int = 2048, depth: int = 5, seed: int = 7) -> DataFrame:
    """One row: the table of a count-min sketch as (cells map). Rows of a table are hashed natively, so partial
    tables merge in the shuffle and never exceed width * depth counters."""
    at = lambda r: F.pmod(F.xxhash64(F.lit(seed), F.lit(r), F.col(key)), F.lit(width)) + r * width
    cells = df.select(F.explode(F.array(*[at(r) for r in range(depth)])).alias("cell")).groupBy("cell").agg(F.count("*").alias("n"))
    return cells.agg(F.map_from_entries(F.collect_list(F.struct("cell", "n"))).alias("cells"))


def estimates(keys: DataFrame, key: str, sketch: DataFrame, *, width: int = 2048, depth: int = 5, seed: int = 7) -> DataFrame:
    """keys with estimate: never less than the true count. Cells are joined by hash: a map is searched from its start."""
    at = lambda r: F.pmod(F.xxhash64(F.lit(seed), F.lit(r), F.col(key)), F.lit(width)) + r * width
    rows, found = keys, [f"gleaner_n{r}" for r in range(depth)]
    for r, n in enumerate(found):
        cells = sketch.select(F.explode("cells").alias("gleaner_cell", n))
        rows = rows.join(F.broadcast(cells), at(r) == F.col("gleaner_cell"), "left").drop("gleaner_cell")
    least = [F.coalesce(n, F.lit(0)) for n in found]
    return rows.withColumn("estimate", F.least(*least) if depth > 1 else least[0]).drop(*found)


def merged(*stored: DataFrame) -> DataFrame:
    """One count-min sketch of several stored ones of the same width, depth and seed: cells are added."""
    cells = reduce(DataFrame.unionByName, stored).select(F.explode("cells").alias("cell", "n")).groupBy("cell").agg(F.sum("n").alias("n"))
    return cells.agg(F.map_from_entries(F.collect_list(F.struct("cell", "n"))).alias("cells"))


def frequencies(keys: DataFrame, key: str, sketch: DataFrame, **options) -> DataFrame:
    """keys with estimate and frequency, the estimate over the number of rows that were counted."""
    return _over_all(estimates(keys, key, sketch, **options), sketch, options.get("depth", 5))


def exact_frequencies(df: DataFrame, key: str, sketch: DataFrame, **options) -> DataFrame:
    """Every different key of df with estimate and frequency, which are exact; the sketch was made of df's rows.

    A key with a cell of its own, as a sketch of the different keys tells, is read from the sketch. Those that
    share each of their cells, which are many when there are more keys than the width, are counted in df.
    """
    keys = df.select(key).distinct()
    sharing = estimates(keys, key, count_min(keys, key, **options), **options).withColumnRenamed("estimate", "gleaner_keys")
    rows = stash(estimates(sharing, key, sketch, **options), "estimates")
    shared = bounded(rows.filter("gleaner_keys > 1").select(F.col(key).alias("gleaner_key")))
    counted = df.select(key).join(shared, F.col(key).eqNullSafe(F.col("gleaner_key")), "left_semi").groupBy(key).agg(F.count("*").alias("estimate"))
    return _over_all(rows.filter("gleaner_keys = 1").select(key, "estimate").unionByName(counted), sketch, options.get("depth", 5))


def _over_all(rows: DataFrame, sketch: DataFrame, depth: int) -> DataFrame:
    """rows with frequency, their estimate over all that the sketch counted."""
    total = sketch.select((F.aggregate(F.map_values("cells"), F.lit(0).cast("long"), lambda a, n: a + n) / depth).alias("gleaner_total"))
    rows = rows.crossJoin(F.broadcast(total))
    return rows.withColumn("frequency", F.when(F.col("gleaner_total") > 0, F.col("estimate") / F.col("gleaner_total")).otherwise(0.0)).drop("gleaner_total")


def merged_bins(*stored: DataFrame, bins: int = 64) -> DataFrame:
    """(center, n): a histogram of at most so many bins from several stored ones: bins of the same center are
    added, then neighbours are merged by rank until there are no more than wanted."""
    rows = reduce(DataFrame.unionByName, stored).groupBy("center").agg(F.sum("n").alias("n"))
    size = rows.count()
    if size <= bins:
        return rows
    place = F.floor((F.row_number().over(Window.orderBy("center")) - 1) * bins / size)  # bounded: a few bins each
    cells = rows.withColumn("cell", place).groupBy("cell").agg((F.sum(F.col("center") * F.col("n")) / F.sum("n")).alias("center"), F.sum("n").alias("n"))
    return cells.select("center", "n")


def surprise_of(df: DataFrame, x: Column, bins: DataFrame, name: str = "surprise") -> DataFrame:
    """Add -ln of a value's probability by a histogram of bounded size; outside it the nearest bin counts."""
    packed_bins = packed(bins).select(F.col("b").alias("gleaner_b"), F.col("total").alias("gleaner_n"), F.col("span").alias("gleaner_span"), F.col("size").alias("gleaner_size"))
    rows = df.crossJoin(F.broadcast(packed_bins))
    b, n = F.col("gleaner_b"), F.col("gleaner_n")
    low, high = F.element_at(b, 1)["center"], F.element_at(b, -1)["center"]
    p = probability(F.least(F.greatest(x, low), high), b, n, F.col("gleaner_span"), F.col("gleaner_size"))
    p = F.when((n < 2) | (F.col("gleaner_size") < 2), 1e-10).otherwise(p)
    return rows.withColumn(name, -F.log(p)).drop("gleaner_b", "gleaner_n", "gleaner_span", "gleaner_size")


def sizes_for(error: float, confidence: float) -> tuple[int, int]:
    """Width and depth for an error as a share of the total, at a confidence."""
    return math.ceil(math.e / error), math.ceil(math.log(1 / (1 - confidence)))


def exact_bins(df: DataFrame, x: Column) -> DataFrame:
    """(center, n): a histogram with a bin for each different value."""
    return df.select(x.cast("double").alias("center")).filter("center is not null").groupBy("center").agg(F.count("*").alias("n"))


def streaming_bins(df: DataFrame, x: Column, bins: int = 64) -> DataFrame:
    """(center, n): at most so many bins, merged while values arrive (Ben-Haim and Tom-Tov's histogram)."""
    return df.agg(F.histogram_numeric(x.cast("double"), F.lit(bins)).alias("h")).select(F.explode("h").alias("b")).select(F.col("b.x").alias("center"), F.col("b.y").cast("long").alias("n"))


def packed(bins: DataFrame) -> DataFrame:
    """One row: centers, counts, total, span and size of a histogram of bounded size."""
    row = bins.agg(F.array_sort(F.collect_list(F.struct("center", "n"))).alias("b"), F.sum("n").alias("total"), (F.max("center") - F.min("center")).alias("span"), F.count("*").alias("size"))
    return row


def density(value: Column, bins: Column, total: Column) -> Column:
    """The count at a value, between the counts of its neighbours, over the total; 0 outside."""
    left = F.element_at(F.filter(bins, lambda b: b["center"] <= value), -1)
    right = F.get(F.filter(bins, lambda b: b["center"] > value), F.lit(0))
    part = (value - left["center"]) / (right["center"] - left["center"])
    between = left["n"] + (right["n"] - left["n"]) * part
    return F.when((F.size(F.filter(bins, lambda b: b["center"] <= value)) == 0) | (value > F.element_at(bins, -1)["center"]), 0.0).when(right.isNull(), left["n"] / total).otherwise(between / total)


def probability(value: Column, bins: Column, total: Column, span: Column, size: Column) -> Column:
    """Density times a bin's mean width, at least 1e-10."""
    return F.greatest(density(value, bins, total) * span / size, F.lit(1e-10))


def quantile(bins: DataFrame, q: float) -> DataFrame:
    """One row: the first center at which the counts reach a share of all."""
    along = Window.orderBy("center").rowsBetween(Window.unboundedPreceding, 0)
    total = bins.agg(F.sum("n").alias("total"))
    return bins.withColumn("upto", F.sum("n").over(along)).crossJoin(F.broadcast(total)).filter(F.col("upto") >= q * F.col("total")).agg(F.min("center").alias("value"))
