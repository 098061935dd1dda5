"""One-row statistics of a column of values, and decisions taken from them."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _ranked(df: DataFrame, x: Column) -> DataFrame:
    """Different values x, how often each is there (c) and how many rows lie below it, without sorting them in
    one task."""
    counts = df.select(x.alias("x")).filter("x is not null").groupBy("x").agg(F.count("*").alias("c"))
    # cells of near values keep the order; a window runs over the cells, and one inside each cell
    span = counts.agg(F.min("x").alias("lo"), F.max("x").alias("hi"))
    cells = counts.crossJoin(F.broadcast(span)).withColumn("cell", F.when(F.col("hi") > F.col("lo"), F.floor((F.col("x") - F.col("lo")) / (F.col("hi") - F.col("lo")) * 1000)).otherwise(0))
    before = Window.orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    base = cells.groupBy("cell").agg(F.sum("c").alias("in_cell")).select("cell", F.coalesce(F.sum("in_cell").over(before), F.lit(0)).alias("base"))
    inside = Window.partitionBy("cell").orderBy("x").rowsBetween(Window.unboundedPreceding, -1)
    return cells.join(base, "cell").select("x", "c", (F.col("base") + F.coalesce(F.sum("c").over(inside), F.lit(0))).alias("below"))


def _rank_sums(df: DataFrame, x: Column) -> DataFrame:
    """n, sum and rank-weighted sum of values; equal values share the ranks they take."""
    ranked = _ranked(df, x)
    ranks = F.col("c") * F.col("below") + F.col("c") * (F.col("c") + 1) / 2
    return ranked.agg(F.sum("c").alias("n"), F.sum(F.col("c") * F.col("x")).alias("total"), F.sum(ranks * F.col("x")).alias("weighted"))


def quantile(df: DataFrame, x: Column, q: float, name: str = "value") -> DataFrame:
    """One row: the value at the share q of the order, between its two neighbours by distance; null without values."""
    x = x.cast("double")
    place = df.agg(((F.count(x) - 1) * F.lit(float(q))).alias("place"))
    rows = _ranked(df, x).crossJoin(F.broadcast(place))
    at = lambda rank: F.max(F.when((F.col("below") <= rank) & (rank < F.col("below") + F.col("c")), F.col("x")))
    found = rows.agg(at(F.floor("place")).alias("lower"), at(F.ceil("place")).alias("upper"), F.max(F.col("place") - F.floor("place")).alias("part"))
    return found.select(F.when(F.col("lower") == F.col("upper"), F.col("lower")).otherwise(F.col("lower") * (1 - F.col("part")) + F.col("upper") * F.col("part")).alias(name))


def gini(df: DataFrame, x: Column) -> DataFrame:
    n, total = F.col("n"), F.col("total")
    value = 2 * F.col("weighted") / (n * total) - (n + 1) / n
    return _rank_sums(df, x).select(F.when(F.abs(total) < 1e-10, 0.0).otherwise(F.least(F.greatest(value, F.lit(0.0)), F.lit(1.0))).alias("gini"))


def cv(x: Column) -> Column:
    """Population deviation over the mean's size; 0 if the mean is."""
    return F.when(F.abs(F.avg(x)) < 1e-10, 0.0).otherwise(F.stddev_pop(x) / F.abs(F.avg(x)))


def entropy(df: DataFrame, x: Column) -> DataFrame:
    """Entropy of the values as shares, over that of equal shares; 1 if nothing is positive."""
    v = F.greatest(x, F.lit(0.0))
    sums = df.agg(F.sum(v).alias("t"), F.count(x).alias("n"), F.sum(F.when(v > 0, v * F.log(v)).otherwise(0.0)).alias("s"))
    h = F.log("t") - F.col("s") / F.col("t")  # -sum p ln p, with p = v / t
    return sums.select(F.when((F.col("t") < 1e-10) | (F.col("n") < 2), 1.0).otherwise(h / F.log("n")).alias("entropy"))


def complexity(df: DataFrame, x: Column) -> DataFrame:
    """gini, cv, entropy and complexity = 0.4 gini + 0.3 min(1, cv / 2) + 0.3 (1 - entropy)."""
    parts = gini(df, x).crossJoin(df.agg(cv(x).alias("cv"))).crossJoin(entropy(df, x))
    mixed = 0.4 * F.col("gini") + 0.3 * F.least(F.lit(1.0), F.col("cv") / 2) + 0.3 * (1 - F.col("entropy"))
    return parts.withColumn("complexity", F.least(F.greatest(mixed, F.lit(0.0)), F.lit(1.0)))


def concentration(df: DataFrame, x: Column) -> DataFrame:
    """1 - entropy, and what it says of a query: focused, balanced or exploratory."""
    c = 1 - F.col("entropy")
    intent = F.when(c > 2 / 3, "focused").when(c > 1 / 3, "balanced").otherwise("exploratory")
    return entropy(df, x).select(c.alias("concentration"), intent.alias("intent"))


def middle_way(x: Column, tolerance: float = 0.1) -> list[Column]:
    """Distance of the variation from one half, and whether it is in balance."""
    off = F.abs(cv(x) - 0.5)
    return [off.alias("imbalance"), (off < tolerance).alias("balanced")]


def balance(cv_value: float, alpha: float, beta: float, rate: float = 0.1, *, exponential: bool = False, rounds: int = 1) -> tuple[float, float]:
    """Weights moved against the variation's distance from one half."""
    off = cv_value - 0.5
    for _ in range(rounds):
        if exponential:
            step = min(max(rate * off, -5.0), 5.0)
            alpha, beta = (min(max(w, 0.01), 100.0) for w in (alpha * math.exp(-step), beta * math.exp(step)))
        else:
            alpha, beta = max(alpha - rate * off, 0.01), max(beta + rate * off, 0.01)
    return alpha, beta


def confidence(df: DataFrame, x: Column, selected: Column) -> DataFrame:
    """Sigmoid of how many deviations the selected values' mean lies above that of all."""
    sums = df.agg(F.avg(x).alias("m"), F.stddev_pop(x).alias("s"), F.avg(F.when(selected, x)).alias("ms"))
    z = (F.col("ms") - F.col("m")) / F.col("s")
    return sums.select(F.when(F.col("ms").isNull(), 0.0).when(F.col("s") < 1e-10, 0.5).otherwise(1 / (1 + F.exp(-z))).alias("confidence"))


def best_method(history: DataFrame, last: int = 20, least: int = 3) -> DataFrame:
    """The method (history: seq, method, confidence) of best mean confidence among the last records; ties go to
    the first by name."""
    recent = history.orderBy(F.desc("seq")).limit(last).groupBy("method").agg(F.avg("confidence").alias("mean"), F.count("*").alias("n"))
    return recent.agg(F.min(F.struct((-F.col("mean")).alias("mean"), "method")).alias("best"), F.sum("n").alias("n")).filter(F.col("n") >= least).select(F.col("best.method").alias("method"), (-F.col("best.mean")).alias("confidence"))


def tiers(df: DataFrame, score: str, threshold: float = 0.7, *, flat: float = 1e-12, equal: str = "normal") -> DataFrame:
    """Add tier: critical, normal or background, by the score between the least and the greatest of all; equal if
    all are the same, or less than flat apart."""
    span = df.agg(F.min(score).alias("gleaner_lo"), F.max(score).alias("gleaner_hi"))
    place = (F.col(score) - F.col("gleaner_lo")) / (F.col("gleaner_hi") - F.col("gleaner_lo"))
    same = (F.col("gleaner_hi") == F.col("gleaner_lo")) | (F.col("gleaner_hi") - F.col("gleaner_lo") < flat)
    tier = F.when(same, equal).when(place >= threshold, "critical").when(place >= threshold / 2, "normal").otherwise("background")
    return df.crossJoin(F.broadcast(span)).withColumn("tier", tier).drop("gleaner_lo", "gleaner_hi")


def convergence_thresholds(history: DataFrame, *, bins: int = 20, steps: int = 15, low: float = 0.1, high: float = 0.9) -> DataFrame:
    """One row (t1, t2, t3, score) for history (complexity, converged): the three thresholds that part the bins
    into regions of the highest mean convergence rate; regions without observations don't count.

    Rates are (converged + 1) / (all + 2). Bins count over 0 to 1, but their centers, which the thresholds part,
    lie between low and high. The first of equal triples wins.
    """
    spark = history.sparkSession
    place = F.least(F.floor(F.col("complexity") * bins), F.lit(bins - 1))
    counts = history.groupBy(place.alias("bin")).agg(F.count("*").alias("n"), F.count_if("converged").alias("good"))
    center = low + F.col("bin") * ((high - low) / (bins - 1))
    counts = counts.select(center.alias("center"), "n", (F.col("n") * (F.col("good") + 1) / (F.col("n") + 2)).alias("weighted"))
    at = lambda name: spark.range(steps).select(F.col("id").alias(f"{name}_i"), (low + F.col("id") * ((high - low) / (steps - 1))).alias(name))
    triples = at("t1").join(F.broadcast(at("t2")), F.col("t1_i") < F.col("t2_i")).join(F.broadcast(at("t3")), F.col("t2_i") < F.col("t3_i"))
    region = F.when(F.col("center") < F.col("t1"), 0).when(F.col("center") < F.col("t2"), 1).when(F.col("center") < F.col("t3"), 2).otherwise(3)
    keys = ["t1_i", "t2_i", "t3_i", "t1", "t2", "t3"]
    regions = triples.crossJoin(F.broadcast(counts)).groupBy(*keys, region.alias("region")).agg((F.sum("weighted") / F.sum("n")).alias("rate"))
    scores = regions.groupBy(*keys).agg(F.round(F.avg("rate"), 9).alias("score"))
    return scores.orderBy(F.desc("score"), "t1_i", "t2_i", "t3_i").limit(1).select("t1", "t2", "t3", "score")
