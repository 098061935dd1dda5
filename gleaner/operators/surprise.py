"""Information content of values against a fitted distribution.

A distribution is a row: 51 edges and the shares of the 50 bins between them. It is an aggregate of bounded
size, so scoring is a projection and shuffles nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gleaner.functions.vectors import doubles, norm

BINS, FLOOR = 50, 1e-10


def scalar(df: DataFrame, col: str) -> Column:
    """The column as a number: a vector is its length, anything else a double."""
    kind = df.schema[col].dataType.typeName()
    return norm(doubles(F.col(col))) if kind == "array" else F.col(col).cast("double")


def validate_finite(df: DataFrame, col: str) -> DataFrame:
    """One row: how many values there are, and how many are NaN or infinite."""
    x = F.col(col).cast("double")
    return df.agg(F.count(x).alias("n"), F.count_if(F.isnan(x)).alias("n_nan"), F.count_if(F.abs(x) == float("inf")).alias("n_inf"))


def fit(df: DataFrame, col: str, bins: int = BINS) -> DataFrame:
    """One row (edges, prior, n): an equal-width histogram of a column; constant values get a width of one.

    Bins are half open, the last one closed, and are found by comparing with the edges themselves.
    """
    return _fit(df, scalar(df, col), F.lit(1).cast("long"), bins)


def _fit(df: DataFrame, x: Column, times: Column, bins: int) -> DataFrame:
    span = df.agg(F.min(x).alias("lo"), F.max(x).alias("hi"))
    flat = F.col("hi") - F.col("lo") < 1e-12
    lo, hi = F.when(flat, F.col("lo") - 0.5).otherwise(F.col("lo")), F.when(flat, F.col("hi") + 0.5).otherwise(F.col("hi"))
    edges = span.select(F.transform(F.sequence(F.lit(0), F.lit(bins)), lambda i: F.when(i == bins, hi).otherwise(lo + i * ((hi - lo) / bins))).alias("edges"))
    inner = F.slice("edges", 2, bins - 1)
    counts = df.select(x.alias("x"), times.alias("times")).crossJoin(F.broadcast(edges)).groupBy(F.size(F.filter(inner, lambda e: e <= F.col("x"))).alias("bin")).agg(F.sum("times").alias("n"))
    found = counts.agg(F.map_from_entries(F.collect_list(F.struct("bin", "n"))).alias("m"), F.sum("n").alias("n"))
    share = F.transform(F.sequence(F.lit(0), F.lit(bins - 1)), lambda i: F.coalesce(F.try_element_at("m", i), F.lit(0)) / (F.col("n") + FLOOR))
    return edges.crossJoin(found).select("edges", share.alias("prior"), "n")


def fit_counts(counts: DataFrame, x: str, n: str, bins: int = BINS) -> DataFrame:
    """fit, for a table of different values and how often each is there."""
    return _fit(counts.filter(F.col(x).isNotNull()), F.col(x), F.col(n), bins)


def bin_of(x: Column, edges: Column) -> Column:
    """The bin that a value is looked up in: inner edges strictly below it."""
    return F.size(F.filter(F.slice(edges, 2, F.size(edges) - 2), lambda e: e < x))


def modular_bin(x: Column, bins: int = BINS) -> Column:
    """The bin of a value without fitted edges."""
    return F.pmod(F.floor(F.abs(x * bins)) * F.signum(x), F.lit(float(bins))).cast("int")


def information(p: Column) -> Column:
    return F.greatest(-F.log(F.greatest(p, F.lit(FLOOR)) + FLOOR), F.lit(0.0))


def score(df: DataFrame, col: str, fitted: DataFrame, name: str = "surprise") -> DataFrame:
    """Add the surprise of a column, -ln of its bin's share."""
    rows = df.crossJoin(F.broadcast(fitted.select(F.col("edges").alias("gleaner_edges"), F.col("prior").alias("gleaner_prior"))))
    p = F.get("gleaner_prior", bin_of(scalar(df, col), F.col("gleaner_edges")))
    return rows.withColumn(name, information(p)).drop("gleaner_edges", "gleaner_prior")


def bayesian(df: DataFrame, col: str, order: str, fitted: DataFrame, group: list[str] | None = None) -> DataFrame:
    """How far each value moves the running distribution of all up to it from the prior (a KL divergence).

    Needs an order; with a group, every group runs for itself. Values are counted in modular bins.
    """
    keys = group or []
    along = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    own = Window.partitionBy(*keys, "bin").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    floor = F.lit(FLOOR)
    # with c values in a bin and n in all, the sum of p ln p is (sum of c ln c) / n - ln n: running sums are enough
    rows = df.select(*keys, order, modular_bin(scalar(df, col)).alias("bin")).filter("bin is not null").crossJoin(F.broadcast(fitted.select("prior")))
    logs = F.transform("prior", lambda p: F.log(F.greatest(p, floor)))
    rows = rows.select(*keys, order, "bin", F.get(logs, F.col("bin")).alias("q"), F.aggregate(logs, F.lit(0.0), lambda a, x: a + x).alias("all_q"), F.size("prior").alias("bins"))
    rows = rows.withColumn("c", F.count("*").over(own))
    x_ln_x = lambda c: F.when(c > 0, c * F.log(F.greatest(c, F.lit(1)))).otherwise(0.0)
    first = F.col("c") == 1
    total = lambda x: F.sum(x).over(along)
    rows = rows.select(*keys, order, "all_q", "bins", F.count("*").over(along).alias("n"), total(x_ln_x(F.col("c")) - x_ln_x(F.col("c") - 1)).alias("s"), total(F.col("q")).alias("sq"), total(F.when(first, F.col("q")).otherwise(0.0)).alias("seen_q"), total(first.cast("int")).alias("seen"))
    known = F.col("s") / F.col("n") - F.log("n") - F.col("sq") / F.col("n")
    empty = FLOOR * ((F.col("bins") - F.col("seen")) * F.log(floor) - (F.col("all_q") - F.col("seen_q")))
    return rows.select(*keys, order, F.greatest(known + empty, F.lit(0.0)).alias("surprise"))
