"""Drift over ordered observations: windows are counted in rows.

All windows take optional group columns. Without one the order is total, and Spark sorts it in one task; give a
group (a stream, a user, a day) wherever the input is large.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gleaner.functions.vectors import TINY, cosine, doubles
from gleaner.plans.scratch import bounded


def window_drift(df: DataFrame, x: str, order: str, *, baseline: Column, size: int = 100, threshold: float = 2.0, group: list[str] | None = None) -> DataFrame:
    """Add z: how many baseline deviations the mean of the last rows lies from the baseline's, and drifting."""
    keys = group or []
    base = df.filter(baseline).groupBy(*keys).agg(F.avg(x).alias("base_mean"), F.greatest(F.stddev_pop(x), F.lit(TINY)).alias("base_std"))
    rows = df.filter(~baseline)
    rows = rows.join(bounded(base), keys) if keys else rows.crossJoin(F.broadcast(base))
    mean = F.avg(x).over(Window.partitionBy(*keys).orderBy(order).rowsBetween(1 - size, 0))
    return rows.withColumn("z", F.abs(mean - F.col("base_mean")) / F.col("base_std")).withColumn("drifting", F.col("z") > threshold).drop("base_mean", "base_std")


def semantic_drift(df: DataFrame, vector: str, order: str, *, baseline: Column, size: int = 200, threshold: float = 0.3) -> DataFrame:
    """(order, shift, variance_ratio, cosine_drift, score, drifting) for each row after the baseline: how far the
    last vectors' centre and spread are from the baseline's. Dimensions are windowed side by side."""
    base = df.filter(baseline).select(F.posexplode(doubles(F.col(vector))).alias("pos", "x")).groupBy("pos").agg(F.avg("x").alias("c"), F.var_pop("x").alias("v"))
    cells = df.filter(~baseline).select(order, F.posexplode(doubles(F.col(vector))).alias("pos", "x"))
    last = Window.partitionBy("pos").orderBy(order).rowsBetween(1 - size, 0)
    cells = cells.select(order, "pos", F.avg("x").over(last).alias("wc"), F.var_pop("x").over(last).alias("wv")).join(F.broadcast(base), "pos")
    sums = cells.groupBy(order).agg(
        F.sqrt(F.sum(F.pow(F.col("wc") - F.col("c"), 2))).alias("apart"),
        F.greatest(F.sqrt(F.sum(F.col("c") * F.col("c"))), F.lit(TINY)).alias("base_norm"),
        F.greatest(F.sqrt(F.sum(F.col("wc") * F.col("wc"))), F.lit(TINY)).alias("norm"),
        F.sum(F.col("c") * F.col("wc")).alias("dot"),
        (F.greatest(F.avg("wv"), F.lit(TINY)) / F.greatest(F.avg("v"), F.lit(TINY))).alias("variance_ratio"),
    )
    shift = F.col("apart") / F.col("base_norm")
    turn = 1 - F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.col("dot") / (F.col("base_norm") * F.col("norm"))))
    half = lambda v: F.least(v, F.lit(2.0)) / 2
    rows = sums.select(order, shift.alias("shift"), "variance_ratio", turn.alias("cosine_drift"))
    score = 0.4 * half(F.col("shift")) + 0.2 * half(F.abs(1 - F.col("variance_ratio"))) + 0.4 * half(F.col("cosine_drift"))
    return rows.withColumn("score", score).withColumn("drifting", F.col("score") > threshold)


def stale(patterns: DataFrame, centroid: Column, k: int, *, id_col: str = "id", vector: str = "v") -> DataFrame:
    """The k stored vectors that lie farthest from where the window is: (id, staleness)."""
    return patterns.select(F.col(id_col).alias("id"), (1 - cosine(doubles(F.col(vector)), centroid)).alias("staleness")).orderBy(F.desc("staleness"), "id").limit(k)


def pattern_weight(vector: Column, centroid: Column) -> Column:
    return F.least(F.greatest((cosine(vector, centroid) + 1) / 2, F.lit(0.0)), F.lit(1.0))


def decay_rate(drifting: Column, score: Column, base: float = 0.01) -> Column:
    return F.when(drifting, base * 5 * F.greatest(score, F.lit(1.0))).otherwise(base)


def alerts(df: DataFrame, order: str, metrics: list[str], *, warning: float = 0.05, critical: float = 0.15, cooldown: str = "60 seconds", group: list[str] | None = None) -> DataFrame:
    """(metric, order, previous, current, delta, severity): changes of a metric from one row to the next of at
    least the warning size, unless the metric's last alert is more recent than the cool-down.

    A change that comes a cool-down or more after the change before it is an alert whatever came earlier, so
    changes are cut into runs there, and only a run is folded in order.
    """
    keys = [*(group or []), "metric"]
    long = df.select(*(group or []), order, F.explode(F.create_map(*[c for m in metrics for c in (F.lit(m), F.col(m).cast("double"))])).alias("metric", "current"))
    along = Window.partitionBy(*keys).orderBy(order)
    rows = long.withColumn("previous", F.lag("current").over(along)).withColumn("delta", F.col("current") - F.col("previous"))
    rows = rows.filter(F.abs("delta") >= warning)
    wait = F.expr(f"INTERVAL {cooldown}")
    apart = F.coalesce(F.col(order) >= F.lag(order).over(along) + wait, F.lit(True))
    rows = rows.withColumn("gleaner_run", F.sum(apart.cast("int")).over(along.rowsBetween(Window.unboundedPreceding, 0)))
    change = F.struct(F.col(order).alias("at"), "previous", "current", "delta")
    folded = rows.groupBy(*keys, "gleaner_run").agg(F.array_sort(F.collect_list(change)).alias("changes"))
    raised = F.aggregate("changes", F.slice("changes", 1, 0), lambda kept, c: F.when((F.size(kept) == 0) | (c["at"] >= F.element_at(kept, -1)["at"] + wait), F.concat(kept, F.array(c))).otherwise(kept))
    out = folded.select(*keys, F.explode(raised).alias("a")).select(*keys, F.col("a.at").alias(order), "a.previous", "a.current", "a.delta")
    return out.withColumn("severity", F.when(F.abs("delta") >= critical, "critical").otherwise("warning"))


#: Rows of a block whose prefixes are folded.
SMOOTHED_BLOCK = 64


def smoothed(df: DataFrame, x: str, order: str, *, keep: float = 0.55, start: float = 0.25, group: list[str] | None = None, name: str = "smoothed") -> DataFrame:
    """Add keep * last + (1 - keep) * x, row after row from a start, for one group's rows in order.

    Rows are folded inside short blocks from zero; the blocks' ends are folded likewise with keep to the power of
    the block's length, and each row adds its share of what the blocks before it left. Blocks that lie so far
    back that their share is under the least double are not visited.
    """
    keys = [*(group or [])]
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(order)) - 1
    rows = df.withColumn("gleaner_i", place).withColumn("gleaner_block", F.floor(F.col("gleaner_i") / SMOOTHED_BLOCK)).withColumn("gleaner_j", F.col("gleaner_i") % SMOOTHED_BLOCK + 1)
    inside = Window.partitionBy(*keys, "gleaner_block").orderBy("gleaner_i").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("gleaner_own", F.aggregate(F.collect_list(x).over(inside), F.lit(0.0), lambda s, v: s * keep + v * (1 - keep)))
    whole = keep**SMOOTHED_BLOCK
    reach = math.ceil(745 / -math.log(whole)) if 0 < whole < 1 else 1
    ends = rows.filter(F.col("gleaner_j") == SMOOTHED_BLOCK).select(*keys, (F.col("gleaner_block") + 1).alias("gleaner_block"), "gleaner_own")
    back = Window.partitionBy(*keys).orderBy("gleaner_block").rowsBetween(1 - reach, 0)
    carried = F.aggregate(F.collect_list("gleaner_own").over(back), F.lit(0.0), lambda s, v: s * whole + v) + start * F.pow(F.lit(whole), F.col("gleaner_block"))
    ends = ends.select(*keys, "gleaner_block", carried.alias("gleaner_carried"))
    before = F.when(F.col("gleaner_block") == 0, float(start)).otherwise(F.col("gleaner_carried"))
    out = rows.join(ends, [*keys, "gleaner_block"], "left").withColumn(name, F.col("gleaner_own") + F.pow(F.lit(float(keep)), F.col("gleaner_j")) * before)
    return out.select(*df.columns, name) if name not in df.columns else out.select(*df.columns)


def outer_product_memory(df: DataFrame, vector: str, success: str, order: str, *, rate: float, decay: float = 0.98, failed: float = 0.5) -> DataFrame:
    """(i, j, w): sum of rate * x x' for successes and -failed * rate * x x' for failures, all decayed by every
    later row and the row itself. The decay has a closed form, so nothing is folded in order, and rows so far
    back that it is under the least double add nothing and are left out, which bounds what is ordered."""
    last = math.ceil(745 / -math.log(decay)) if 0 < decay < 1 else None
    rows = df.select(vector, success, order)
    rows = rows.orderBy(F.desc(order)).limit(last) if last else rows
    rows = rows.select(vector, success, F.row_number().over(Window.orderBy(F.desc(order))).alias("age"))
    weight = F.when(F.col(success), rate).otherwise(-failed * rate) * F.pow(F.lit(decay), F.col("age"))
    a = rows.select(weight.alias("c"), F.col(vector).alias("v"), F.posexplode(vector).alias("i", "a"))
    return a.select("c", "i", "a", F.posexplode("v").alias("j", "b")).groupBy("i", "j").agg(F.sum(F.col("c") * F.col("a") * F.col("b")).alias("w"))


def liveness(df: DataFrame, x: str, order: str, *, bound: float = 10.0, size: int = 10, group: list[str] | None = None) -> DataFrame:
    """Add health: not_finite, out_of_bounds, stalled (the last rows don't vary) or healthy."""
    last = Window.partitionBy(*(group or [])).orderBy(order).rowsBetween(1 - size, 0)
    v = F.col(x)
    stalled = (F.count(v).over(last) == size) & (F.var_pop(v).over(last) <= 1e-12)
    return df.withColumn("health", F.when(F.isnan(v) | (F.abs(v) == float("inf")), "not_finite").when(F.abs(v) > bound, "out_of_bounds").when(stalled, "stalled").otherwise("healthy"))


def turn_monitor(df: DataFrame, vector: str, order: str, dims: int, *, size: int = 50, least: int = 20, every: int = 20, drift_at: float = 1.5, surprise_at: float = 2.0, group: list[str] | None = None) -> DataFrame:
    """(group, order, drift, surprise, suggestion) of each turn of every conversation (group).

    The baseline is the first half of the turns, twenty at least, as of the last turn whose number is a
    multiple of twenty; running sums by turn give its moments without folding.
    """
    keys = [*(group or [])]
    turns = df.select(*keys, order, vector, F.row_number().over(Window.partitionBy(*keys).orderBy(order)).alias("t"))
    cells = turns.select(*keys, "t", F.posexplode(vector).alias("pos", "x"))
    run = Window.partitionBy(*keys, "pos").orderBy("t")
    last, ten = run.rowsBetween(1 - size, 0), run.rowsBetween(-9, 0)
    cells = cells.select(*keys, "t", "pos", "x", F.sum("x").over(run).alias("s1"), F.sum(F.col("x") * F.col("x")).over(run).alias("s2"), F.avg("x").over(last).alias("wm"), F.stddev_pop("x").over(last).alias("ws"), F.stddev_pop("x").over(ten).alias("rs"))
    refit = F.greatest(F.lit(least), F.floor(F.col("t") / every) * every)
    until = F.greatest(F.lit(20), F.floor(refit / 2)).cast("int")
    marks = cells.select(*keys, "pos", F.col("t").alias("until"), F.col("s1").alias("b1"), F.col("s2").alias("b2"))
    both = cells.withColumn("until", until).join(marks, [*keys, "pos", "until"])
    mean = F.col("b1") / F.col("until")
    std = F.greatest(F.sqrt(F.greatest(F.col("b2") / F.col("until") - mean * mean, F.lit(0.0))), F.lit(1e-6))
    sums = both.filter(F.col("t") >= least).groupBy(*keys, "t").agg(F.avg(F.abs(F.col("wm") - mean) / std).alias("drift"), F.avg(F.abs(F.col("x") - F.col("wm")) / F.greatest("ws", F.lit(1e-6))).alias("surprise"), (F.sum("rs") / 5).alias("variety"))
    rows = turns.select(*keys, order, "t").join(sums, [*keys, "t"], "left")
    suggestion = F.when(F.col("variety") < 0.05, "sleep").when((F.col("surprise") > surprise_at) & (F.col("surprise") > 3.0), "hyper")
    return rows.select(*keys, order, F.coalesce("drift", F.lit(0.0)).alias("drift"), F.coalesce("surprise", F.lit(0.0)).alias("surprise"), suggestion.alias("suggestion"), (F.coalesce("drift", F.lit(0.0)) > drift_at).alias("drifting"))
