"""Associative memory: patterns (id, pattern, strength, access_count, ts) as a table."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gleaner.functions.text import code_points
from gleaner.functions.vectors import cosine, doubles, fitted
from gleaner.operators import kernels
from gleaner.session import ship


def stored(memory: DataFrame, new: DataFrame, capacity: int, order: str = "id") -> DataFrame:
    """Memory with new patterns, the oldest dropped over capacity."""
    return memory.unionByName(new).orderBy(F.desc(order)).limit(capacity)


def decayed(memory: DataFrame, rate: float, floor: float = 0.01) -> DataFrame:
    """Strengths shrunk by a rate; patterns at the floor or under it are forgotten."""
    return memory.withColumn("strength", F.col("strength") * (1 - rate)).filter(F.col("strength") > floor)


def nearest(memory: DataFrame, cue: Column, k: int) -> DataFrame:
    """(id, match): the k patterns of greatest cosine times strength."""
    return memory.select("id", (cosine(doubles(F.col("pattern")), cue) * F.col("strength")).alias("match")).orderBy(F.desc("match"), "id").limit(k)


def associations(patterns: DataFrame, rate: float, converged: str | None = None) -> DataFrame:
    """(i, j, w): -rate * x_i x_j summed over patterns, i and j different; only converged ones if named."""
    rows = patterns.filter(F.col(converged)) if converged else patterns
    a = rows.select(F.col("pattern").alias("v"), F.posexplode("pattern").alias("i", "a"))
    pairs = a.select("i", "a", F.posexplode("v").alias("j", "b")).filter("i <> j")
    return pairs.groupBy("i", "j").agg((-rate * F.sum(F.col("a") * F.col("b"))).alias("w"))


def recalled(memory: DataFrame, cues: DataFrame, *, capacity: int = 200, steps: int = 10, beta: float = 1.0) -> DataFrame:
    """(cue, id, state): what each cue (cue, pattern) settles on, and the pattern with most weight.

    The memory that takes part is its strongest patterns, capacity of them, which are collected once.
    """
    ship(memory.sparkSession)
    rows = memory.orderBy(F.desc("strength"), "id").limit(capacity).select("id", doubles(F.col("pattern")).alias("pattern"), "strength").toPandas()  # bounded by capacity
    patterns, strengths, ids = np.array(rows["pattern"].tolist(), float), rows["strength"].to_numpy(float), rows["id"].to_numpy()

    def run(batches):
        for batch in batches:
            found = [kernels.recall(patterns, strengths, np.asarray(v, float), steps=steps, beta=beta) for v in batch["pattern"]]
            yield pd.DataFrame({"cue": batch["cue"], "id": [int(ids[w.argmax()]) for _, w in found], "state": [s for s, _ in found]})

    return cues.select("cue", doubles(F.col("pattern")).alias("pattern")).mapInPandas(run, "cue long, id long, state array<double>")


def text_cue(text: Column, n: int) -> Column:
    """The low bit of each character's code point, as -1 or 1, in n places; zeros where the text ends."""
    bits = F.transform(code_points(text, 2), lambda b: F.lit(2.0) * b - 1)
    return fitted(bits, n)


def context(messages: DataFrame, relevance: str, *, recent: int = 3, limit: int = 20) -> DataFrame:
    """The messages (conv_id, turn, relevance) of each conversation that go into a prompt: the last few, and of
    the others the most relevant, up to the limit, in order of turns."""
    newest = F.row_number().over(Window.partitionBy("conv_id").orderBy(F.desc("turn")))
    rows = messages.withColumn("gleaner_age", newest)
    best = Window.partitionBy("conv_id", F.col("gleaner_age") <= recent).orderBy(F.desc(relevance), "turn")
    rows = rows.withColumn("gleaner_rank", F.row_number().over(best))
    return rows.filter((F.col("gleaner_age") <= recent) | (F.col("gleaner_rank") <= limit - recent)).drop("gleaner_age", "gleaner_rank")


def consolidated(memory: DataFrame, *, strong: float = 0.5, rate: float = 0.01, floor: float = 0.05, blends: int = 3, noise: float = 0.01, seed: int = 0) -> DataFrame:
    """Memory after sleep: strong patterns replayed once from a snapshot, a few blends of random pairs with
    noise, then decay and pruning."""
    replay = memory.filter(F.col("strength") >= strong).withColumn("strength", F.col("strength") * 0.9)
    drawn = memory.orderBy(F.xxhash64(F.lit(seed), F.col("id")), "id").limit(2 * blends).withColumn("place", F.row_number().over(Window.orderBy(F.xxhash64(F.lit(seed), F.col("id")), "id")))
    pair = F.floor((F.col("place") - 1) / 2)
    cells = drawn.select(pair.alias("pair"), "id", F.posexplode(doubles(F.col("pattern"))).alias("pos", "x"))
    mixed = cells.groupBy("pair", "pos").agg((F.avg("x") + noise * (2 * F.pmod(F.xxhash64(F.lit(seed), F.min("id"), F.col("pos")), F.lit(1000)) / 1000 - 1)).alias("x"), F.min("id").alias("a"))
    blend = mixed.groupBy("pair").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "x"))), lambda e: e["x"]).alias("pattern"), F.min("a").alias("id"))
    blend = blend.select("id", "pattern", F.lit(0.5).alias("strength"))
    columns = ["id", "pattern", "strength"]
    all_ = memory.select(*columns[:1], doubles(F.col("pattern")).alias("pattern"), "strength").unionByName(replay.select("id", doubles(F.col("pattern")).alias("pattern"), "strength")).unionByName(blend)
    return decayed(all_, rate, floor)


def folded_cue(text: str, n: int) -> list[float]:
    """The low bits of a text's code points, added up in n places round and round, over their greatest."""
    cue = np.zeros(n)
    np.add.at(cue, np.arange(len(text)) % n, [ord(c) & 1 for c in text])
    return (cue / (cue.max() + 1e-12) if cue.max() > 0 else cue).tolist()


def search_by_text(memory: DataFrame, text: str, k: int = 5, *, capacity: int = 200) -> DataFrame:
    """(id, similarity): the k patterns nearest to what the memory recalls for a text."""
    first = memory.select(F.size("pattern").alias("n")).first()
    if first is None:
        return memory.sparkSession.createDataFrame([], "id long, similarity double")
    cue = memory.sparkSession.createDataFrame([(0, folded_cue(text, first["n"]))], "cue long, pattern array<double>")
    state = recalled(memory, cue, capacity=capacity).select(F.col("state").alias("gleaner_state"))  # one row
    rows = memory.crossJoin(F.broadcast(state))
    return rows.select("id", cosine(doubles(F.col("pattern")), F.col("gleaner_state")).alias("similarity")).orderBy(F.desc("similarity"), "id").limit(k)
