"""Connected components by alternating large and small stars, a few shuffles a round; few links, whose number
is checked, are joined in one task instead."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleaner.llm.common import frugal, stash
from gleaner.session import ship

MAX_ROUNDS = 60
#: Links that one task joins at most (16 bytes each).
TASK_LINKS = 300_000


def _large_star(edges: DataFrame) -> DataFrame:
    """Every larger neighbour of a vertex points at the least of the vertex and its neighbours."""
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("u"), F.least("a", "m").alias("m"))
    return both.join(least, both["a"] == least["u"]).filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))


def _small_star(edges: DataFrame) -> DataFrame:
    """A vertex and its smaller neighbours point at the least of them."""
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = down.groupBy("a").agg(F.min("b").alias("m"))
    others = down.join(least.withColumnRenamed("a", "u"), F.col("a") == F.col("u")).select(F.col("b").alias("a"), F.col("m").alias("b"))
    return others.unionByName(least.select("a", F.col("m").alias("b"))).filter("a <> b")


def _least_labels(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Labels take the least around them and then their label's label, until nothing changes."""
    pairs = [(b.column("a").to_numpy(), b.column("b").to_numpy()) for b in batches if b.num_rows]
    if not pairs:
        return
    a, b = (np.concatenate(x) for x in zip(*pairs, strict=True))
    vertex, place = np.unique(np.concatenate((a, b)), return_inverse=True)
    a, b, label = place[: len(a)], place[len(a) :], np.arange(len(vertex))
    while True:
        new, least = label.copy(), np.minimum(label[a], label[b])
        np.minimum.at(new, a, least)
        np.minimum.at(new, b, least)
        new = new[new]
        if (new == label).all():
            break
        label = new
    yield pa.record_batch([pa.array(vertex), pa.array(vertex[label])], ["vertex", "label"])


def components(edges: DataFrame) -> DataFrame:
    """vertex and label, the least vertex of its component, for every vertex that edges (a, b long) join to another.

    Each round is written to the shared folder; the loop ends when a round changes nothing.
    """
    edges = stash(edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    if edges.count() <= TASK_LINKS:
        ship(edges.sparkSession)
        return stash(edges.coalesce(1).mapInArrow(frugal(_least_labels), "vertex long, label long"), "labels")
    mark = lambda e: tuple(e.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first())
    was = mark(edges)
    for _ in range(MAX_ROUNDS):
        if not was[0]:
            break
        edges = stash(_small_star(_large_star(edges)).distinct(), "edges")
        now = mark(edges)
        if now == was:
            break
        was = now
    else:
        raise RuntimeError(f"components haven't settled after {MAX_ROUNDS} rounds")
    return edges.select(F.col("a").alias("vertex"), F.col("b").alias("label")).unionByName(edges.select(F.col("b").alias("vertex"), F.col("b").alias("label")).distinct())
