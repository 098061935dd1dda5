"""Sparse matrices as edge tables (src long, dst long, w double)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def from_dense(rows: DataFrame, id_col: str = "id", row_col: str = "row") -> DataFrame:
    """Edges of a matrix given as one array a row, without zeros."""
    return rows.select(F.col(id_col).cast("long").alias("src"), F.posexplode(row_col).alias("dst", "w")).select("src", F.col("dst").cast("long").alias("dst"), F.col("w").cast("double").alias("w")).filter("w <> 0")


def scaled(edges: DataFrame, factor: float) -> DataFrame:
    return edges.withColumn("w", F.col("w") * factor)


def resized(edges: DataFrame, n: int) -> DataFrame:
    return edges.filter((F.col("src") < n) & (F.col("dst") < n))


def without_loops(edges: DataFrame) -> DataFrame:
    return edges.filter("src <> dst")


def summed(edges: DataFrame) -> DataFrame:
    return edges.groupBy("src", "dst").agg(F.sum("w").alias("w"))


def symmetric(edges: DataFrame) -> DataFrame:
    """(A + A') / 2 without loops: each edge is halved and counted in both directions."""
    half = without_loops(edges).select("src", "dst", (F.col("w") / 2).alias("w"))
    return summed(half.unionByName(half.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "w")))


def purified(edges: DataFrame, tolerance: float = 1e-10) -> DataFrame:
    """Finite, non-zero edges without loops, duplicates summed; averaged with the transpose if the two differ.

    Averaging a symmetric matrix changes nothing, so one plan serves both cases; what differs by no more than
    the tolerance is left as it is.
    """
    good = summed(edges.filter(~F.isnan("w") & (F.abs("w") < float("inf")) & (F.col("src") != F.col("dst")) & (F.col("w") != 0)))
    ways = good.select("src", "dst", "w", F.lit(0.0).alias("back")).unionByName(good.select(F.col("dst").alias("src"), F.col("src").alias("dst"), F.lit(0.0).alias("w"), F.col("w").alias("back")))
    both = ways.groupBy("src", "dst").agg(F.sum("w").alias("w"), F.sum("back").alias("back"))
    return both.select("src", "dst", F.when(F.abs(F.col("w") - F.col("back")) > tolerance, (F.col("w") + F.col("back")) / 2).otherwise(F.col("w")).alias("w")).filter("w <> 0")


def times_vector(edges: DataFrame, vector: DataFrame) -> DataFrame:
    """(id, y) = J v, for a vector (id, v); rows without entries are left out."""
    return edges.join(vector, F.col("dst") == F.col("id")).groupBy("src").agg(F.sum(F.col("w") * F.col("v")).alias("y")).select(F.col("src").alias("id"), "y")


def quadratic_form(left: DataFrame, edges: DataFrame, right: DataFrame) -> DataFrame:
    """One row: left' J right."""
    a, b = left.toDF("a_id", "a"), right.toDF("b_id", "b")
    both = edges.join(a, F.col("src") == F.col("a_id")).join(b, F.col("dst") == F.col("b_id"))
    return both.agg(F.coalesce(F.sum(F.col("w") * F.col("a") * F.col("b")), F.lit(0.0)).alias("value"))


def row_added(target: DataFrame, edges: DataFrame, row: int, scale: float) -> DataFrame:
    """target (id, v) with scale times a row of J added."""
    entries = edges.filter(F.col("src") == row).groupBy("dst").agg(F.sum("w").alias("w"))
    return target.join(entries, F.col("id") == F.col("dst"), "left").select("id", (F.col("v") + scale * F.coalesce("w", F.lit(0.0))).alias("v"))


def column_of(edges: DataFrame, k: int) -> DataFrame:
    return edges.filter(F.col("dst") == k).select(F.col("src").alias("id"), "w")


def product(a: DataFrame, b: DataFrame) -> DataFrame:
    """The product of two sparse matrices."""
    right = b.toDF("k", "out", "w2")
    return a.join(right, F.col("dst") == F.col("k")).groupBy("src", "out").agg(F.sum(F.col("w") * F.col("w2")).alias("w")).select("src", F.col("out").alias("dst"), "w")


def conditioned(edges: DataFrame, relevance: DataFrame) -> DataFrame:
    """w * rel(src) * rel(dst), for relevance (id, rel); who has none has 0."""
    a, b = relevance.toDF("a_id", "ra"), relevance.toDF("b_id", "rb")
    both = edges.join(a, F.col("src") == F.col("a_id"), "left").join(b, F.col("dst") == F.col("b_id"), "left")
    return both.select("src", "dst", (F.col("w") * F.coalesce("ra", F.lit(0.0)) * F.coalesce("rb", F.lit(0.0))).alias("w"))


def subgraph(edges: DataFrame, ids: DataFrame) -> DataFrame:
    """Edges between chosen nodes (id, place), named by their places."""
    a, b = ids.toDF("a_id", "a"), ids.toDF("b_id", "b")
    return edges.join(a, F.col("src") == F.col("a_id")).join(b, F.col("dst") == F.col("b_id")).select(F.col("a").alias("src"), F.col("b").alias("dst"), "w")


# typed edges: (src, dst, relation, strength, seq)

#: Relations that count double when the dominant condition is sought.
DOMINANT = ["adhipati", "upanissaya"]


def origins(edges: DataFrame, node) -> DataFrame:
    """In-edges of a node by relation, in the order they were added."""
    entry = F.format_string("%s (strength=%.2f)", "src", "strength")
    found = edges.filter(F.col("dst") == node).groupBy("relation").agg(F.array_sort(F.collect_list(F.struct("seq", entry.alias("text")))).alias("e"))
    return found.select("relation", F.array_join(F.transform("e", lambda x: x["text"]), "; ").alias("origins"))


def dominant_origin(edges: DataFrame) -> DataFrame:
    """For each node, its strongest in-edge; some relations count double, the earliest edge wins ties."""
    value = F.col("strength") * F.when(F.col("relation").isin(*DOMINANT), 2.0).otherwise(1.0)
    best = edges.groupBy("dst").agg(F.max_by(F.struct("src", "relation"), F.struct(value, -F.col("seq"))).alias("best"))
    return best.select("dst", F.concat_ws(" via ", "best.src", "best.relation").alias("origin"))


def predecessors(edges: DataFrame) -> DataFrame:
    """Different predecessors of each node, in the order they were first seen."""
    first = edges.groupBy("dst", "src").agg(F.min("seq").alias("seq"))
    return first.groupBy("dst").agg(F.transform(F.array_sort(F.collect_list(F.struct("seq", "src"))), lambda x: x["src"]).alias("predecessors"))


def causal_retrieval(docs: DataFrame, edges: DataFrame, context, similarity: Column, k: int, *, boost: float = 0.5, penalty: float = 0.3) -> DataFrame:
    """The k documents (id, karma) of best similarity, after a boost for those that lead to the context and a
    penalty for those of bad record."""
    ahead = edges.filter(F.col("dst") == context).select(F.col("src").alias("ahead")).distinct()
    score = similarity + F.when(F.col("ahead").isNotNull(), boost).otherwise(0.0) - F.when(F.col("karma") < -0.5, penalty).otherwise(0.0)
    return docs.join(ahead, F.col("id") == F.col("ahead"), "left").select("id", score.alias("score")).orderBy(F.desc("score"), "id").limit(k)


def added(edges: DataFrame, src, dst, relation: str, strength: float = 1.0) -> DataFrame:
    """Typed edges with one more, the latest in order."""
    seq = edges.agg((F.coalesce(F.max("seq"), F.lit(-1)) + 1).alias("seq"))
    new = seq.select(F.lit(src).alias("src"), F.lit(dst).alias("dst"), F.lit(relation).alias("relation"), F.lit(strength).alias("strength"), "seq")
    return edges.select("src", "dst", "relation", "strength", "seq").unionByName(new)


# conductances of a crossbar: (src, dst, g)

G_MIN, G_MAX = 1e-6, 1e-3


def programmed(edges: DataFrame, *, bits: int = 0) -> DataFrame:
    """Conductances of weights: G_MAX times the weight, on a grid of 2^bits steps from G_MIN if bits is given."""
    g = F.col("w") * G_MAX
    if bits:
        step = (G_MAX - G_MIN) / 2**bits
        g = F.signum(g) * (F.rint((F.abs(g) - G_MIN) / step) * step + G_MIN)
    return edges.filter(F.abs("w") >= 1e-10).select("src", "dst", g.alias("g"))


def weights_of(cells: DataFrame) -> DataFrame:
    return cells.filter(F.abs("g") >= 1e-10).select("src", "dst", (F.col("g") / G_MAX).alias("w"))


def currents(cells: DataFrame, inputs: DataFrame) -> DataFrame:
    """(id, y): the sum of conductance times input (id, v) at every output."""
    return cells.join(inputs, F.col("src") == F.col("id")).groupBy("dst").agg(F.sum(F.col("g") * F.col("v")).alias("y")).select(F.col("dst").alias("id"), "y")


def hebbian(cells: DataFrame, before: DataFrame, after: DataFrame, rate: float) -> DataFrame:
    """Conductances moved by rate * before * after (id, v) and cut to their range on either side of zero. Every
    pair of an active input and an active output is a cell, so both sides are as small as the crossbar's."""
    active = lambda t, a, b: t.filter(F.abs("v") >= 1e-8).select(F.col("id").alias(a), F.col("v").alias(b))
    moved = active(before, "src", "a").join(active(after, "dst", "b")).select("src", "dst", (rate * F.col("a") * F.col("b")).alias("change"))
    both = cells.join(moved, ["src", "dst"], "full").withColumn("new", F.coalesce("g", F.lit(0.0)) + F.coalesce("change", F.lit(0.0)))
    size = F.least(F.greatest(F.abs("new"), F.lit(G_MIN)), F.lit(G_MAX))
    g = F.when(F.col("change").isNull(), F.col("g")).otherwise(F.signum("new") * size)
    return both.select("src", "dst", g.alias("g")).filter(F.abs("g") > 1e-15)


def crossbar_stats(cells: DataFrame, rows: int, cols: int) -> DataFrame:
    """One row: all cells, those that conduct, and the sum, mean and greatest of their conductances."""
    g = F.abs("g")
    on = cells.filter(g > 1e-10)
    return on.agg(F.lit(rows * cols).cast("long").alias("cells"), F.count("*").alias("active"), F.coalesce(F.sum(g), F.lit(0.0)).alias("total"), F.coalesce(F.avg(g), F.lit(0.0)).alias("mean"), F.coalesce(F.max(g), F.lit(0.0)).alias("most"))
