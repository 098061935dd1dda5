"""Top-k, cascades and nearest neighbours."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gleaner.functions.vectors import doubles, unit
from gleaner.plans.scratch import stash
from gleaner.session import ship


def top_k(df: DataFrame, score: str, k: int, id_col: str = "id", *, smallest: bool = False) -> DataFrame:
    """The k rows of best score; ties go to the smaller id."""
    return df.orderBy(F.asc(score) if smallest else F.desc(score), id_col).limit(k)


def clamped(k: int, n: int) -> int:
    """k, but no more than there are rows."""
    if k < 1:
        raise ValueError(f"k must be at least 1, not {k}")
    return min(k, n)


def cascade(df: DataFrame, score: str, k: int, *, buffer: int = 10_000, keep: float = 0.05, id_col: str = "id") -> tuple[DataFrame, DataFrame]:
    """The k best of the best share of the buffer's best, and the sizes of the levels.

    The last level's objective is linear in the scores, so it is a top-k too.
    """
    n = df.count()
    first = min(buffer, n)
    second = min(first, max(k, int(first * keep)))
    rows = top_k(top_k(top_k(df, score, first, id_col), score, second, id_col), score, k, id_col)
    levels = [(0, n), (1, first), (2, second), (3, min(k, second))]
    stats = df.sparkSession.createDataFrame([(a, b, levels[0][1] / max(b, 1)) for a, b in levels], "level int, size long, reduction double")
    return rows, stats


def softmax(df: DataFrame, logit: str, *, beta: float = 1.0, name: str = "p") -> DataFrame:
    """Add exp(beta * logit) over the sum of all, in a stable way."""
    top = df.agg(F.max(F.col(logit) * beta).alias("gleaner_top"))
    rows = df.crossJoin(F.broadcast(top)).withColumn("gleaner_e", F.exp(F.col(logit) * beta - F.col("gleaner_top")))
    total = rows.agg(F.sum("gleaner_e").alias("gleaner_total"))
    return rows.crossJoin(F.broadcast(total)).withColumn(name, F.col("gleaner_e") / F.col("gleaner_total")).drop("gleaner_top", "gleaner_e", "gleaner_total")


def sampling_distribution(logits: DataFrame, *, temperature: float = 1.0, top: int = 0, nucleus: float = 1.0, repeated: Column | None = None, penalty: float = 1.0) -> DataFrame:
    """(token_id, p): repetition penalty, temperature, softmax, top-k, then the smallest set that reaches the
    nucleus share, but for the rounding of sums; probabilities of what is left sum to one. The vocabulary is one
    distribution, of bounded size."""
    logit = F.col("logit")
    if repeated is not None:
        logit = F.when(repeated, F.when(logit > 0, logit / penalty).otherwise(logit * penalty)).otherwise(logit)
    rows = softmax(logits.select("token_id", (logit / temperature).alias("logit")), "logit")
    best = Window.orderBy(F.desc("p"), "token_id")
    if top > 0:
        rows = rows.orderBy(F.desc("p"), "token_id").limit(top)
    before = F.coalesce(F.sum("p").over(best.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    everything = Window.partitionBy()
    rows = rows.withColumn("p", F.col("p") / F.sum("p").over(everything))
    if 0 < nucleus < 1:
        rows = rows.withColumn("before", before).filter(F.col("before") < nucleus - 1e-10)
    return rows.select("token_id", (F.col("p") / F.sum("p").over(everything)).alias("p"))


def draw(distribution: DataFrame, u: float) -> DataFrame:
    """The first token, by id, at which the summed probability reaches u."""
    along = Window.orderBy("token_id").rowsBetween(Window.unboundedPreceding, 0)
    return distribution.withColumn("upto", F.sum("p").over(along)).filter(F.col("upto") >= u).agg(F.min("token_id").alias("token_id"))


def vectors_of(lists: pa.ChunkedArray) -> np.ndarray:
    """A matrix of a column of lists of equal length, without a Python object for each number."""
    flat = lists.combine_chunks()
    return flat.flatten().to_numpy(zero_copy_only=False).reshape(len(flat), -1) if len(flat) else np.zeros((0, 0))


def _nearest(k: int):
    """For a tile of rows that ask and rows that are stored: the k best positive cosines of each that asks."""
    schema = pa.schema([("src", pa.int64()), ("dst", pa.int64()), ("w", pa.float64())])

    def run(tile: pa.Table) -> pa.Table:
        asks = tile.column("asks").to_numpy()
        a, b = tile.filter(pa.array(asks)), tile.filter(pa.array(~asks))
        if not a.num_rows or not b.num_rows:
            return schema.empty_table()
        a_id, b_id = a.column("id").to_numpy(), b.column("id").to_numpy()
        order = np.argsort(b_id, kind="stable")
        b_id, stored = b_id[order], vectors_of(b.column("v"))[order].T
        asking, found = vectors_of(a.column("v")), []
        for at in range(0, len(a_id), 256):
            sims = asking[at : at + 256] @ stored
            sims[a_id[at : at + 256, None] == b_id] = -1
            if len(b_id) > k:  # what is under the k-th best is out; ties with it are settled below
                least = np.partition(sims, len(b_id) - k, axis=1)[:, len(b_id) - k]
            else:
                least = np.full(len(sims), -np.inf)
            row, col = np.nonzero((sims >= least[:, None]) & (sims > 0))
            w = sims[row, col]
            best = np.lexsort((b_id[col], -w, row))
            row, col, w = row[best], col[best], w[best]
            place = np.arange(len(row)) - np.searchsorted(row, row)
            found.append((a_id[at + row[place < k]], b_id[col[place < k]], w[place < k]))
        return pa.table([np.concatenate(x) for x in zip(*found, strict=True)], schema=schema)

    return run


def neighbours(df: DataFrame, k: int, *, id_col: str = "id", vector_col: str = "v", block: int = 2048) -> DataFrame:
    """(src, dst, w): each row's k nearest others by positive cosine, exactly.

    Rows are cut into blocks, every pair of blocks is a tile in one task, and the tiles of a row are merged; no
    side is broadcast, and no pair leaves its tile but the k best.
    """
    spark = df.sparkSession
    ship(spark)
    rows = stash(df.select(F.col(id_col).cast("long").alias("id"), unit(doubles(F.col(vector_col))).alias("v")), "vectors")
    n = max(1, -(-rows.count() // block))
    own = F.pmod(F.xxhash64("id"), F.lit(n)).cast("int")
    every = F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    tiles = rows.select("id", "v", F.lit(True).alias("asks"), own.alias("i"), every.alias("j")).unionByName(rows.select("id", "v", F.lit(False).alias("asks"), own.alias("j"), every.alias("i")))
    partial = tiles.groupBy("i", "j").applyInArrow(_nearest(k), "src long, dst long, w double")
    best = Window.partitionBy("src").orderBy(F.desc("w"), "dst")
    return partial.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).drop("rank")


def _centers(sample: np.ndarray, lists: int, rounds: int, seed: int) -> np.ndarray:
    """Unit centers of a sample of unit vectors, by k-means on cosines."""
    centers = sample[np.random.default_rng(seed).choice(len(sample), min(lists, len(sample)), replace=False)]
    for _ in range(rounds):
        own = (sample @ centers.T).argmax(axis=1)
        sums = np.zeros_like(centers)
        np.add.at(sums, own, sample)
        size = np.linalg.norm(sums, axis=1, keepdims=True)
        centers = np.where(size > 1e-12, sums / np.maximum(size, 1e-12), centers)
    return centers


def approximate_neighbours(df: DataFrame, k: int, *, id_col: str = "id", vector_col: str = "v", lists: int = 64, probe: int = 40, sample: int = 20_000, seed: int = 3, block: int = 2048) -> DataFrame:
    """(src, dst, w): each row's nearest others by positive cosine, among the rows of the lists that it probes.

    Lists belong to centers that are fitted to a sample of at most so many rows; every row is stored in the list
    of its nearest center, and asks in the probe lists of its nearest centers. A list is dealt to tiles of blocks,
    however large it is. Recall depends on the data: vectors without clusters need most lists (the defaults give
    0.9 or more on those), clustered ones a few.
    """
    spark = df.sparkSession
    ship(spark)
    rows = stash(df.select(F.col(id_col).cast("long").alias("id"), unit(doubles(F.col(vector_col))).alias("v")), "vectors")
    chosen = rows.orderBy(F.xxhash64(F.lit(seed), F.col("id")), "id").limit(sample).select("v").toArrow()  # bounded by sample
    if not chosen.num_rows:
        return spark.createDataFrame([], "src long, dst long, w double")
    sent = spark.sparkContext.broadcast(_centers(vectors_of(chosen.column("v")), lists, 15, seed))

    def nearest_lists(batches):
        for batch in batches:
            near = vectors_of(pa.chunked_array([batch.column("v")])) @ sent.value.T
            order = np.argsort(-near, axis=1, kind="stable")[:, : min(probe, near.shape[1])]
            width = pa.array(np.arange(len(order) + 1) * order.shape[1], pa.int32())
            yield pa.record_batch([batch.column("id"), batch.column("v"), pa.ListArray.from_arrays(width, pa.array(order.ravel()))], ["id", "v", "lists"])

    coded = stash(rows.mapInArrow(nearest_lists, "id long, v array<double>, lists array<long>"), "lists")
    stored = coded.select(F.get("lists", F.lit(0)).alias("list"), "id", "v")
    asking = coded.select(F.explode("lists").alias("list"), "id", "v")
    blocks = lambda t, name: t.groupBy("list").agg(F.ceil(F.count("*") / block).cast("int").alias(name))
    sizes = F.broadcast(blocks(stored, "n_stored").join(blocks(asking, "n_asking"), "list"))  # a row for each list
    own = lambda n: F.pmod(F.xxhash64("id"), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    tiles = asking.join(sizes, "list").select("list", "id", "v", F.lit(True).alias("asks"), own("n_asking").alias("i"), every("n_stored").alias("j"))
    tiles = tiles.unionByName(stored.join(sizes, "list").select("list", "id", "v", F.lit(False).alias("asks"), own("n_stored").alias("j"), every("n_asking").alias("i")))
    partial = tiles.groupBy("list", "i", "j").applyInArrow(_nearest(k), "src long, dst long, w double")
    best = Window.partitionBy("src").orderBy(F.desc("w"), "dst")
    return partial.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).drop("rank")


def similarity_graph(nearest: DataFrame) -> DataFrame:
    """(G + G') / 2 of a table of neighbours."""
    half = nearest.select("src", "dst", (F.col("w") / 2).alias("w"))
    return half.unionByName(half.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "w")).groupBy("src", "dst").agg(F.sum("w").alias("w"))


def mean_cosine(df: DataFrame, *, id_col: str = "id", vector_col: str = "v") -> DataFrame:
    """(id, mean): mean cosine to all other rows, from the sum of all unit vectors: linear in the rows."""
    rows = df.select(F.col(id_col).alias("id"), unit(doubles(F.col(vector_col))).alias("u"))
    sums = rows.select(F.posexplode("u").alias("pos", "x")).groupBy("pos").agg(F.sum("x").alias("s"))
    whole = sums.agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "s"))), lambda e: e["s"]).alias("whole"))
    n = rows.agg(F.count("*").alias("n"))
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda t, x: t + x)
    rows = rows.crossJoin(F.broadcast(whole)).crossJoin(F.broadcast(n))
    return rows.select("id", ((dot(F.col("u"), F.col("whole")) - dot(F.col("u"), F.col("u"))) / F.greatest(F.col("n") - 1, F.lit(1))).alias("mean"))


