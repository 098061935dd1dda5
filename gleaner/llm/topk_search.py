"""Exact top-k search over vectors by term-at-a-time accumulation.

Vectors are read as sparse rows: component t of weight w is a posting (row, w) of term t. Queries and
candidates are cut into blocks of bounded size and each pair of blocks is one tile. In a tile each query
scatters its weighted postings, one term after another, into a dense array of the candidates' scores; a
partial selection keeps the k best, and a window merges the tiles of a query.

No block is broadcast or collected: both sides are dealt to the tiles by a shuffle, and a task holds one
block of either side, whatever the size of the table.

Cases: vectors that are null, or hold a null, a NaN or an infinity, and rows without id take no part. An
empty vector scores 0 with every other. Vectors of unequal length meet on the components both have. Repeated
ids are rows of their own; a query only skips its own row. Ties go to the smaller id. An empty table gives no
rows. Components beyond 64 bits saturate and sums beyond 64 bits wrap.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gleaner.llm.common import stash
from gleaner.session import ship

QUERY_BLOCK = 16384
CANDIDATE_BLOCK = 16384


def quantized(vector: Column, scale: float) -> Column:
    """floor(scale * x) of every component, x as double."""
    return F.transform(vector, lambda x: F.floor(F.lit(float(scale)) * x.cast("double")).cast("long"))


def usable(vector: Column) -> Column:
    bad = lambda x: x.isNull() | F.isnan(x.cast("double")) | (F.abs(x.cast("double")) == float("inf"))
    return vector.isNotNull() & ~F.exists(vector, bad)


def _postings(vectors: pa.ListArray) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """Rows and weights of each term, without zeros."""
    starts = vectors.offsets.to_numpy().astype(np.int64)
    values = vectors.values.to_numpy(zero_copy_only=False)[starts[0] : starts[-1]]
    lengths = np.diff(starts)
    row = np.repeat(np.arange(len(lengths)), lengths)
    term = np.arange(len(values)) - np.repeat(starts[:-1] - starts[0], lengths)
    there = np.flatnonzero(values)
    there = there[np.argsort(term[there], kind="stable")]
    cuts = np.flatnonzero(np.diff(term[there])) + 1
    return {int(term[part[0]]): (row[part], values[part]) for part in np.split(there, cuts) if len(part)}


def _best(scores: np.ndarray, ids: np.ndarray, rows: np.ndarray, own: int, k: int) -> np.ndarray:
    """Positions of the k best by score, then id, without the row own."""
    at = np.flatnonzero(rows != own)
    if len(at) > k:
        limit = np.partition(scores[at], len(at) - k)[len(at) - k]
        at = at[scores[at] >= limit]
    return at[np.lexsort((ids[at], -scores[at]))][:k]


def _tile(k: int):
    out = pa.schema([("query_row", pa.int64()), ("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64())])

    def run(tile: pa.Table) -> pa.Table:
        tile = tile.combine_chunks()
        asks = tile.column("asks").to_numpy()
        queries, candidates = tile.filter(pa.array(asks)), tile.filter(pa.array(~asks))
        if not queries.num_rows or not candidates.num_rows:
            return out.empty_table()
        ids, rows = candidates.column("vec_id").to_numpy(), candidates.column("row").to_numpy()
        postings = _postings(candidates.column("v").combine_chunks())
        found = []
        vectors, n = queries.column("v").combine_chunks(), len(ids)
        starts, values = vectors.offsets.to_numpy(), vectors.values.to_numpy(zero_copy_only=False)
        for i, (own, query) in enumerate(zip(queries.column("row").to_pylist(), queries.column("vec_id").to_pylist(), strict=True)):
            scores = np.zeros(n, np.int64)
            vector = values[starts[i] : starts[i + 1]]
            for t in np.flatnonzero(vector).tolist():
                if t in postings:
                    at, weight = postings[t]
                    if len(at) == n:
                        scores += vector[t] * weight
                    else:
                        scores[at] += vector[t] * weight
            best = _best(scores, ids, rows, own, k)
            found.append((np.full(len(best), own), np.full(len(best), query), ids[best], scores[best]))
        return pa.table([np.concatenate([x[c] for x in found]) for c in range(4)], schema=out)

    return run


def top_k(vectors: DataFrame, asks: Column, *, id_col: str = "vec_id", vector_col: str = "embedding", k: int = 5, scale: float = 256.0) -> DataFrame:
    """For each row where asks holds, the k other rows of highest integer inner product.

    Returns query_id, rank (from 1), vec_id, score.
    """
    spark = vectors.sparkSession
    ship(spark)
    ids, vector = F.col(id_col).cast("long"), F.col(vector_col)
    rows = stash(
        vectors.filter(usable(vector) & ids.isNotNull()).select(F.monotonically_increasing_id().alias("row"), ids.alias("vec_id"), F.coalesce(asks, F.lit(False)).alias("asks"), quantized(vector, scale).alias("v")),
        "vectors",
    )
    n, n_queries = rows.agg(F.count("*"), F.coalesce(F.sum(F.col("asks").cast("long")), F.lit(0))).first()
    n_blocks = max(1, min(math.ceil(n / 1024), max(2 * spark.sparkContext.defaultParallelism, math.ceil(n / CANDIDATE_BLOCK))))
    n_query_blocks = max(1, math.ceil(n_queries / QUERY_BLOCK))
    block = lambda n: F.pmod(F.xxhash64("row"), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    sides = rows.select(F.lit(False).alias("asks"), "row", "vec_id", "v", block(n_blocks).alias("cb"), every(n_query_blocks).alias("qb")).unionByName(
        rows.filter("asks").select(F.lit(True).alias("asks"), "row", "vec_id", "v", block(n_query_blocks).alias("qb"), every(n_blocks).alias("cb"))
    )
    partial = sides.groupBy("qb", "cb").applyInArrow(_tile(k), "query_row long, query_id long, vec_id long, score long")
    order = Window.partitionBy("query_row").orderBy(F.desc("score"), "vec_id")
    return partial.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
