"""Retrieve, rerank and choose: chains of scoring, a similarity graph and a selection kernel.

A first stage cuts the corpus to candidates with one scan and a top-k. What follows works on the candidates of
a query, which fit one task; many queries run side by side, one group each.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleaner.functions.text import dense, joined_fields, ngram_buckets
from gleaner.functions.vectors import cosine, doubles, relevance, unit
from gleaner.operators import kernels
from gleaner.operators.ranking import neighbours, similarity_graph
from gleaner.plans.scratch import stash
from gleaner.session import ship


def cosine_top(corpus: DataFrame, query: Column, n: int, *, id_col: str = "id", vector: str = "v") -> DataFrame:
    """(id, similarity): the n rows nearest to a query vector."""
    return corpus.select(F.col(id_col).alias("id"), cosine(doubles(F.col(vector)), query).alias("similarity")).orderBy(F.desc("similarity"), "id").limit(n)


def sparse_text_vectors(docs: DataFrame, id_col: str, text: str = "text", features: int = 500) -> DataFrame:
    """(id, bucket, weight) without zeros: the same vectors as rows, for joins and for long vectors."""
    rows = docs.select(F.col(id_col).alias("id"), F.explode(ngram_buckets(F.col(text), features)).alias("bucket")).groupBy("id", "bucket").agg(F.count("*").cast("double").alias("n"))
    norms = rows.groupBy("id").agg(F.greatest(F.sqrt(F.sum(F.col("n") * F.col("n"))), F.lit(1e-10)).alias("norm"))
    return rows.join(norms, "id").select("id", "bucket", (F.col("n") / F.col("norm")).alias("weight"))


def text_vectors(docs: DataFrame, id_col: str, text: str = "text", features: int = 500) -> DataFrame:
    """docs with vector, the normalised counts of hashed byte n-grams of the text; zeros for a short text."""
    rows = sparse_text_vectors(docs, id_col, text, features).groupBy("id").agg(F.collect_list(F.struct("bucket", "weight")).alias("entries"))
    vector = dense(F.coalesce("entries", F.array().cast("array<struct<bucket:int,weight:double>>")), features)
    return docs.join(rows.withColumnRenamed("id", "gleaner_id"), F.col(id_col) == F.col("gleaner_id"), "left").withColumn("vector", vector).drop("gleaner_id", "entries")


def adapted_beta(concentration: float, low: float = 0.1, high: float = 0.8, *, diverse_when_spread: bool = True) -> float:
    """The weight of diversity for a concentration of relevance: more of it for spread queries, or, for the
    router's synergy, more of it for focused ones."""
    return low + (high - low) * ((1 - concentration) if diverse_when_spread else concentration)


def _concentration(r: np.ndarray) -> float:
    if r.sum() < 1e-10 or len(r) < 2:
        return 0.0
    p = r / r.sum()
    p = p[p > 0]
    return float(1 + (p * np.log(p)).sum() / np.log(len(r)))


def _graph(unit: np.ndarray, near: int) -> np.ndarray:
    sims = unit @ unit.T
    np.fill_diagonal(sims, -1)
    g = np.zeros_like(sims)
    for i, row in enumerate(sims):
        top = np.lexsort((np.arange(len(row)), -row))[: min(near, len(row) - 1)]
        top = top[row[top] > 0]
        g[i, top] = row[top]
    return (g + g.T) / 2


def rerank(candidates: DataFrame, k: int, *, method: str = "diverse", alpha: float = 1.0, beta: float = 0.5, gamma: float = 10.0, near: int = 20, seed: int = 0) -> DataFrame:
    """(query, id, rank, relevance, method) of the chosen among candidates (query, id, relevance, v).

    Methods: diverse (greedy choice against similarity to those chosen), adaptive (its weight follows the
    relevance's concentration), saturating (as many as gains stay over 1 / e of the first), conditioned (an
    energy with synergy and cardinality over the graph weighted by relevance, annealed), routed (conditioned,
    with weights by concentration), flow (relevance as input of a flow over that graph). Queries with k
    candidates or fewer keep them all, by relevance.
    """
    ship(candidates.sparkSession)

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("id").reset_index(drop=True)
        r = rows["relevance"].to_numpy()
        if len(rows) <= k:
            order = np.lexsort((np.arange(len(r)), -r))
        else:
            v = np.array(rows["v"].tolist(), float)
            unit = v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-10)
            g, c = _graph(unit, near), _concentration(r)
            if method in ("diverse", "adaptive", "saturating"):
                weight = adapted_beta(c) if method == "adaptive" else beta
                order, gains = kernels.facility_greedy(r, g, k, alpha=alpha, beta=weight)
                if method == "saturating":
                    order = order[: kernels.saturated(gains)]
            else:
                tied = g * r[:, None] * r
                if method == "flow":
                    order = kernels.best_of(kernels.input_flow(r, tied).activation, k)
                else:
                    mean = np.maximum((unit @ unit.sum(axis=0) - 1) / (len(r) - 1), 0)
                    synergy, repel = (adapted_beta(c, diverse_when_spread=False), 1 - c) if method == "routed" else (beta, 0.0)
                    h = -alpha * (0.7 * r + 0.3 * mean) + synergy * tied.sum(axis=1) + gamma * (1 - 2 * k)
                    x = kernels.anneal(kernels.Problem(h, (repel - 2 * synergy) * tied, gamma, k), seed=seed)
                    order = np.flatnonzero(x)
                order = sorted(order, key=lambda i: (-r[i], i))
        chosen = rows.loc[list(order), ["query", "id", "relevance"]].reset_index(drop=True)
        return chosen.assign(rank=np.arange(1, len(chosen) + 1), method=method)[["query", "id", "rank", "relevance", "method"]]

    types = dict(candidates.dtypes)
    return candidates.groupBy("query").applyInPandas(run, f"query {types['query']}, id {types['id']}, rank long, relevance double, method string")


def search_and_rerank(corpus: DataFrame, query: Column, n: int, k: int, *, id_col: str = "id", vector: str = "v", **options) -> DataFrame:
    """Both stages for one query vector."""
    rows = corpus.select(F.lit(0).alias("query"), F.col(id_col).alias("id"), doubles(F.col(vector)).alias("v"))
    rows = rows.withColumn("relevance", relevance(query, F.col("v")))
    return rerank(rows.orderBy(F.desc("relevance"), "id").limit(n), k, **options)


def fit_offline(corpus: DataFrame, near: int = 20, *, id_col: str = "id", vector: str = "v") -> tuple[DataFrame, DataFrame]:
    """The stored form of a corpus: (id, v) and its similarity graph (src, dst, w), both written once."""
    rows = stash(corpus.select(F.col(id_col).cast("long").alias("id"), doubles(F.col(vector)).alias("v")), "corpus")
    return rows, stash(similarity_graph(neighbours(rows, near)), "corpus-graph")


def rerank_online(stored: tuple[DataFrame, DataFrame], query: Column, fetched: DataFrame, k: int, *, alpha: float = 1.0, beta: float = 0.5) -> DataFrame:
    """(id, rank, relevance): k of the fetched (id), chosen greedily over the part of the stored graph that lies
    between them. Only the fetched rows and their edges are read into the task."""
    rows, graph = stored
    ship(rows.sparkSession)
    ids = fetched.select(F.col("id").cast("long").alias("f")).distinct()
    own = rows.join(ids, F.col("id") == F.col("f"), "left_semi").select("id", relevance(query, F.col("v")).alias("relevance"))
    inside = graph.join(ids, F.col("src") == F.col("f"), "left_semi").join(ids, F.col("dst") == F.col("f"), "left_semi")

    def run(key: tuple, own: pd.DataFrame, links: pd.DataFrame) -> pd.DataFrame:
        own = own.sort_values("id").reset_index(drop=True)
        place = pd.Series(own.index, index=own["id"])
        g = np.zeros((len(own), len(own)))
        g[place[links["src"]].to_numpy(), place[links["dst"]].to_numpy()] = links["w"].to_numpy()
        order, _ = kernels.facility_greedy(own["relevance"].to_numpy(), g, k, alpha=alpha, beta=beta)
        order = sorted(order, key=lambda i: (-own["relevance"][i], i))
        return own.loc[order, ["id", "relevance"]].assign(rank=np.arange(1, len(order) + 1))[["id", "rank", "relevance"]]

    one = lambda t: t.withColumn("query", F.lit(0)).groupBy("query")
    return one(own).cogroup(one(inside)).applyInPandas(run, "id long, rank long, relevance double")


def embedded(docs: DataFrame, embed, *, text: str = "text", name: str = "vector") -> DataFrame:
    """docs with the vectors that a caller's function of a list of texts gives, called once for each batch."""

    def run(texts: pd.Series) -> pd.Series:
        return pd.Series([np.asarray(v, float).tolist() for v in embed(texts.fillna("").tolist())])

    return docs.withColumn(name, F.pandas_udf(run, "array<double>")(F.col(text)))


def rerank_nodes(nodes: DataFrame, query: Column, k: int, **options) -> DataFrame:
    """Retrieved nodes (id, v) reranked by one of rerank's methods."""
    rows = nodes.select(F.lit(0).alias("query"), "id", doubles(F.col("v")).alias("v"))
    return rerank(rows.withColumn("relevance", relevance(query, F.col("v"))), k, **options)


def select_examples(examples: DataFrame, query: str, k: int, *, fields: list[str] = ("input", "question", "output"), **options) -> DataFrame:
    """The k examples (id, record map) that serve a query text; their texts are joined fields."""
    return compressed(examples.select("id", joined_fields(F.col("record"), list(fields)).alias("text")), query, k, **options)


def rerank_outputs(outputs: DataFrame, query: str, k: int, **options) -> DataFrame:
    """The k candidate answers (id, text) to a query text."""
    return compressed(outputs, query, k, **options)


def compressed(docs: DataFrame, query: str, k: int, *, id_col: str = "id", text: str = "text", n: int = 200, **options) -> DataFrame:
    """The k documents of a result that serve a query text, by hashed n-gram vectors: the n most relevant are a
    first stage, k of them are chosen for relevance and diversity."""
    asked = docs.sparkSession.range(1).select("id", F.lit(query).alias("text"))
    q = text_vectors(asked, "id").select(F.col("vector").alias("q"))
    rows = text_vectors(docs.select(id_col, text), id_col, text).crossJoin(F.broadcast(q)).select(F.lit(0).alias("query"), F.col(id_col).alias("id"), F.col("vector").alias("v"), F.greatest(cosine(F.col("vector"), F.col("q")), F.lit(0.0)).alias("relevance"))
    return rerank(rows.orderBy(F.desc("relevance"), "id").limit(n), k, **options)


def context_quality(selected: DataFrame, corpus_topics: DataFrame) -> DataFrame:
    """One row on a selection (id, topic, relevance, v): topics covered of all (topic), mean relevance, mean
    cosine between different members, and topics for each member."""
    rows = selected.select("id", "topic", "relevance", doubles(F.col("v")).alias("v"))
    # the mean over pairs from the sum of unit vectors: (|sum|^2 - sum of |u|^2) / (n (n - 1))
    cells = rows.select("id", F.posexplode(unit(F.col("v"))).alias("pos", "x"))
    sums = cells.groupBy("pos").agg(F.sum("x").alias("s"), F.sum(F.col("x") * F.col("x")).alias("q")).agg(F.sum(F.col("s") * F.col("s")).alias("whole"), F.sum("q").alias("own"))
    count = rows.agg(F.count("*").alias("m"))
    pairs = sums.crossJoin(count).select(F.when(F.col("m") > 1, (F.col("whole") - F.col("own")) / (F.col("m") * (F.col("m") - 1))).otherwise(0.0).alias("redundancy"))
    own = rows.agg(F.countDistinct("topic").alias("topics"), F.avg("relevance").alias("relevance"), F.count("*").alias("n"))
    total = corpus_topics.agg(F.countDistinct("topic").alias("all_topics"))
    return own.crossJoin(pairs).crossJoin(total).select("topics", (F.col("topics") / F.col("all_topics")).alias("coverage"), "relevance", "redundancy", (F.col("topics") / F.col("n")).alias("efficiency"))


def label_diversity(selected: DataFrame, label: str, clusters: int) -> DataFrame:
    return selected.agg(F.countDistinct(label).alias("labels"), (F.countDistinct(label) / clusters).alias("share"))
