"""Whole queries: score, cut, choose, sort into tiers."""

from __future__ import annotations

import argparse

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleaner.functions import rules
from gleaner.operators import objective, profile, ranking, surprise
from gleaner.session import session
from gleaner.sources.arrays import read_npy


def method_for(n: int, budget: float, best: str | None = None) -> str:
    """The solver for so many candidates and a share of the full budget."""
    if n <= 50 or budget < 0.3:
        return "greedy"
    return best or ("sa" if budget >= 0.7 else "relaxation")


def select(reference: DataFrame, candidates: DataFrame, col: str, k: int, *, id_col: str = "id") -> DataFrame:
    """The k candidates whose value is most surprising given a reference. Without couplings the solver's
    optimum is the top-k, so no solver runs."""
    scored = surprise.score(candidates, col, surprise.fit(reference, col))
    return ranking.top_k(scored, "surprise", k, id_col)


def process(reference: DataFrame, candidates: DataFrame, col: str, k: int, *, id_col: str = "id", threshold: float = 0.7) -> tuple[DataFrame, DataFrame]:
    """The selection with tiers, and how many there are of each."""
    rows = profile.tiers(select(reference, candidates, col, k, id_col=id_col), "surprise", threshold)
    return rows, rows.groupBy("tier").agg(F.count("*").alias("n"))


def handled(rows: DataFrame, handlers: dict, *, id_col: str = "id", score: str = "surprise") -> DataFrame:
    """Rows with tiers and result, what the caller's function of an id and a score gives for their tier, as text;
    null where a tier has none."""

    def run(ids: pd.Series, scores: pd.Series, tiers: pd.Series) -> pd.Series:
        return pd.Series([str(handlers[t](int(i), float(s))) if t in handlers else None for i, s, t in zip(ids, scores, tiers, strict=True)], dtype=object)

    return rows.withColumn("result", F.pandas_udf(run, "string")(F.col(id_col).cast("long"), F.col(score), F.col("tier")))


def handled_in_batches(rows: DataFrame, handler, *, id_col: str = "id", score: str = "surprise") -> DataFrame:
    """Rows with result, what the caller's function of arrays of ids and scores gives for each batch, as text."""

    def run(ids: pd.Series, scores: pd.Series) -> pd.Series:
        return pd.Series([str(x) for x in handler(ids.to_numpy(), scores.to_numpy())], dtype=object)

    return rows.withColumn("result", F.pandas_udf(run, "string")(F.col(id_col).cast("long"), F.col(score)))


def fit_files(spark: SparkSession, paths: list[str], col: str | None = None) -> DataFrame:
    """The first pass over files: the distribution of a column of .npy arrays (x or v) or Parquet tables."""
    rows = read_files(spark, paths)
    return surprise.fit(rows, col or rows.columns[1])


def run_files(spark: SparkSession, paths: list[str], fitted: DataFrame, k: int, col: str | None = None, *, id_col: str = "id", threshold: float = 0.7) -> tuple[DataFrame, DataFrame]:
    """The second pass: score, keep the k best, and sort them into tiers; the rows and the tiers' counts."""
    rows = read_files(spark, paths)
    best = ranking.top_k(surprise.score(rows, col or rows.columns[1], fitted), "surprise", k, id_col)
    tiered = profile.tiers(best, "surprise", threshold)
    return tiered, tiered.groupBy("tier").agg(F.count("*").alias("n"))


def read_files(spark: SparkSession, paths: list[str]) -> DataFrame:
    return read_npy(spark, paths) if all(p.endswith(".npy") for p in paths) else spark.read.parquet(*paths)


def solved(rows: DataFrame, col: str, k: int, *, alpha: float = 1.0, gamma: float = 10.0, method: str | None = None, id_col: str = "id") -> DataFrame:
    """(id, h): the selection by an objective of surprise and cardinality."""
    scored = surprise.score(rows, col, surprise.fit(rows, col)).select(F.col(id_col).alias("id"), "surprise")
    made = objective.synthesised(scored, [objective.Surprise("surprise", rules.non_negative(alpha, "alpha")), objective.Cardinality(k, rules.non_negative(gamma, "gamma"))])
    return objective.solve(made, k, method=method)


def main(argv: list[str] | None = None) -> None:
    """Command line: select the k most surprising values of .npy files or Parquet tables, or of a demonstration."""
    args = argparse.ArgumentParser(prog="gleaner")
    args.add_argument("paths", nargs="*")
    args.add_argument("--k", type=int, default=10)
    args.add_argument("--alpha", type=float, default=1.0, help="weight of surprise")
    args.add_argument("--gamma", type=float, default=10.0, help="weight of the cardinality")
    args.add_argument("--method", choices=["top_k"], default=None, help="the solver; without couplings all agree with top_k")
    args.add_argument("--col", help="the column of Parquet tables to score")
    args.add_argument("--id", help="the column that names rows")
    args.add_argument("--demo", action="store_true", help="use normal numbers and a few outliers")
    given = args.parse_args(argv)
    if not given.paths and not given.demo:
        args.error("give files, or --demo")
    spark = session()
    rows = spark.range(1000).select("id", F.when(F.col("id") % 250 == 249, F.lit(8.0)).otherwise(F.randn(42)).alias("x")) if given.demo else read_files(spark, given.paths)
    id_col, col = given.id or rows.columns[0], given.col or rows.columns[1]
    solved(rows, col, ranking.clamped(given.k, rows.count()), alpha=given.alpha, gamma=given.gamma, method=given.method, id_col=id_col).show(given.k, truncate=False)


if __name__ == "__main__":
    main()
