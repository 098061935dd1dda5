"""Selection objectives as tables: linear energies (id, h), couplings (src, dst, w), and how they are solved."""

from __future__ import annotations

from abc import ABC, abstractmethod
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gleaner.functions.vectors import doubles, relevance
from gleaner.operators import graphs, kernels
from gleaner.operators.edges import purified, quadratic_form
from gleaner.operators.profile import quantile
from gleaner.operators.ranking import mean_cosine
from gleaner.session import ship

LINEAR, SUBMODULAR, SUPERMODULAR, FRUSTRATED = "linear", "submodular", "supermodular", "frustrated"


@dataclass
class Part:
    """What a term adds: a linear table, a coupling table or neither, and a cardinality (gamma, k)."""

    kind: str
    linear: DataFrame | None = None
    couplings: DataFrame | None = None
    gamma: float = 0.0


class Term(ABC):
    """A plug-in: makes its part for a table of candidates (id, ...)."""

    @abstractmethod
    def build(self, candidates: DataFrame) -> Part: ...


@dataclass
class Surprise(Term):
    """-weight * score."""

    score: str
    weight: float = 1.0

    def build(self, candidates: DataFrame) -> Part:
        return Part(LINEAR, candidates.select("id", (-self.weight * F.col(self.score)).alias("h")))


@dataclass
class Typicality(Term):
    """-weight * score * (1 - |score - median| / the greatest such distance)."""

    score: str
    weight: float = 1.0

    def build(self, candidates: DataFrame) -> Part:
        s = F.col(self.score)
        rows = candidates.crossJoin(F.broadcast(quantile(candidates, s, 0.5, "median")))
        away = F.abs(s - F.col("median"))
        rows = rows.crossJoin(F.broadcast(rows.agg(F.max(away).alias("most"))))
        return Part(LINEAR, rows.select("id", (-self.weight * s * (1 - F.when(F.col("most") > 0, away / F.col("most")).otherwise(0.0))).alias("h")))


@dataclass
class Evenness(Term):
    """weight * (score - mean) ^ 2."""

    score: str
    weight: float = 1.0

    def build(self, candidates: DataFrame) -> Part:
        rows = candidates.crossJoin(F.broadcast(candidates.agg(F.avg(self.score).alias("mean"))))
        return Part(LINEAR, rows.select("id", (self.weight * F.pow(F.col(self.score) - F.col("mean"), 2)).alias("h")))


@dataclass
class Overuse(Term):
    """weight * how often a candidate was selected before (history: id)."""

    history: DataFrame
    weight: float = 1.0

    def build(self, candidates: DataFrame) -> Part:
        counts = self.history.groupBy("id").agg(F.count("*").alias("times"))
        return Part(LINEAR, candidates.join(counts, "id", "left").select("id", (self.weight * F.coalesce("times", F.lit(0))).cast("double").alias("h")))


@dataclass
class QueryFit(Term):
    """-weight * (0.7 * relevance to a query + 0.3 * mean cosine to the other candidates, if positive)."""

    query: Column
    vector: str
    weight: float = 1.0
    query_weight: float = 0.7

    def build(self, candidates: DataFrame) -> Part:
        near = mean_cosine(candidates, vector_col=self.vector).withColumnRenamed("id", "m_id")
        fit = self.query_weight * relevance(self.query, doubles(F.col(self.vector))) + (1 - self.query_weight) * F.greatest("mean", F.lit(0.0))
        return Part(LINEAR, candidates.join(near, F.col("id") == F.col("m_id")).select("id", (-self.weight * fit).alias("h")))


@dataclass
class Synergy(Term):
    """Linked candidates help each other: h = +w row sum, couplings -2 w; fades with age."""

    edges: DataFrame
    weight: float = 1.0
    decay: float = 0.0
    age: int = 0

    def build(self, candidates: DataFrame) -> Part:
        w = self.weight * float(np.exp(-self.decay * self.age))
        sums = self.edges.groupBy("src").agg(F.sum("w").alias("s"))
        linear = candidates.join(sums, F.col("id") == F.col("src"), "left").select("id", (w * F.coalesce("s", F.lit(0.0))).alias("h"))
        return Part(SUPERMODULAR, linear, self.edges.select("src", "dst", (-2 * w * F.col("w")).alias("w")))


@dataclass
class Diversity(Term):
    """Linked candidates repel each other."""

    edges: DataFrame
    weight: float = 1.0
    kind: str = SUBMODULAR

    def build(self, candidates: DataFrame) -> Part:
        return Part(self.kind, None, self.edges.select("src", "dst", (self.weight * F.col("w")).alias("w")))


@dataclass
class Cardinality(Term):
    """gamma (sum x - k)^2 without its constant: h = gamma (1 - 2k), and gamma between all pairs, implied."""

    k: int
    gamma: float = 10.0

    def build(self, candidates: DataFrame) -> Part:
        return Part(LINEAR, candidates.select("id", F.lit(self.gamma * (1 - 2 * self.k)).alias("h")), gamma=self.gamma)


@dataclass
class Given(Term):
    """A linear energy that is computed elsewhere, such as 1 - deleteability or -(1 - degree share)."""

    values: DataFrame
    column: str
    weight: float = 1.0

    def build(self, candidates: DataFrame) -> Part:
        return Part(LINEAR, candidates.join(self.values.select("id", F.col(self.column).alias("g")), "id", "left").select("id", (self.weight * F.coalesce("g", F.lit(0.0))).alias("h")))


@dataclass
class Tied(Term):
    """weight * (1 - deleteability): nodes that much hangs on cost more."""

    nodes: DataFrame
    edges: DataFrame
    weight: float = 1.0

    def build(self, candidates: DataFrame) -> Part:
        values = graphs.deleteability(self.nodes, self.edges).select("id", (1 - F.col("deleteability")).alias("g"))
        return Given(values, "g", self.weight).build(candidates)


@dataclass
class Central(Term):
    """-weight * (1 - degree / the greatest degree)."""

    nodes: DataFrame
    edges: DataFrame
    weight: float = 1.0

    def build(self, candidates: DataFrame) -> Part:
        degree = graphs.degrees(self.nodes, self.edges).select("id", (F.col("out_w") + F.col("in_w")).alias("d"))
        rows = degree.crossJoin(F.broadcast(degree.agg(F.max("d").alias("top"))))
        share = F.when(F.col("top") > 1e-15, F.col("d") / F.col("top")).otherwise(0.0)
        return Given(rows.select("id", (share - 1).alias("g")), "g", self.weight).build(candidates)


@dataclass
class Objective:
    linear: DataFrame
    couplings: DataFrame | None
    gamma: float
    kinds: set[str]


def synthesised(candidates: DataFrame, terms: list[Term]) -> Objective:
    """The sum of all terms: energies added by id, clean couplings added by pair."""
    parts = [t.build(candidates) for t in terms]
    linear = candidates.select("id", F.lit(0.0).alias("h"))
    for p in parts:
        if p.linear is not None:
            linear = linear.unionByName(p.linear.select("id", F.col("h").cast("double").alias("h")))
    couplings = None
    for p in parts:
        if p.couplings is not None:
            clean = purified(p.couplings)
            couplings = clean if couplings is None else couplings.unionByName(clean)
    if couplings is not None:
        couplings = couplings.groupBy("src", "dst").agg(F.sum("w").alias("w"))
    return Objective(linear.groupBy("id").agg(F.sum("h").alias("h")), couplings, sum(p.gamma for p in parts), {p.kind for p in parts})


def route(kinds: set[str], has_couplings: bool, override: str | None = None) -> str:
    """The solver for an objective. Without couplings the k least energies are the optimum."""
    if override:
        return override
    if not has_couplings:
        return "top_k"
    if FRUSTRATED in kinds or {SUBMODULAR, SUPERMODULAR} <= kinds:
        return "ising_sa"
    return "warm_sa" if SUPERMODULAR in kinds else "greedy"


def solve(objective: Objective, k: int, *, method: str | None = None, limit: int = 4096, seed: int = 0) -> DataFrame:
    """(id, h): the selected candidates.

    A linear objective is a top-k, of any size. One with couplings is solved by a kernel on all candidates in one
    task; more than limit of them are an error, since any of them may be chosen for its couplings.
    """
    how = route(objective.kinds, objective.couplings is not None, method)
    if how == "top_k":
        return objective.linear.orderBy("h", "id").limit(k)
    if (n := objective.linear.limit(limit + 1).count()) > limit:
        raise ValueError(f"{n} candidates or more with couplings; one task solves {limit}")
    return solve_groups(objective.linear.withColumn("problem", F.lit(0)), objective.couplings.withColumn("problem", F.lit(0)), k, method=how, gamma=objective.gamma, seed=seed).select("id", "h")


def solve_groups(linear: DataFrame, couplings: DataFrame, k: int, *, method: str = "greedy", gamma: float = 0.0, seed: int = 0) -> DataFrame:
    """Solve many problems side by side: (problem, id, h) of the selected, for linear (problem, id, h) and
    couplings (problem, src, dst, w). A problem fits one task."""
    ship(linear.sparkSession)

    def run(key: tuple, h: pd.DataFrame, J: pd.DataFrame) -> pd.DataFrame:
        h, p = problem_of(h, J, gamma, k)
        x = kernels.SOLVERS[method](p, seed)
        return h.loc[x > 0.5, ["problem", "id", "h"]]

    return linear.groupBy("problem").cogroup(couplings.groupBy("problem")).applyInPandas(run, linear.select("problem", "id", "h").schema)


def run_all(linear: DataFrame, couplings: DataFrame, k: int, methods: list[str], *, gamma: float = 0.0, seed: int = 0) -> DataFrame:
    """(problem, method, energy, ids): every method's selection of each problem, side by side."""
    ship(linear.sparkSession)

    def run(key: tuple, h: pd.DataFrame, J: pd.DataFrame) -> pd.DataFrame:
        h, p = problem_of(h, J, gamma, k)
        out = []
        for method in methods:
            x = kernels.SOLVERS[method](p, seed)
            out.append((key[0], method, p.energy(x), h["id"].to_numpy()[x > 0.5].tolist()))
        return pd.DataFrame(out, columns=["problem", "method", "energy", "ids"])

    return linear.groupBy("problem").cogroup(couplings.groupBy("problem")).applyInPandas(run, f"problem {dict(linear.dtypes)['problem']}, method string, energy double, ids array<long>")


def best_of_all(runs: DataFrame) -> DataFrame:
    """Of run_all's rows, each problem's of least energy; the first method by name wins ties."""
    first = F.row_number().over(Window.partitionBy("problem").orderBy("energy", "method"))
    return runs.withColumn("place", first).filter("place = 1").drop("place")


def problem_of(h: pd.DataFrame, J: pd.DataFrame, gamma: float, k: int) -> tuple[pd.DataFrame, kernels.Problem]:
    """A problem's rows by id, and the problem; couplings to others' candidates are left out."""
    h = h.sort_values("id").reset_index(drop=True)
    place = pd.Series(h.index, index=h["id"])
    J = J[J["src"].isin(place.index) & J["dst"].isin(place.index)]
    dense = np.zeros((len(h), len(h)))
    np.add.at(dense, (place[J["src"]].to_numpy(), place[J["dst"]].to_numpy()), J["w"].to_numpy())
    return h, kernels.Problem(h["h"].to_numpy(), dense, gamma, k)


def evaluate(selected: DataFrame, linear: DataFrame, couplings: DataFrame, gamma: float) -> DataFrame:
    """One row: the energy of a selection (id)."""
    ones = selected.select("id", F.lit(1.0).alias("v"))
    own = linear.join(selected.select("id"), "id", "left_semi").agg(F.coalesce(F.sum("h"), F.lit(0.0)).alias("own"), F.count("*").alias("n"))
    pairs = quadratic_form(ones, couplings, ones).withColumnRenamed("value", "pairs")
    return own.crossJoin(pairs).select((F.col("own") + F.col("pairs") + gamma * (F.col("n") * F.col("n") - F.col("n"))).alias("energy"))


def cut_value(selected: DataFrame, scores: DataFrame, edges: DataFrame, *, alpha: float = 1.0, beta: float = 0.5) -> DataFrame:
    """One row: alpha * the selected scores + beta * the weight from selected to other candidates."""
    chosen = selected.select(F.col("id").alias("c"))
    own = scores.join(chosen, F.col("id") == F.col("c"), "left_semi").agg(F.coalesce(F.sum("score"), F.lit(0.0)).alias("own"))
    out = edges.join(chosen, F.col("src") == F.col("c"), "left_semi").join(chosen, F.col("dst") == F.col("c"), "left_anti").agg(F.coalesce(F.sum("w"), F.lit(0.0)).alias("cut"))
    return own.crossJoin(out).select((alpha * F.col("own") + beta * F.col("cut")).alias("value"))


def interpretation(selected: DataFrame, edges: DataFrame, k: int) -> DataFrame:
    """One row on a selection (id, score): sum and variation of scores, how far its size is from k, and the
    weight to others and among its own."""
    chosen = selected.select(F.col("id").alias("c"))
    s = F.col("score")
    own = selected.agg(F.coalesce(F.sum(s), F.lit(0.0)).alias("total"), F.coalesce(F.when(F.avg(s) > 1e-10, F.stddev_pop(s) / F.avg(s)), F.lit(0.0)).alias("variation"), F.abs(F.count("*") - k).alias("off_by"))
    ends = edges.join(chosen, F.col("src") == F.col("c"), "left_semi").join(chosen, F.col("dst") == F.col("c"), "left")
    weights = ends.agg(F.coalesce(F.sum(F.when(F.col("c").isNull(), F.col("w"))), F.lit(0.0)).alias("outward"), F.coalesce(F.sum(F.when(F.col("c").isNotNull(), F.col("w"))), F.lit(0.0)).alias("inward"))
    return own.crossJoin(weights)


def ensemble_vote(results: DataFrame, linear: DataFrame, k: int) -> DataFrame:
    """(id, votes): the k candidates most solvers (results: mode, id) chose; |h|, scaled to 0..0.99, breaks ties."""
    span = linear.agg(F.min(F.abs("h")).alias("lo"), F.max(F.abs("h")).alias("hi"))
    tie = F.when(F.col("hi") > F.col("lo"), 0.99 * (F.abs("h") - F.col("lo")) / (F.col("hi") - F.col("lo"))).otherwise(0.0)
    votes = results.groupBy("id").agg(F.count("*").alias("n"))
    return linear.crossJoin(F.broadcast(span)).join(votes, "id").select("id", (F.col("n") + tie).alias("votes")).orderBy(F.desc("votes"), "id").limit(k)
