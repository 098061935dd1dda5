"""Quality classifier: a sparse ensemble of rules over text statistics.

Boosted trees of small depth are fitted to a bounded sample of labelled texts (SAMPLE rows). Every path from a
root to a node is a rule: a conjunction of bounds on statistics. A logistic regression with an L1 penalty
weighs the rules, most of which get no weight; the penalty is the largest whose loss on a part of the sample
comes near the best. The rules that are left are compiled into one Spark column expression over native
statistics, so scoring runs in the JVM and shuffles nothing.

Cases: a null text counts as empty, and all statistics of an empty text are 0. Without labels of both kinds
the score is their smoothed share, (ones + 1) / (labels + 2). Labels that are neither 0 nor 1 are left out; an
id with several labels is learnt from with each. Repeated rows are rows of their own. An empty table gives no
rows.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleaner.llm.common import crc_mod, stash, uniform

THRESHOLD = 0.3
#: The bound of the training sample, in rows.
SAMPLE, SEED = 20_000, 7
TREES, DEPTH, LEAF, SHRINK, BINS = 24, 3, 20, 0.3, 32

UPPER, DIGITS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"
SYMBOLS = "#$%&*+<>=@^_`{}~\\/[]"


def statistics(docs: DataFrame, *keep: Column) -> DataFrame:
    """The columns to keep, and the statistics of the text (STATISTICS)."""
    rows = docs.select(*keep, F.coalesce(F.col("text").cast("string"), F.lit("")).alias("gleaner_text"))
    text = F.col("gleaner_text")
    rows = rows.withColumn("gleaner_words", F.filter(F.split(F.lower(text), r"[\x20\x09-\x0D]+"), lambda w: w != ""))
    rows = rows.withColumn("gleaner_lines", F.split(text, "\n"))
    words, lines = F.col("gleaner_words"), F.col("gleaner_lines")
    names = [f for f in rows.columns if not f.startswith("gleaner_")]
    n, chars = F.size(words).cast("double"), F.length(text).cast("double")
    per = lambda part, whole: F.when(whole > 0, part / whole).otherwise(0.0)
    lost = lambda marks: per(chars - F.length(F.translate(text, marks, "")), chars)
    repeated = F.size(F.filter(words, lambda w, i: w == F.get(words, i + 1))).cast("double")
    letters = F.length(F.regexp_replace(text, r"[\x00-\x40\x5B-\x60\x7B-\x7F]+", "")).cast("double")
    found = {
        "log_words": F.log1p(n),
        "word_length": per(chars, n),
        "symbols": lost(SYMBOLS),
        "bars": lost("|"),
        "exclamations": lost("!"),
        "stops": lost(".,;:?"),
        "upper": lost(UPPER),
        "digits": lost(DIGITS),
        "letters": per(letters, chars),
        "different_words": per(F.size(F.array_distinct(words)).cast("double"), n),
        "repeated_words": per(repeated, n),
        "different_lines": per(F.size(F.array_distinct(lines)).cast("double"), F.size(lines).cast("double")),
        "line_words": per(n, F.size(lines).cast("double")),
        "links": per((F.length(text) - F.length(F.replace(text, F.lit("://"), F.lit("")))).cast("double") / 3, n),
    }
    return rows.select(*names, *[c.alias(k) for k, c in found.items()])


STATISTICS = ["log_words", "word_length", "symbols", "bars", "exclamations", "stops", "upper", "digits", "letters", "different_words", "repeated_words", "different_lines", "line_words", "links"]

#: A rule: (statistic, greater, bound) each; all must hold.
Rule = tuple[tuple[str, bool, float], ...]


def _tree(codes: np.ndarray, edges: list[np.ndarray], grad: np.ndarray, hess: np.ndarray) -> tuple[list[tuple], np.ndarray]:
    """Paths of a regression tree on binned statistics, and its prediction."""
    paths, step = [], np.zeros(len(grad))

    def grow(rows: np.ndarray, path: tuple, depth: int) -> None:
        if path:
            paths.append(path)
        total, weight = grad[rows].sum(), hess[rows].sum()
        best = (1e-6, None)
        if depth < DEPTH and len(rows) >= 2 * LEAF:
            for f in range(codes.shape[1]):
                c, n = codes[rows, f], len(edges[f]) + 1
                g, h, m = (np.cumsum(np.bincount(c, w, n))[:-1] for w in (grad[rows], hess[rows], np.ones(len(rows))))
                fits = (m >= LEAF) & (len(rows) - m >= LEAF)
                if fits.any():
                    gain = np.where(fits, g**2 / (h + 1) + (total - g) ** 2 / (weight - h + 1) - total**2 / (weight + 1), -1)
                    k = int(gain.argmax())
                    if gain[k] > best[0]:
                        best = (gain[k], (f, k))
        if best[1] is None:
            step[rows] = -total / (weight + 1)
            return
        f, k = best[1]
        above = codes[rows, f] > k
        for side in (False, True):
            grow(rows[above == side], (*path, (f, side, float(edges[f][k]))), depth + 1)

    grow(np.arange(len(grad)), (), 0)
    return paths, step


def _simple(path: tuple) -> Rule:
    """A path with one bound on each side of each statistic."""
    bounds: dict[tuple[int, bool], float] = {}
    for f, greater, bound in path:
        known = bounds.get((f, greater), bound)
        bounds[f, greater] = max(known, bound) if greater else min(known, bound)
    return tuple((STATISTICS[f], greater, bound) for (f, greater), bound in sorted(bounds.items()))


def holds(rules: list[Rule], x: np.ndarray) -> np.ndarray:
    out = np.ones((len(x), len(rules)))
    for j, rule in enumerate(rules):
        for name, greater, bound in rule:
            value = x[:, STATISTICS.index(name)]
            out[:, j] *= value > bound if greater else value <= bound
    return out


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def _lasso(r: np.ndarray, y: np.ndarray, penalty: float, start: np.ndarray, rounds: int = 150) -> np.ndarray:
    """Weights, the intercept first, by accelerated proximal gradient steps."""
    a = np.hstack((np.ones((len(r), 1)), r))
    # the Lipschitz constant of the gradient: a quarter of the greatest eigenvalue
    v = np.ones(a.shape[1])
    for _ in range(20):
        v = a.T @ (a @ v)
        v /= np.linalg.norm(v)
    rate = 1 / (0.25 * v @ (a.T @ (a @ v)) / len(a) * 1.05 + 1e-12)
    w, z, t = start.copy(), start.copy(), 1.0
    for _ in range(rounds):
        new = z - rate * (a.T @ (_sigmoid(a @ z) - y)) / len(a)
        new[1:] = np.sign(new[1:]) * np.maximum(np.abs(new[1:]) - rate * penalty, 0)
        t_new = (1 + np.sqrt(1 + 4 * t * t)) / 2
        w, z, t = new, new + (t - 1) / t_new * (new - w), t_new
    return w


def _loss(r: np.ndarray, y: np.ndarray, w: np.ndarray) -> float:
    p = np.clip(_sigmoid(w[0] + r @ w[1:]), 1e-6, 1 - 1e-6)
    return float(-(y * np.log(p) + (1 - y) * np.log(1 - p)).mean())


@dataclass
class Ensemble:
    intercept: float
    rules: list[tuple[Rule, float]]

    def column(self) -> Column:
        """The score as an expression over the statistics."""
        total = F.lit(float(self.intercept))
        for rule, weight in self.rules:
            parts = [F.col(name) > bound if greater else F.col(name) <= bound for name, greater, bound in rule]
            whole = parts[0]
            for part in parts[1:]:
                whole = whole & part
            total = total + F.when(whole, F.lit(float(weight))).otherwise(0.0)
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-total))

    def score(self, x: np.ndarray) -> np.ndarray:
        weights = np.array([w for _, w in self.rules])
        return _sigmoid(self.intercept + holds([r for r, _ in self.rules], x) @ weights)


def fit(x: np.ndarray, y: np.ndarray, *, seed: int = SEED) -> Ensemble:
    """Rules for statistics x (a row each) and labels y (0 or 1)."""
    ones, n = int(y.sum()), len(y)
    if not 0 < ones < n:
        return Ensemble(float(np.log((ones + 1) / (n - ones + 1))), [])
    edges = [np.unique(np.quantile(column, np.linspace(0, 1, BINS + 1)[1:-1])) for column in x.T]
    codes = np.stack([np.searchsorted(e, column, "left") for e, column in zip(edges, x.T, strict=True)], axis=1)
    raw, paths = np.full(n, np.log(ones / (n - ones))), []
    for _ in range(TREES):
        p = _sigmoid(raw)
        found, step = _tree(codes, edges, p - y, p * (1 - p))
        raw += SHRINK * step
        paths += found
    rules = list(dict.fromkeys(map(_simple, paths)))
    r = holds(rules, x)
    _, first = np.unique(r, axis=1, return_index=True)  # rules that hold for the same rows are one
    keep = sorted(first.tolist())
    rules, r = [rules[j] for j in keep], r[:, keep]
    test = np.random.default_rng(seed).random(n) < 0.25
    tried, w = [], np.zeros(r.shape[1] + 1)
    for penalty in np.geomspace(0.03, 0.0003, 8):
        w = _lasso(r[~test], y[~test], penalty, w)
        tried.append((_loss(r[test], y[test], w), penalty))
    best = min(tried)[0]
    penalty = max(p for loss, p in tried if loss <= best * 1.05 + 1e-3)
    w = _lasso(r, y, penalty, np.zeros(r.shape[1] + 1), 400)
    return Ensemble(float(w[0]), [(rule, float(c)) for rule, c in zip(rules, w[1:], strict=True) if abs(c) > 1e-6])


def train(docs: DataFrame, labels: DataFrame, *, sample: int = SAMPLE, seed: int = SEED) -> Ensemble:
    """Learn labels.quality of docs (doc_id, text) from a sample of so many labelled rows."""
    marks = labels.filter(F.col("quality").isin(0, 1)).select(F.col("doc_id").alias("labelled"), F.col("quality").cast("double").alias("quality"))
    chosen = stash(marks.orderBy(uniform(seed, F.col("labelled")), "labelled", "quality").limit(sample), "labels")
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), F.col("doc_id") == F.col("labelled"))
    table = statistics(rows, F.col("doc_id").alias("doc_id"), F.col("quality").alias("quality"))
    # numbers only, and no more rows than the sample, however often an id is repeated
    table = table.orderBy(F.xxhash64("doc_id", *STATISTICS), "doc_id", "quality", *STATISTICS).limit(sample).toArrow()
    x = np.stack([table.column(k).to_numpy() for k in STATISTICS], axis=1) if table.num_rows else np.zeros((0, len(STATISTICS)))
    return fit(x, table.column("quality").to_numpy())


def score(docs: DataFrame, ensemble: Ensemble, *keep: Column) -> DataFrame:
    """score and predicted of every row of docs (text), with the columns to keep."""
    rows = statistics(docs, *keep)
    names = [c for c in rows.columns if c not in STATISTICS]
    rows = rows.select(*names, ensemble.column().alias("score"))
    return rows.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))


def train_and_score(docs: DataFrame, labels: DataFrame, *, mod: int = 5, held: int = 0) -> DataFrame:
    """Learn from the documents whose crc32(doc_id) mod some number isn't held, and score all of them."""
    ensemble = train(docs.filter(crc_mod(F.col("doc_id"), mod) != held), labels)
    return score(docs, ensemble, F.col("doc_id").alias("doc_id"), (crc_mod(F.col("doc_id"), mod) == held).alias("held_out"))


def good_documents(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """The rows of docs that the classifier accepts, all columns as they are."""
    ensemble = train(docs, labels, **options)
    columns = docs.columns
    # the row number keeps the optimizer from pushing the filter below the statistics, which would then be
    # computed again for every rule that names them
    rows = score(docs, ensemble, F.struct(*[F.col(c) for c in columns]).alias("kept_row")).withColumn("kept_at", F.monotonically_increasing_id())
    return rows.filter("predicted = 1 and kept_at >= 0").select(*[F.col("kept_row")[c].alias(c) for c in columns])
