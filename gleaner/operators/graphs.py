"""Analytics of directed weighted graphs given as edge tables (src, dst, w) and node tables (id)."""

from __future__ import annotations

from functools import reduce
from itertools import count

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gleaner.operators import kernels
from gleaner.operators.edges import symmetric, without_loops
from gleaner.operators.profile import quantile
from gleaner.plans.scratch import discard, stash
from gleaner.session import ship


#: Tables of levels that a search reads side by side.
TABLES = 8


def components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, component): the least id of a node's weakly connected component.

    Labels take the least label around them and then jump to their label's label, so long chains shrink by
    half a round. Each round is a written table.
    """
    links = without_loops(edges).select("src", "dst")
    links = stash(links.unionByName(links.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct(), "links")
    labels = labels_table = stash(nodes.select("id", F.col("id").alias("component")), "labels")
    while True:
        near = links.join(labels, F.col("dst") == F.col("id")).groupBy("src").agg(F.min("component").alias("near"))
        new = labels.join(near, F.col("id") == F.col("src"), "left").select("id", F.col("component").alias("was"), F.least("component", F.coalesce("near", "component")).alias("component"))
        jump = labels.toDF("to", "further")
        new = new.join(jump, F.col("component") == F.col("to"), "left").select("id", "was", F.least("component", F.coalesce("further", "component")).alias("component"))
        new = stash(new, "labels")
        discard(labels_table)
        if new.filter("was <> component").isEmpty():
            return new.select("id", "component")
        labels, labels_table = new.select("id", "component"), new


def degrees(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, out_w, in_w): sums of absolute weights; 0 where there is no edge."""
    w = F.abs("w")
    out = edges.groupBy("src").agg(F.sum(w).alias("out_w")).withColumnRenamed("src", "o")
    into = edges.groupBy("dst").agg(F.sum(w).alias("in_w")).withColumnRenamed("dst", "i")
    both = nodes.select("id").join(out, F.col("id") == F.col("o"), "left").join(into, F.col("id") == F.col("i"), "left")
    return both.select("id", F.coalesce("out_w", F.lit(0.0)).alias("out_w"), F.coalesce("in_w", F.lit(0.0)).alias("in_w"))


def isolation(nodes: DataFrame, edges: DataFrame, clusters: DataFrame) -> DataFrame:
    """(id, isolation): of each node whose out-degree lies above the median, the share of weight that stays in
    its cluster (id, cluster); 1 for the others."""
    deg = degrees(nodes, edges)
    median = quantile(deg, F.col("out_w"), 0.5, "median")
    c = clusters.toDF("c_id", "c")
    inside = edges.join(c, F.col("src") == F.col("c_id")).join(c.toDF("d_id", "d"), F.col("dst") == F.col("d_id")).filter("c = d").groupBy("src").agg(F.sum(F.abs("w")).alias("inside"))
    rows = deg.crossJoin(F.broadcast(median)).join(inside, F.col("id") == F.col("src"), "left")
    share = F.coalesce("inside", F.lit(0.0)) / F.col("out_w")
    return rows.select("id", F.when((F.col("out_w") > F.col("median")) & (F.col("out_w") > 1e-15), share).otherwise(1.0).alias("isolation"))


def precision_topology(nodes: DataFrame, edges: DataFrame, clusters: DataFrame) -> DataFrame:
    """One row: 0.4 (1 - density) + 0.3 (clusters - 1) / (nodes - 1) + 0.3 share of weight inside clusters."""
    c = clusters.toDF("c_id", "c")
    counted = nodes.agg(F.count("*").cast("double").alias("n")).crossJoin(clusters.agg(F.countDistinct(clusters.columns[1]).alias("k")))
    ends = edges.join(c, F.col("src") == F.col("c_id")).join(c.toDF("d_id", "d"), F.col("dst") == F.col("d_id"))
    weights = ends.agg(F.count("*").alias("m"), F.sum(F.abs("w")).alias("all_w"), F.sum(F.when(F.col("c") == F.col("d"), F.abs("w"))).alias("in_w"))
    pairs = F.col("n") * (F.col("n") - 1)
    density = F.least(F.col("m") / pairs, F.lit(1.0))
    share = F.coalesce(F.col("in_w") / F.col("all_w"), F.lit(1.0))
    return counted.crossJoin(weights).select(F.when(F.col("n") <= 1, 1.0).otherwise(0.4 * (1 - density) + 0.3 * (F.col("k") - 1) / (F.col("n") - 1) + 0.3 * share).alias("precision"))


def deleteability(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, deleteability): 1 - (in + out weight) / (2 * the greatest)."""
    deg = degrees(nodes, edges).withColumn("all_w", F.col("out_w") + F.col("in_w"))
    top = deg.agg(F.max("all_w").alias("top"))
    return deg.crossJoin(F.broadcast(top)).select("id", F.when(F.col("top") < 1e-15, 1.0).otherwise(1 - F.col("all_w") / (2 * F.col("top"))).alias("deleteability"))


def reach(edges: DataFrame, starts: DataFrame, max_depth: int | None = None) -> DataFrame:
    """(start, id, depth): all nodes that depend on each start, directly or not, by breadth-first search.

    An edge src -> dst says that src depends on dst. The frontier is a table; a node enters it once. The search
    ends when the frontier is empty, or at max_depth where the caller gives one.
    """
    links = stash(without_loops(edges).select("src", "dst").distinct(), "links")
    levels = [stash(starts.select(F.col("id").alias("start"), F.col("id"), F.lit(0).alias("depth")), "reach")]
    for depth in count(1) if max_depth is None else range(1, max_depth + 1):
        step = levels[-1].join(links, F.col("id") == F.col("dst")).select("start", F.col("src").alias("id")).distinct()
        seen = reduce(DataFrame.unionByName, levels)
        level = stash(step.join(seen, ["start", "id"], "left_anti").withColumn("depth", F.lit(depth)), "reach")
        if level.isEmpty():
            discard(level)
            break
        levels.append(level)
        if len(levels) > TABLES:  # one table of those before, so that a long chain's plans stay short
            old = levels[:-1]
            levels = [stash(reduce(DataFrame.unionByName, old), "reach"), level]
            for table in old:
                discard(table)
    return reduce(DataFrame.unionByName, levels).filter("depth > 0")


def impact(nodes: DataFrame, edges: DataFrame, starts: DataFrame) -> DataFrame:
    """For each start: direct dependents, all dependents, their share of other nodes, depth, and whether more
    than half depend on it."""
    n = nodes.agg((F.count("*") - 1).alias("others"))
    found = reach(edges, starts).groupBy("start").agg(F.count_if(F.col("depth") == 1).alias("direct"), F.count("*").alias("reached"), F.max("depth").alias("depth"))
    rows = starts.select("id").join(found, F.col("id") == F.col("start"), "left").crossJoin(F.broadcast(n))
    share = F.coalesce(F.col("reached") / F.greatest("others", F.lit(1)), F.lit(0.0))
    return rows.select("id", F.coalesce("direct", F.lit(0)).alias("direct"), F.coalesce("reached", F.lit(0)).alias("reached"), share.alias("share"), F.coalesce("depth", F.lit(0)).alias("depth"), (share > 0.5).alias("bottleneck"))


def deleteability_by_flow(nodes: DataFrame, edges: DataFrame, *, precision: float = 5.0, leak: float = 1.0, steps: int = 50, limit: int = 2000) -> DataFrame:
    """(id, deleteability): 1 - the size of the response to a unit input at the node, over the greatest response.

    A flow stays in its component, so each component is one task; one of more than limit nodes is an error.
    """
    ship(nodes.sparkSession)
    both = symmetric(edges)
    scale = 1 / (1 + (both.groupBy("src").agg(F.abs(F.sum("w")).alias("s")).agg(F.coalesce(F.max("s"), F.lit(0.0))).first()[0]))
    owner = stash(components(nodes, edges), "components")
    links = both.join(owner.toDF("o", "own"), F.col("src") == F.col("o")).select("own", "src", "dst", "w")

    def run(key: tuple, own: pd.DataFrame, rows: pd.DataFrame) -> pd.DataFrame:
        if len(own) > limit:
            raise ValueError(f"a component has {len(own)} nodes; one task takes {limit}")
        ids = np.sort(own["id"].to_numpy())
        w = np.zeros((len(ids), len(ids)))
        w[np.searchsorted(ids, rows["src"]), np.searchsorted(ids, rows["dst"])] = rows["w"]
        response = [np.linalg.norm(kernels.settle(lambda g, i=i: (np.arange(len(ids)) == i) + scale * (w @ g) - g, len(ids), precision=precision, leak=leak, dt=0.01, steps=steps, stop=1e-4).v) for i in range(len(ids))]
        return pd.DataFrame({"id": ids, "response": response})

    found = stash(owner.groupBy("component").cogroup(links.groupBy("own")).applyInPandas(run, "id long, response double"), "responses")
    top = found.agg(F.max("response").alias("top"))
    return found.crossJoin(F.broadcast(top)).select("id", F.when(F.col("top") > 1e-15, 1 - F.col("response") / F.col("top")).otherwise(1.0).alias("deleteability"))


def evaluation(nodes: DataFrame, edges: DataFrame, clusters: DataFrame) -> DataFrame:
    """One row on a whole graph: mean isolation, precision, mean deleteability, and overall, their geometric mean,
    which is 0 where one isn't positive."""
    a = isolation(nodes, edges, clusters).agg(F.avg("isolation").alias("isolation"))
    b = precision_topology(nodes, edges, clusters)
    c = deleteability(nodes, edges).agg(F.avg("deleteability").alias("deleteability"))
    parts = [F.col(x) for x in ("isolation", "precision", "deleteability")]
    overall = F.when(F.least(*parts) > 0, F.pow(parts[0] * parts[1] * parts[2], F.lit(1 / 3))).otherwise(0.0)
    return a.crossJoin(b).crossJoin(c).withColumn("overall", overall)


def compared(graphs: dict[str, tuple[DataFrame, DataFrame, DataFrame]]) -> DataFrame:
    """The evaluations of several graphs (nodes, edges, clusters), a row for each name."""
    return reduce(DataFrame.unionByName, [evaluation(*g).select(F.lit(name).alias("name"), "*") for name, g in graphs.items()])


def change_set(edges: DataFrame, changed: DataFrame) -> DataFrame:
    """(id): direct dependents of any changed node that aren't changed themselves."""
    hit = edges.join(changed.select(F.col("id").alias("c")), F.col("dst") == F.col("c")).select(F.col("src").alias("id")).distinct()
    return hit.join(changed, "id", "left_anti")


def eccentric_path(edges: DataFrame, start, max_depth: int | None = None) -> DataFrame:
    """(depth, id): a shortest chain from a node to the farthest that depends on it; least ids win ties."""
    start_df = edges.sparkSession.range(1).select(F.lit(start).cast("long").alias("id"))
    found = reach(edges, start_df, max_depth).select("id", "depth").unionByName(start_df.withColumn("depth", F.lit(0)))
    found = stash(found, "depths")
    up = found.toDF("p", "p_depth")
    links = without_loops(edges).select("src", "dst").distinct()
    parent = found.join(links, F.col("id") == F.col("src")).join(up, (F.col("dst") == F.col("p")) & (F.col("p_depth") == F.col("depth") - 1)).groupBy("id", "depth").agg(F.min("p").alias("p"))
    parent = stash(parent, "parents")
    end = found.orderBy(F.desc("depth"), "id").limit(1)
    path = step = end.select("id", "depth")
    for _ in range(end.first()["depth"]):
        step = stash(step.join(parent.select(F.col("id").alias("c"), "p"), F.col("id") == F.col("c")).select(F.col("p").alias("id"), (F.col("depth") - 1).alias("depth")), "path")
        path = path.unionByName(step)
    return path


def module_health(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """For each node: different nodes it uses (ce) and that use it (ca), instability ce / (ca + ce), and whether
    it is a hub (uses many) or an authority (is used by many): above the value at three quarters of the order."""
    links = without_loops(edges).select("src", "dst").distinct()
    ce = links.groupBy(F.col("src").alias("o")).agg(F.count("*").alias("ce"))
    ca = links.groupBy(F.col("dst").alias("i")).agg(F.count("*").alias("ca"))
    rows = nodes.select("id").join(ce, F.col("id") == F.col("o"), "left").join(ca, F.col("id") == F.col("i"), "left").select("id", F.coalesce("ce", F.lit(0)).alias("ce"), F.coalesce("ca", F.lit(0)).alias("ca"))
    rows = stash(rows, "health")
    quartile = rows.agg(F.expr("percentile_disc(0.75) WITHIN GROUP (ORDER BY ce)").alias("q_ce"), F.expr("percentile_disc(0.75) WITHIN GROUP (ORDER BY ca)").alias("q_ca"))
    return rows.crossJoin(F.broadcast(quartile)).select("id", "ce", "ca", (F.col("ce") / (F.col("ca") + F.col("ce") + 1e-10)).alias("instability"), (F.col("ce") > F.col("q_ce")).alias("hub"), (F.col("ca") > F.col("q_ca")).alias("authority"))


def trend(history: DataFrame, order: str, metric: str, window: int = 10) -> DataFrame:
    """Slope of the metric over the last rows, and what it says: improving, degrading or stable."""
    place = Window.orderBy(F.desc(order))
    recent = history.select(order, F.col(metric).cast("double").alias("y")).orderBy(F.desc(order)).limit(window).withColumn("x", -F.row_number().over(place))
    slope = recent.agg(F.regr_slope("y", "x").alias("slope"))
    return slope.select("slope", F.when(F.col("slope") > 0.005, "improving").when(F.col("slope") < -0.005, "degrading").otherwise("stable").alias("direction"))
