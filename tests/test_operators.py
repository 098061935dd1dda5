"""Operators on small tables."""

import json
import math
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from gleaner.functions import rules, text, vectors
from gleaner.operators import drift, edges, graphs, memory, objective, profile, ranking, retrieval, sketches, surprise
from gleaner.plans import queries, select
from gleaner.sources import arrays, records
from gleaner.streaming import scoring


def test_surprise_of_outliers(spark):
    rng = np.random.default_rng(42)
    rows = spark.createDataFrame([(i, float(x)) for i, x in enumerate(rng.normal(size=500))] + [(1000, 50.0)], "id long, x double")
    fitted = surprise.fit(rows.filter("id < 1000"), "x")
    scores = {r["id"]: r["surprise"] for r in surprise.score(rows, "x", fitted).collect()}
    assert all(s >= 0 and math.isfinite(s) for s in scores.values())
    assert scores[1000] > np.mean([s for i, s in scores.items() if i < 1000])
    constant = spark.createDataFrame([(1, 5.0), (2, 5.0)], "id long, x double")
    # a constant sits on an inner edge: it is counted above it and looked up below it
    assert all(0 <= r["surprise"] < 23 for r in surprise.score(constant, "x", surprise.fit(constant, "x")).collect())


def test_profile_of_equal_and_unequal_values(spark):
    equal = spark.createDataFrame([(2.0,)] * 10, "x double")
    row = profile.complexity(equal, F.col("x")).first()
    assert abs(row["gini"]) < 1e-9 and row["cv"] == 0 and abs(row["entropy"] - 1) < 1e-9
    values = [1.0, 5.0, 9.0, 9.0, 100.0]
    gini = profile.gini(spark.createDataFrame([(v,) for v in values], "x double"), F.col("x")).first()["gini"]
    n = len(values)
    assert abs(gini - (2 * sum((i + 1) * v for i, v in enumerate(sorted(values))) / (n * sum(values)) - (n + 1) / n)) < 1e-9


@pytest.mark.parametrize("values", [[3.0], [1.0, 2.0], [5.0, 1.0, 1.0, 9.0, 2.5, 1e9], [7.0] * 4, [float(x) for x in np.random.default_rng(3).normal(size=301)]])
def test_quantiles(spark, values):
    rows = spark.createDataFrame([(v,) for v in [*values, None]], "x double")
    for q in (0.0, 0.25, 0.5, 0.9, 1.0):
        assert abs(profile.quantile(rows, F.col("x"), q).first()["value"] - np.quantile(values, q)) < 1e-9 * max(1, *map(abs, values))
    assert profile.quantile(rows.filter("x is null"), F.col("x"), 0.5).first()["value"] is None


def test_equal_scores_are_normal(spark):
    rows = spark.createDataFrame([(1, 0.5), (2, 0.5)], "id long, score double")
    assert {r["tier"] for r in profile.tiers(rows, "score").collect()} == {"normal"}


def test_neighbours_equal_brute_force(spark):
    rng = np.random.default_rng(0)
    v = rng.normal(size=(60, 6))
    rows = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "id long, v array<double>")
    u = v / np.linalg.norm(v, axis=1, keepdims=True)
    sims = u @ u.T
    np.fill_diagonal(sims, -2)
    want = {(i, int(j)) for i in range(60) for j in np.argsort(-sims[i])[:4] if sims[i, j] > 0}
    assert {(r["src"], r["dst"]) for r in ranking.neighbours(rows, 4, block=16).collect()} == want


def test_approximate_neighbours_at_their_defaults(spark):
    """Vectors without any clusters, the hardest case, and clustered ones; ties and repeated vectors."""
    rng = np.random.default_rng(5)
    plain = rng.normal(size=(1500, 64))
    clustered = rng.normal(size=(30, 64))[rng.integers(0, 30, 1500)] + 0.5 * rng.normal(size=(1500, 64))
    for v in (plain, clustered):
        rows = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "vec_id long, embedding array<double>")
        exact = {(r["src"], r["dst"]) for r in ranking.neighbours(rows, 5, id_col="vec_id", vector_col="embedding").collect()}
        near = {(r["src"], r["dst"]) for r in ranking.approximate_neighbours(rows, 5, id_col="vec_id", vector_col="embedding").collect()}
        assert len(exact) == 5 * 1500 and len(near & exact) >= 0.9 * len(exact)
    assert ranking.approximate_neighbours(rows.limit(0), 5, id_col="vec_id", vector_col="embedding").count() == 0
    same = spark.createDataFrame([(i, [1.0, 0.0]) for i in range(6)], "id long, v array<double>")
    assert {(r["src"], r["dst"]) for r in ranking.neighbours(same, 2, block=3).filter("src > 3").collect()} == {(4, 0), (4, 1), (5, 0), (5, 1)}


def test_clamp():
    assert ranking.clamped(10, 3) == 3
    with pytest.raises(ValueError):
        ranking.clamped(0, 3)


def test_purified_edges(spark):
    rows = [(0, 1, 2.0), (0, 1, 1.0), (1, 0, 1.0), (2, 2, 5.0), (1, 2, float("nan")), (2, 1, float("inf")), (3, 4, 4.0)]
    found = {(r["src"], r["dst"]): r["w"] for r in edges.purified(spark.createDataFrame(rows, "src long, dst long, w double")).collect()}
    assert found == {(0, 1): 2.0, (1, 0): 2.0, (3, 4): 2.0, (4, 3): 2.0}


def test_graph_metrics(spark):
    nodes = spark.range(7)
    links = spark.createDataFrame([(1, 0, 1.0), (2, 0, 1.0), (3, 0, 1.0), (4, 0, 1.0), (5, 6, 1.0)], "src long, dst long, w double")
    assert {r["id"]: r["component"] for r in graphs.components(nodes, links).collect()} == {0: 0, 1: 0, 2: 0, 3: 0, 4: 0, 5: 5, 6: 5}
    hub = graphs.impact(nodes.filter("id < 5"), links, nodes.filter("id = 0")).first()
    assert hub["direct"] == hub["reached"] == 4 and hub["bottleneck"]
    chain = spark.createDataFrame([(i + 1, i, 1.0) for i in range(4)], "src long, dst long, w double")
    path = {r["depth"]: r["id"] for r in graphs.eccentric_path(chain, 0).collect()}
    assert path == {i: i for i in range(5)}
    health = {r["id"]: r for r in graphs.module_health(nodes, links).collect()}
    assert health[0]["ca"] == 4 and health[1]["instability"] > 0.99


def test_reach_of_a_long_chain(spark):
    nodes = spark.range(54)
    chain = spark.createDataFrame([(i + 1, i, 1.0) for i in range(53)] + [(0, 53, 1.0)], "src long, dst long, w double")
    end = graphs.impact(nodes, chain, nodes.filter("id = 0")).first()
    assert (end["direct"], end["reached"], end["depth"], end["share"]) == (1, 53, 53, 1.0)
    assert graphs.reach(chain, nodes.filter("id = 0"), 4).count() == 4


def test_causal_ancestor_wins(spark):
    docs = spark.createDataFrame([(1, [1.0, 0.0], 0.0), (2, [0.9, 0.1], 0.0), (3, [0.99, 0.0], -0.9)], "id long, v array<double>, karma double")
    links = spark.createDataFrame([(2, 9, "hetu", 1.0, 0)], "src long, dst long, relation string, strength double, seq long")
    got = edges.causal_retrieval(docs, links, 9, vectors.dot(F.col("v"), vectors.literal([1.0, 0.0])), 3)
    assert [r["id"] for r in got.collect()] == [2, 1, 3]


def test_ngram_vectors(spark):
    texts = ["Hello wörld", "", "ab", None]
    rows = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    found = {r["id"]: r["vector"] for r in retrieval.text_vectors(rows, "id").collect()}
    for i, t in enumerate(texts):
        data, want = (t or "").lower().encode(), np.zeros(500)
        for n in (3, 4, 5):
            for k in range(len(data) - n + 1):
                want[zlib.crc32(data[k : k + n]) % 500] += 1
        assert np.allclose(found[i], want / max(np.linalg.norm(want), 1e-10))


def test_keyword_score_and_rules(spark):
    row = spark.createDataFrame([("love love and proof", "please RM -RF /", "a? b?")], "a string, b string, c string")
    weights = F.create_map(F.lit("love"), F.lit(1.0), F.lit("why"), F.lit(1.0))
    got = row.select(text.keyword_score(F.col("a"), weights), rules.veto(F.col("b")), rules.ambiguity(F.col("c")), rules.essence(F.col("a"))).first()
    assert abs(got[0] - 1.3) < 1e-9 and got[1:] == ("REJECT", "CLARIFY", "love love proof")


def test_alert_cooldown(spark):
    rows = spark.sql("select timestamp_seconds(10 * id) as ts, cast(if(id % 2 = 0, 0.0, 0.5) as double) as a from range(20)")
    found = [r["ts"].second + 60 * r["ts"].minute for r in drift.alerts(rows, "ts", ["a"]).orderBy("ts").collect()]
    assert found == [10, 70, 130, 190]


def test_memory(spark):
    rows = spark.createDataFrame([(i, [float(i == j) for j in range(4)], 0.2 * i) for i in range(4)], "id long, pattern array<double>, strength double")
    assert {r["id"] for r in memory.decayed(rows, 0.5, 0.1).collect()} == {2, 3}
    assert memory.nearest(rows, vectors.literal([0, 0, 1.0, 0]), 1).first()["id"] == 2
    cues = spark.createDataFrame([(0, [0.0, 0.0, 0.1, 0.9])], "cue long, pattern array<double>")
    assert memory.recalled(rows, cues).first()["id"] == 3
    assert memory.consolidated(rows).count() > 0


def test_context_keeps_the_last_messages(spark):
    rows = spark.createDataFrame([(1, t, float(t == 2)) for t in range(30)], "conv_id long, turn long, relevance double")
    turns = sorted(r["turn"] for r in memory.context(rows, "relevance", recent=3, limit=4).collect())
    assert turns == [2, 27, 28, 29]


def test_sketches_never_underestimate(spark):
    rows = spark.range(3000).select((F.col("id") % 50).alias("k"))
    sketch = sketches.count_min(rows, "k", width=64, depth=4)
    got = sketches.estimates(rows.groupBy("k").count(), "k", sketch, width=64, depth=4).collect()
    assert all(r["estimate"] >= r["count"] for r in got)
    bins = sketches.exact_bins(rows, F.col("k"))
    values = [sketches.quantile(bins, q).first()["value"] for q in (0.1, 0.5, 0.9)]
    assert values == sorted(values)


def test_objective_routes(spark):
    assert objective.route({"linear"}, False) == "top_k"
    assert objective.route({"submodular"}, True) == "greedy"
    assert objective.route({"supermodular"}, True) == "warm_sa"
    assert objective.route({"submodular", "supermodular"}, True) == "ising_sa"
    rows = spark.createDataFrame([(i, float(s)) for i, s in enumerate([3, 1, 5, 2, 8, 7])], "id long, score double")
    made = objective.synthesised(rows, [objective.Surprise("score")])
    assert [r["id"] for r in objective.solve(made, 3).collect()] == [4, 5, 2]


def test_coupled_candidates_are_not_dropped(spark):
    linear = spark.createDataFrame([(i, i - 10.0) for i in range(6)], "id long, h double")
    links = spark.createDataFrame([(4, 5, -100.0), (5, 4, -100.0)], "src long, dst long, w double")
    made = objective.Objective(linear, links, 0.0, {"supermodular"})
    with pytest.raises(ValueError):
        objective.solve(made, 2, method="greedy", limit=5)
    assert objective.solve(made, 2, method="greedy", limit=6).count() == 2


def test_methods_by_size():
    assert select.method_for(10, 1.0) == "greedy" and select.method_for(100, 0.2) == "greedy"
    assert select.method_for(100, 0.8) == "sa" and select.method_for(100, 0.5) == "relaxation"
    assert select.method_for(100, 0.5, "greedy") == "greedy"


def test_npy_source(spark, tmp_path):
    a, b = np.arange(5.0), np.arange(5.0, 8.0)
    np.save(tmp_path / "a.npy", a)
    np.save(tmp_path / "b.npy", b)
    rows = arrays.read_npy(spark, [str(tmp_path / "a.npy"), str(tmp_path / "b.npy")], rows=2)
    assert sorted((r["id"], r["x"]) for r in rows.collect()) == [(i, float(i)) for i in range(8)]
    np.save(tmp_path / "m.npy", np.ones((3, 2)))
    assert arrays.read_npy(spark, [str(tmp_path / "m.npy")]).columns == ["id", "v"]


def test_json_tables(spark, tmp_path):
    rows = spark.createDataFrame([(1, [1.0, 2.0], 0.8, 5, 1000.0, {"a": "b"})], records.PATTERNS)
    records.write_json(rows, str(tmp_path / "p"))
    assert records.read_patterns(spark, str(tmp_path / "p")).collect() == rows.collect()
    (tmp_path / "k.json").write_text(json.dumps({"x": {"a": 1.0, "b": 0.5}}))
    assert records.read_keywords(spark, str(tmp_path / "k.json")).count() == 2


def test_import_graph(spark, tmp_path):
    root = tmp_path / "pkg"
    (root / "sub").mkdir(parents=True)
    (root / "__init__.py").write_text("")
    (root / "a.py").write_text("import pkg.b\nfrom pkg.sub import c\nimport os\n")
    (root / "b.py").write_text("def broken(:\n")
    (root / "sub" / "__init__.py").write_text("")
    (root / "sub" / "c.py").write_text("from pkg import b\n")
    modules, links = records.import_graph(records.read_sources(spark, str(tmp_path)), tmp_path.name)
    names = {r["id"]: r["module"] for r in modules.collect()}
    assert {(names[r["src"]], names[r["dst"]]) for r in links.collect()} >= {("pkg.a", "pkg.b"), ("pkg.a", "pkg.sub.c"), ("pkg.sub.c", "pkg.b")}


def test_breaker_opens_and_recovers(spark):
    rows = [("s", i, float(i), False) for i in range(3)] + [("s", 3, 3.0, True), ("s", 4, 40.0, True), ("s", 5, 41.0, False)]
    got = [(r["allowed"], r["state"]) for r in scoring.breaker(spark.createDataFrame(rows, "service string, seq long, at double, ok boolean")).orderBy("seq").collect()]
    assert got == [(True, "closed"), (True, "closed"), (True, "open"), (False, "open"), (True, "closed"), (True, "closed")]


def test_streamed_best_rows_equal_batch(spark, tmp_path):
    rows = spark.range(200).select("id", (F.hash("id") % 100).cast("double").alias("x"))
    rows.repartition(4).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    fitted = surprise.fit(rows, "x")
    live = scoring.scored(stream, "x", fitted)
    sink = scoring.BestOf(live, "surprise", 7, "id", f"best-{tmp_path.name}")
    scoring.run_once(live, sink, str(tmp_path / "checkpoint"))
    want = ranking.top_k(surprise.score(rows, "x", fitted), "surprise", 7).collect()
    assert sorted(r["id"] for r in sink.table(spark).collect()) == sorted(r["id"] for r in want)


def random_graph(spark, n, seed):
    rng = np.random.default_rng(seed)
    links = [(int(a), int(b), float(w)) for a, b, w in zip(rng.integers(0, n, n), rng.integers(0, n, n), rng.random(n) + 0.1, strict=True)]
    return spark.range(n), spark.createDataFrame(links, "src long, dst long, w double"), links


def test_components_and_reach_equal_a_plain_search(spark):
    nodes, table, links = random_graph(spark, 80, 2)
    label = list(range(80))
    for _ in range(80):
        for a, b, _w in links:
            label[a] = label[b] = min(label[a], label[b])
    assert {r["id"]: r["component"] for r in graphs.components(nodes, table).collect()} == dict(enumerate(label))
    want = {}
    for start in range(80):
        level, seen, depth = {start}, {start}, 0
        while level:
            depth += 1
            level = {a for a, b, _w in links if b in level and a != b} - seen
            seen |= level
            want |= {(start, x): depth for x in level}
    assert {(r["start"], r["id"]): r["depth"] for r in graphs.reach(table, nodes).collect()} == want


def test_deleteability_by_flow(spark):
    nodes = spark.range(6)
    links = spark.createDataFrame([(1, 0, 1.0), (2, 0, 1.0), (3, 0, 1.0), (4, 5, 0.1)], "src long, dst long, w double")
    got = {r["id"]: r["deleteability"] for r in graphs.deleteability_by_flow(nodes, links).collect()}
    assert len(got) == 6 and min(got.values()) == 0 and all(0 <= x <= 1 for x in got.values())
    assert abs(got[1] - got[2]) < 1e-9 and abs(got[4] - got[5]) < 1e-9
    with pytest.raises(Exception, match="one task takes 2"):
        graphs.deleteability_by_flow(nodes, links, limit=2).collect()


def test_smoothed_values_equal_the_fold(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=200) * 10.0 ** rng.integers(-3, 8, 200)
    rows = spark.createDataFrame([(g, i, float(v) * (g + 1)) for g in range(2) for i, v in enumerate(x[: 200 - 73 * g])], "g long, i long, x double")
    got = {(r["g"], r["i"]): r["smoothed"] for r in drift.smoothed(rows, "x", "i", keep=0.9, start=0.25, group=["g"]).collect()}
    for g in range(2):
        state = 0.25
        for i, v in enumerate(x[: 200 - 73 * g] * (g + 1)):
            state = state * 0.9 + v * 0.1
            assert abs(got[g, i] - state) <= 1e-9 * max(1, abs(state), np.abs(x[: i + 1]).max() * 0.9**64)


def test_turn_monitor_of_groups(spark):
    rng = np.random.default_rng(1)
    data = {g: rng.normal(size=(45 + 10 * g, 2)) for g in range(2)}
    rows = spark.createDataFrame([(g, i, v.tolist()) for g, vs in data.items() for i, v in enumerate(vs)], "g long, i long, v array<double>")
    got = {(r["g"], r["i"]): r for r in drift.turn_monitor(rows, "v", "i", 2, group=["g"]).collect()}
    for g, vs in data.items():
        for t in range(1, len(vs) + 1):
            if t < 20:
                assert got[g, t - 1]["drift"] == 0
                continue
            until = max(20, max(20, t // 20 * 20) // 2)
            base, last = vs[:until], vs[max(0, t - 50) : t]
            want = (np.abs(last.mean(axis=0) - base.mean(axis=0)) / np.maximum(base.std(axis=0), 1e-6)).mean()
            assert abs(got[g, t - 1]["drift"] - want) < 1e-6


def test_bayesian_surprise_equals_the_sum(spark):
    rng = np.random.default_rng(3)
    values = rng.normal(size=60)
    rows = spark.createDataFrame([(i, float(v)) for i, v in enumerate(values)], "i long, x double")
    fitted = surprise.fit(rows, "x")
    prior = np.maximum(fitted.first()["prior"], 1e-10)
    counts = np.zeros(50)
    for r in surprise.bayesian(rows, "x", "i", fitted).orderBy("i").collect():
        counts[int(np.sign(values[r["i"]]) * np.floor(abs(values[r["i"]] * 50))) % 50] += 1
        p = np.maximum(counts / counts.sum(), 1e-10)
        assert abs(r["surprise"] - max((p * (np.log(p) - np.log(prior))).sum(), 0)) < 1e-6


def test_character_counts(spark):
    texts = ["abca", "", None, "né 日本語 \U0001f600", "\x00" * 5]
    rows = spark.createDataFrame(list(enumerate(texts)), "id long, t string").select("id", text.character_counts(F.col("t"), 4).alias("c"))
    for r in rows.collect():
        assert r["c"] == [float(sum(ord(x) % 4 == k for x in texts[r["id"]] or "")) for k in range(4)]


def test_two_passes_over_a_stream_equal_the_batch(spark, tmp_path):
    rows = spark.range(300).select("id", (F.hash("id") % 50).cast("double").alias("x"))
    rows.repartition(5).write.parquet(str(tmp_path / "in"))
    live = lambda: spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 2).parquet(str(tmp_path / "in"))
    fitted = scoring.fit_stream(live(), "x", str(tmp_path / "one"))
    assert fitted.collect() == surprise.fit(rows, "x").collect()
    found, counts = scoring.run_stream(live(), "x", fitted, 9, str(tmp_path / "two"))
    want = ranking.top_k(surprise.score(rows, "x", fitted), "surprise", 9).collect()
    assert sorted(r["id"] for r in found.collect()) == sorted(r["id"] for r in want) and sum(r["n"] for r in counts.collect()) == 9


def test_heartbeats(spark):
    ticks = spark.createDataFrame([("a", i, 0.1, [1.0, -200.0]) for i in range(5)], "daemon string, seq long, dt double, signal array<double>")
    last = scoring.heartbeats(ticks).orderBy("seq").collect()[-1]["state"]
    state = [0.0, 0.0]
    for _ in range(5):
        state = [max(-10.0, min(10.0, s + 0.1 * (x - s))) for s, x in zip(state, [1.0, -200.0], strict=True)]
    assert np.allclose(last, state)


def test_crossbar(spark):
    rows = spark.createDataFrame([(0, 1, 0.5), (1, 0, -0.25), (1, 1, 0.0)], "src long, dst long, w double")
    cells = edges.programmed(rows)
    assert {(r["src"], r["dst"]): r["w"] for r in edges.weights_of(cells).collect()} == {(0, 1): 0.5, (1, 0): -0.25}
    step = (1e-3 - 1e-6) / 4
    assert all(abs((abs(r["g"]) - 1e-6) / step - round((abs(r["g"]) - 1e-6) / step)) < 1e-6 for r in edges.programmed(rows, bits=2).collect())
    assert edges.crossbar_stats(cells, 2, 2).first()["active"] == 2


def test_topologies_side_by_side(spark):
    nodes, table, _ = random_graph(spark, 20, 4)
    clusters = nodes.select("id", (F.col("id") % 2).alias("cluster"))
    a, b = graphs.compared({"a": (nodes, table, clusters), "b": (nodes, edges.scaled(table, 3.0), clusters)}).collect()
    assert abs(a["overall"] - b["overall"]) < 1e-9 and abs(a["overall"] - (a["isolation"] * a["precision"] * a["deleteability"]) ** (1 / 3)) < 1e-9


def test_text_search_and_stored_corpus(spark):
    assert memory.folded_cue("bb", 4) == [0.0] * 4 and max(memory.folded_cue("aab", 2)) > 0.99
    rows = spark.createDataFrame([(i, [float((i >> j) & 1) for j in range(4)], 1.0) for i in range(1, 16)], "id long, pattern array<double>, strength double")
    assert memory.search_by_text(rows, "aaba", 3).count() == 3 and memory.search_by_text(rows.limit(0), "a").count() == 0
    vectors_ = rows.select("id", F.col("pattern").alias("v"))
    stored = retrieval.fit_offline(vectors_, 3)
    got = [r["id"] for r in retrieval.rerank_online(stored, vectors.literal([1.0, 1.0, 0, 0]), vectors_.filter("id < 10").select("id"), 4).collect()]
    assert len(got) == 4 and 3 in got and max(got) < 10


def test_files_and_handlers(spark, tmp_path):
    np.save(tmp_path / "a.npy", np.concatenate((np.zeros(50), [99.0])))
    paths = [str(tmp_path / "a.npy")]
    rows, counts = select.run_files(spark, paths, select.fit_files(spark, paths), 3)
    assert 50 in {r["id"] for r in rows.collect()} and sum(r["n"] for r in counts.collect()) == 3
    done = select.handled(rows, {"critical": lambda i, s: i * 2}).filter("tier = 'critical'").first()
    assert done["result"] == str(2 * done["id"])
    with pytest.raises(ValueError):
        select.solved(rows.select("id", "x"), "x", 1, alpha=-1.0)


def test_frequencies_are_exact_where_keys_share_all_cells(spark):
    rows = spark.range(900).select(F.when(F.col("id") % 9 > 0, F.col("id") % 97).alias("k"))
    want = {r["k"]: (r["n"], r["n"] / 900) for r in rows.groupBy("k").agg(F.count("*").alias("n")).collect()}
    for width in (4, 64, 4096):
        sketch = sketches.merged(*[sketches.count_min(rows.filter(F.hash("k") % 2 == half), "k", width=width, depth=2) for half in (0, 1, -1)])
        got = sketches.exact_frequencies(rows, "k", sketch, width=width, depth=2).collect()
        assert len(got) == len(want) and {r["k"]: (r["estimate"], r["frequency"]) for r in got} == want


@pytest.fixture
def equal_prices(spark, tmp_path):
    """A folder with parts of which the 60 dearest cost the same."""
    spark.range(0, 100, 1, 2).select(F.col("id").alias("p_partkey"), F.when(F.col("id") % 10 < 7, 99.5).otherwise(F.col("id") / 4).alias("p_retailprice")).write.parquet(f"{tmp_path}/part.parquet")
    return str(tmp_path)


def test_tier_counts_of_equal_prices(spark, equal_prices):
    assert [tuple(r) for r in queries.QUERIES["tier_counts"](spark, equal_prices).collect()] == [("critical", 60)]


def test_tiered_selection_of_equal_prices(spark, equal_prices):
    assert {(r["score"], r["tier"]) for r in queries.QUERIES["tiered_selection"](spark, equal_prices).collect()} == {(99.5, "critical")}


def test_handled_selection_of_equal_prices(spark, equal_prices):
    assert {(r["tier"], r["result"] == f"keep {r['id']}") for r in queries.QUERIES["handled_selection"](spark, equal_prices).collect()} == {("critical", True)}


def test_nucleus_of_equal_probabilities_does_not_depend_on_rounding(spark):
    logits = spark.range(60).select(F.col("id").alias("token_id"), F.lit(2.0).alias("logit"))
    for tokens in (40, 60):
        got = ranking.sampling_distribution(logits.filter(F.col("token_id") < tokens), top=40, nucleus=0.9).collect()
        assert sorted(r["token_id"] for r in got) == list(range(36))
