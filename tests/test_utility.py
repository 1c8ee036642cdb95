import itertools
import math
from collections import Counter

import pytest
from test_graphs import adjacency, frame, parts, random_edges

from veilgraph.operators import anonymise, compare, evaluate, learn, segments, structure, utility
from veilgraph.plans.staging import staged


def test_pairs_open_the_smaller_end(spark):
    edges = random_edges(25, 80, 4) + [(0, x) for x in range(30, 60)]
    adj = adjacency(edges)
    pairs = [(u, v) for u in range(12) for v in range(u + 1, 26)] + [(30, 31), (0, 500)]
    found = {(r["u"], r["v"]): (r["common"], r["adamic_adar"]) for r in structure.common_neighbours(frame(spark, edges), frame(spark, pairs)).collect()}
    wanted = {(u, v): adj.get(u, set()) & adj.get(v, set()) for u, v in pairs}
    assert {p: c for p, (c, _) in found.items()} == {p: len(w) for p, w in wanted.items() if w}
    for p, (_, score) in found.items():
        assert math.isclose(score, sum(1 / math.log(len(adj[w])) for w in wanted[p] if len(adj[w]) > 1), abs_tol=1e-9)


def test_compare_utility_tells_losses_and_errors(spark):
    def broken(train):
        raise ValueError("no graph")

    edges = frame(spark, random_edges(40, 160, 8))
    methods = {"same": lambda g: g, "halved": lambda g: g.where("(u + v) % 2 = 0"), "broken": broken}
    rows = {r["method"]: r for r in staged(utility.compare_utility(edges, methods, seeds=(7,)), "rows").collect()}
    assert set(rows) == {"original", *methods}
    for name in ("original", "same"):
        assert rows[name]["auc_loss"] == rows[name]["ap_loss"] == 0 and rows[name]["auc_utility_ratio"] == 1
    base, half, bad = rows["original"], rows["halved"], rows["broken"]
    assert math.isclose(half["auc_loss"], base["auc"] - half["auc"]) and math.isclose(half["ap_utility_ratio"], half["average_precision"] / base["average_precision"])
    assert bad["auc"] is None and bad["auc_loss"] is None and bad["method_error"] == "ValueError: no graph"
    assert base["num_edges_train"] + base["num_test_pos_edges"] == base["num_edges_original"] == edges.count()
    best = utility.best_method(spark.createDataFrame(list(rows.values()), "method string, seed int, test_frac double, num_nodes int, num_edges_original int, num_edges_train int, num_test_pos_edges int, auc double, average_precision double, precision_at_50 double, precision_at_100 double, precision_at_500 double, auc_loss double, ap_loss double, precision_at_100_loss double, auc_utility_ratio double, ap_utility_ratio double, precision_at_100_utility_ratio double, method_error string")).collect()
    assert [b["method"] for b in best] == [max(("halved", "same"), key=lambda m: rows[m]["auc_utility_ratio"])] and best[0]["level"] == "high"


def plain_code_distance(adj, u, v, most):
    def code(n):
        out = []
        for part in parts({x: adj[x] & adj[n] for x in adj[n]}, adj[n]):
            degs = sorted((len(adj[x] & part) for x in part), reverse=True)
            out.append((len(part), sum(degs) // 2, *degs[:most]))
        return sorted(out, reverse=True)

    p, q = code(u), code(v)
    pairs = itertools.zip_longest(p, q, fillvalue=())
    gap = sum(abs(x - y) for a, b in pairs for x, y in itertools.zip_longest(a, b, fillvalue=0))
    return gap / max(sum(map(sum, p)), sum(map(sum, q)), 1)


def test_costs_in_groups(spark):
    edges = sorted({*random_edges(20, 40, 3), *itertools.combinations(range(9), 2)})  # a component of over six nodes
    g, adj = frame(spark, edges), adjacency(edges)
    groups = anonymise.fixed_groups(g, 4)
    codes = staged(structure.ncc_codes(g), "codes")
    community = {n: n % 3 for n in adj}
    rows = anonymise.cluster_costs(g, groups, codes, spark.createDataFrame(list(community.items()), "n long, c long")).collect()
    at = {r["n"]: r["g"] for r in groups.collect()}
    top = max(map(len, adj.values()))
    assert {r["n"] for r in rows} == set(at)
    for r in rows:
        n, others = r["n"], [m for m in at if at[m] == r["g"] and m != r["n"]]
        counts = Counter(community[m] for m in others)
        major = min(counts, key=lambda c: (-counts[c], c))
        want = (
            sum(abs(len(adj[n]) - len(adj[m])) for m in others) / len(others) / top,
            sum(plain_code_distance(adj, n, m, 6) for m in others) / len(others),
            1 - min(sum(len(adj[n] & adj[m]) for m in others) / len(others) / top, 1),
            0 if community[n] == major else sum(community[m] != community[n] for m in others) / len(others),
        )
        assert all(math.isclose(r[c], x, abs_tol=1e-12) for c, x in zip(("degree", "code", "neighbours", "community"), want, strict=True))
        assert math.isclose(r["cost"], want[0] + 0.2 * want[1] + 0.2 * want[2] + 0.1 * want[3])


def test_scores_of_a_node_alone_and_of_two(spark):
    g = frame(spark, [(1, 3), (1, 4), (2, 3), (2, 4), (1, 5), (1, 6), (1, 7)])
    groups = spark.createDataFrame([(1, 0), (2, 0), (9, 1)], "n long, g long")
    assert {r["n"]: round(r["distance"], 9) for r in anonymise.neighbour_scores(g, groups).collect()} == {1: 0.6, 2: 0.6, 9: 0.0}
    assert {r["n"]: r["distance"] for r in anonymise.community_scores(groups, spark.createDataFrame([(1, 0), (2, 1)], "n long, c long")).collect()} == {1: 1.0, 2: 1.0, 9: 0.0}


def test_codes_hold_six_degrees_of_a_component_or_all(spark):
    g = frame(spark, list(itertools.combinations(range(9), 2)))
    assert {r["weight"] for r in structure.ncc_codes(g).collect()} == {36 + 6 * 7} and {r["weight"] for r in structure.ncc_codes(g, None).collect()} == {36 + 8 * 7}
    assert {r["code"] for r in structure.ncc(g).collect()} == {"8:28:7,7,7,7,7,7"}


def test_split_of_hot_null_and_single_labels(spark):
    rows = [(i, "hot") for i in range(200)] + [(i, None) for i in range(200, 210)] + [(300, "one")]
    parts = evaluate.stratified_split(spark.createDataFrame(rows, "n long, y string"), "n", "y").groupBy("y", "part").count().collect()
    assert {(r["y"], r["part"]): r["count"] for r in parts} == {("hot", "train"): 120, ("hot", "val"): 40, ("hot", "test"): 40, (None, "train"): 6, (None, "val"): 2, (None, "test"): 2, ("one", "train"): 1}


def test_sampled_paths_of_all_sources(spark):
    r = structure.sampled_paths(frame(spark, [(1, 2), (2, 3), (3, 4)]), share=1.0).first()
    assert (r["sources"], r["pairs"], r["mean"]) == (4, 12, 20 / 12) and r["error"] > 0
    assert structure.sampled_paths(frame(spark, []), share=1.0).first()["sources"] == 0


def test_non_edges_of_dense_graphs(spark):
    gone = {(0, 1), (3, 9), (7, 19)}
    edges = frame(spark, [e for e in itertools.combinations(range(20), 2) if e not in gone])
    assert {tuple(r) for r in segments.sampled_non_edges(edges, 3).collect()} == gone
    assert {tuple(r) for r in segments.sampled_non_edges(edges, 2).collect()} < gone
    with pytest.raises(ValueError):
        segments.sampled_non_edges(edges, 4)


def test_features_and_classes(spark):
    edges = [*itertools.combinations(range(8), 2), *[(i, i + 1) for i in range(7, 30)]]  # a clique with a tail
    df = frame(spark, edges)
    rows = {r["n"]: r for r in learn.features(df).collect()}
    assert rows[0]["x5"] == 1 and rows[20]["x5"] == 1 / 7 and rows[7]["x1"] == 1 and rows[0]["x2"] == 1 and rows[7]["x4"] == 1
    assert rows[0]["x3"] == max(r["x3"] for r in rows.values()) == 1
    labels = spark.createDataFrame([(n, int(n < 8)) for n in range(31)], "n long, y long")
    got = learn.predict(df, labels).collect()
    assert len(got) == 9 and sum(r["y"] == r["guess"] for r in got) >= len(got) - 1


def test_delta_of_a_graph_without_paths(spark):
    row = compare.full_delta(frame(spark, [(1, 2)]), frame(spark, [])).first()
    assert row["original_apl"] == 1 and row["anonymized_apl"] == math.inf


def test_synthesis_of_runs(spark):
    nan, inf = float("nan"), float("inf")
    rows = [("Fast Cut", "ok", 1.0, -2.0), ("fast-cut ", "OK", nan, 4.0), ("fast_cut", "failed", 9.0, 9.0), ("other", "ok", None, inf), ("other", None, 1.0, 1.0)]
    runs = spark.createDataFrame(rows, "m string, status string, mae double, apl double")
    got = {tuple(r) for r in evaluate.synthesis(runs, "m", "status", ["mae"], ["apl"]).collect()}
    assert got == {("fast_cut", 2, 1.0, 3.0), ("other", 1, None, None)}
    assert evaluate.synthesis(runs.limit(0), "m", "status", ["mae"], ["apl"]).collect() == []


def test_edges_by_significance(spark):
    rows = [(1, 2, 0.5), (3, 4, 0.25), (1, 9, 0.5), (0, 9, 0.5)] + [(i, i + 1, 0.75) for i in range(100, 300)]
    got = [tuple(r) for r in anonymise.by_significance(spark.createDataFrame(rows, "u long, v long, x double"), "x").orderBy("rank").collect()]
    assert got == [(i + 1, u, v, x) for i, (u, v, x) in enumerate(sorted(rows, key=lambda r: (r[2], r[0], r[1])))]
