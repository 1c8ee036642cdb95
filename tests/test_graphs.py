import hashlib
import itertools
import random

import pytest

from veilgraph.operators import anonymise, attack, compare, evaluate, hierarchy, segments, structure
from veilgraph.operators.components import connected_components
from veilgraph.sources import graphs

NAMED = {
    "triangle": [(1, 2), (2, 3), (1, 3)],
    "star5": [(0, 1), (0, 2), (0, 3), (0, 4)],
    "path4": [(1, 2), (2, 3), (3, 4)],
    "K4": list(itertools.combinations(range(1, 5), 2)),
    "two": [(1, 2), (3, 4)],
    "none": [],
}


def random_edges(n, m, seed):
    rng = random.Random(seed)
    return sorted({tuple(sorted(rng.sample(range(n), 2))) for _ in range(m)})


def frame(spark, edges):
    return spark.createDataFrame(edges, "u long, v long")


def adjacency(edges):
    adj = {}
    for u, v in edges:
        adj.setdefault(u, set()).add(v)
        adj.setdefault(v, set()).add(u)
    return adj


def parts(adj, nodes):
    left, out = set(nodes), []
    while left:
        todo, comp = [left.pop()], set()
        while todo:
            x = todo.pop()
            comp.add(x)
            for y in adj.get(x, ()):
                if y in left:
                    left.remove(y)
                    todo.append(y)
        out.append(comp)
    return out


CASES = [*NAMED, "random"]


@pytest.fixture(params=CASES)
def edges(request):
    return NAMED.get(request.param) if request.param in NAMED else random_edges(40, 110, 7)


def test_structure(spark, edges):
    adj, df = adjacency(edges), frame(spark, edges)
    tri = {n: sum(1 for a, b in itertools.combinations(sorted(adj[n]), 2) if b in adj[a]) for n in adj}
    got = {r["n"]: r for r in structure.clustering(df).collect()}
    assert {n: (r["deg"], r["triangles"]) for n, r in got.items()} == {n: (len(adj[n]), tri[n]) for n in adj}
    assert all(abs(r["clustering"] - (2 * tri[n] / (d * (d - 1)) if (d := len(adj[n])) > 1 else 0)) < 1e-12 for n, r in got.items())
    comps = {r["node"]: r["component"] for r in connected_components(df).collect()}
    assert comps == {n: min(c) for c in parts(adj, adj) for n in c}
    codes = {}
    for n in adj:
        inner = {x: adj[x] & adj[n] for x in adj[n]}
        cs = sorted(((len(c), sum(len(inner[x]) for x in c) // 2, sorted((len(inner[x]) for x in c), reverse=True)) for c in parts(inner, inner)), reverse=True)
        codes[n] = "|".join(f"{s}:{e}:{','.join(map(str, d))}" for s, e, d in cs)
    assert {r["ego"]: r["code"] for r in structure.ncc(df).collect()} == codes
    core, left = {}, {n: set(a) for n, a in adj.items()}
    k = 0
    while left:
        n = min(left, key=lambda x: len(left[x]))
        k = max(k, len(left[n]))
        core[n] = k
        for m in left.pop(n):
            left[m].discard(n)
    assert {r["n"]: r["core"] for r in structure.core_numbers(df).collect()} == core


def test_signatures_and_distances(spark):
    edges = random_edges(30, 60, 3)
    adj, df = adjacency(edges), frame(spark, edges)
    for r in structure.signatures(df).collect():
        inner = {x: adj[x] & adj[r["n"]] for x in adj[r["n"]]}
        sizes = sorted(map(len, parts(inner, inner)), reverse=True) + [0]
        assert (r["deg"], r["largest"], r["second"], r["ego_edges"]) == (len(adj[r["n"]]), sizes[0], sizes[1], sum(map(len, inner.values())) // 2)
    want = set()
    for s in adj:
        dist, todo = {s: 0}, [s]
        for x in todo:
            for y in adj[x]:
                if y not in dist:
                    dist[y] = dist[x] + 1
                    todo.append(y)
        want |= {(s, t, d) for t, d in dist.items()}
    assert {tuple(r) for r in structure.distances(df, graphs.nodes_of(df)).collect()} == want


def test_groups_and_templates(spark):
    edges = random_edges(23, 50, 5)
    adj, df = adjacency(edges), frame(spark, edges)
    rows = sorted(anonymise.fixed_groups(df, 5).collect(), key=lambda r: (r["g"], r["pos"]))

    def short(n):
        """(size, edges) of the components among n's neighbours, descending, four at most."""
        left, found = set(adj[n]), []
        while left:
            part, todo = set(), [left.pop()]
            while todo:
                part.add(x := todo.pop())
                todo += [y for y in adj[x] if y in left]
                left -= set(todo)
            found.append((len(part), sum(y in part for x in part for y in adj[x]) // 2))
        return sorted(found, reverse=True)[:4]

    order = sorted(adj, key=lambda n: (-len(adj[n]), short(n), n))
    cut = [order[i : i + 5] for i in range(0, len(order), 5)]
    cut = cut if len(cut[-1]) == 5 else [*cut[:-2], cut[-2] + cut[-1]]
    assert [r["n"] for r in rows] == [n for g in cut for n in sorted(g)]
    sizes = [len(list(g)) for _, g in itertools.groupby(rows, key=lambda r: r["g"])]
    assert min(sizes) >= 5 and max(sizes) < 10
    out = {tuple(r) for r in anonymise.publish(df, 5).collect()}
    assert set(edges) < out and all(u < v for u, v in out)
    ring = {tuple(r) for r in anonymise.ring_template(df, anonymise.fixed_groups(df, 5)).collect()}
    assert ring and not ring & set(edges)
    w = [r["w"] for r in anonymise.edge_weights(df).collect()]
    assert min(w) >= 1 and max(w) <= 99


def test_compare(spark):
    a, b = frame(spark, NAMED["path4"]), frame(spark, NAMED["triangle"])
    r = compare.edge_changes(a, b).first()
    assert (r["preserved"], r["added"], r["removed"], r["changes"]) == (2, 1, 1, 2)
    loss = compare.degree_loss(a, b).first()
    assert abs(loss["mae"] - 0.5) < 1e-12 and abs(loss["rmse"] - 0.5**0.5) < 1e-12
    assert compare.wasserstein(a, a).first()["distance"] == 0
    k = {r["k"]: r["anonymous"] for r in compare.k_degree(frame(spark, NAMED["K4"]), (2, 4, 5)).collect()}
    assert k == {2: True, 4: True, 5: False}
    d = compare.structural_delta(a, b).first()
    assert d["nodes_variation"] == -1 and d["edges_variation"] == 0


def test_attack_maps_equal_graphs(spark):
    df = frame(spark, random_edges(40, 160, 9))
    found = attack.propagate(df, df, attack.seeds(df))
    row = attack.success(found).first()
    assert row["mapped"] > 20 and row["correct"] / row["mapped"] > 0.9


def test_scores(spark):
    rows = [(0.9, 1), (0.8, 0), (0.8, 1), (0.5, 0), (0.1, 1), (0.1, 0), (0.1, 0)]
    r = evaluate.ranking_scores(spark.createDataFrame(rows, "score double, y int")).first()
    wins = sum((a > b) + 0.5 * (a == b) for a, y in rows if y for b, z in rows if not z)
    assert abs(r["auc"] - wins / 12) < 1e-12
    assert abs(r["average_precision"] - (1 * 1 + 1 * 2 / 3 + 1 * 3 / 7) / 3) < 1e-12
    one = evaluate.ranking_scores(spark.createDataFrame([(0.5, 1)], "score double, y int")).first()
    assert one["auc"] is None and one["average_precision"] == 1
    c = evaluate.classification(spark.createDataFrame([("a", "a"), ("a", "b"), ("b", "b"), ("c", "b")], "y string, guess string")).first()
    assert (c["rows"], c["accuracy"], c["micro_f1"]) == (4, 0.5, 0.5) and abs(c["macro_f1"] - (2 / 3 + 0.5 + 0) / 3) < 1e-12


def test_summaries_skip_what_is_not_finite(spark):
    nan = float("nan")
    df = spark.createDataFrame([("a", 1, 1.0), ("a", 1, nan), ("a", 2, 3.0), ("b", 1, float("inf"))], "m string, k int, s double")
    got = {r["m"]: (r["s_mean"], r["s_std"]) for r in evaluate.summary(df, ["m"], ["s"]).collect()}
    assert got["a"] == (2.0, 2.0**0.5) and got["b"] == (None, 0.0)
    assert {r["m"]: r["change"] for r in evaluate.trend(df, "m", "k", "s").collect()} == {"a": 2.0, "b": None}


def test_hierarchy(spark):
    tree = spark.createDataFrame([("a", "x"), ("b", "x"), ("c", "y"), ("x", "*"), ("y", "*")], "child string, parent string")
    got = {r["node"]: (r["leaves"], round(r["ncp"], 3)) for r in hierarchy.leaf_costs(tree).collect()}
    assert got == {"a": (1, 0.333), "b": (1, 0.333), "c": (1, 0.333), "x": (2, 0.667), "y": (1, 0.333), "*": (3, 1)}
    deep = spark.createDataFrame([(f"d{i}", f"d{i + 1}") for i in range(90)] + [("p", "q"), ("q", "p")], "child string, parent string")
    up = {(r["node"], r["ancestor"]): r["up"] for r in hierarchy.ancestors(deep).collect()}
    assert up["d0", "d90"] == 90 and up["p", "q"] == 1 and ("p", "p") in up and len(up) == 91 * 92 // 2 + 4
    pairs = spark.createDataFrame([("a", "b"), ("a", "c"), ("a", "x"), ("a", "a")], "u string, v string")
    assert {(r["u"], r["v"]): r["lca"] for r in hierarchy.common_ancestor(tree, pairs).collect()} == {("a", "b"): "x", ("a", "c"): "*", ("a", "x"): "x", ("a", "a"): "a"}


def test_edge_list_files(spark, tmp_path):
    (tmp_path / "g.pairs").write_text("# c\n1 2\n2 1\n3 3\n4\n5 6 99\n\nx y\n")
    nodes, edges = graphs.read_pairs(spark, f"{tmp_path}/g.pairs")
    assert {tuple(r) for r in edges.collect()} == {(1, 2), (5, 6)} and {r["n"] for r in nodes.collect()} == {1, 2, 3, 5, 6}
    graphs.write_pairs(edges, f"{tmp_path}/out")
    assert {tuple(r) for r in graphs.read_pairs(spark, f"{tmp_path}/out")[1].collect()} == {(1, 2), (5, 6)}
    (tmp_path / "labels").write_text("1 red\n9 blue\n")
    assert {tuple(r) for r in graphs.read_labels(spark, f"{tmp_path}/labels", nodes).collect()} == {(1, "red"), (2, "*"), (3, "*"), (5, "*"), (6, "*")}
    (tmp_path / "g.csv").write_text("source,target\n1,2\n3;4\n")
    assert graphs.read_tokens(spark, f"{tmp_path}/g.csv").count() == 2
    (tmp_path / "named.txt").write_text("a b\nb u\nu c\nfrom a\n# u v\n")
    assert {tuple(r) for r in graphs.read_tokens(spark, f"{tmp_path}/named.txt").collect()} == {("a", "b"), ("b", "u"), ("u", "c"), ("from", "a")}
    (tmp_path / "g.gml").write_text("graph [\n node [ id 1 ]\n edge [\n source 1\n target 2\n ]\n edge [ source 3 target 1 ] ]")
    assert {tuple(r) for r in graphs.read_gml_edges(spark, f"{tmp_path}/g.gml").collect()} == {(1, 2), (1, 3)}


def plain_segments(degs, k, squared):
    """The same rule over the whole sorted list of degrees."""

    def cost(part):
        if not part:
            return 0
        mean, m = round(sum(part) / len(part)), sorted(part)
        median = round((m[(len(m) - 1) // 2] + m[len(m) // 2]) / 2)
        return min(sum(abs(d - c) ** (1 + squared) for d in part) for c in (mean, median))

    out, s = [], 0
    while len(degs) - s >= 2 * k:
        e = s + k
        while len(degs) - e >= k + 1 and cost(degs[s : e + 1]) + cost(degs[e + 1 : e + 1 + k]) < cost(degs[s:e]) + cost(degs[e : e + k]):
            e += 1
        out.append(e - s)
        s = e
    return out + [len(degs) - s] if degs else []


@pytest.mark.parametrize("squared", [False, True])
def test_segment_ends(squared):
    for seed in range(40):
        rng = random.Random(seed)
        degs = sorted((int(rng.expovariate(0.2)) + 1 for _ in range(rng.randrange(5, 90))), reverse=True)
        runs = [(d, len(list(g))) for d, g in itertools.groupby(degs)]
        at = segments.Stretch(0, *map(list, zip(*runs)), 4, squared, len(degs))
        sizes, s = [], 0
        while s < len(degs):
            sizes.append(at.end(s) - s)
            s += sizes[-1]
        assert sizes == plain_segments(degs, 4, squared)
        few = segments.Stretch(0, [d for d, _ in runs[:3]], [n for _, n in runs[:3]], 4, squared, len(degs))
        assert all(few.end(s) in (None, at.end(s)) for s in range(few.ends[-1]))
        for e in range(len(degs)):
            flat, deg, to = at.landing(e)
            assert to == e + 4 * flat and all(at.end(e + 4 * i) == e + 4 * i + 4 and degs[e + 4 * i] == deg for i in range(flat))


def star_and_pairs(pairs):
    return [(0, i) for i in range(1, 30)] + [(1, 2), (2, 3)] + [(100 + 2 * i, 101 + 2 * i) for i in range(pairs)]


@pytest.mark.parametrize(("edges", "k", "squared"), [(random_edges(60, 150, 2), 4, False), (random_edges(60, 150, 2), 4, True), (star_and_pairs(150), 7, False), (NAMED["none"], 3, False), (NAMED["path4"], 5, True), (random_edges(300, 900, 3), 2, True)])
def test_segments(spark, edges, k, squared):
    rows = sorted(segments.degree_segments(frame(spark, edges), k, squared).collect(), key=lambda r: r["rank"])
    degs = sorted(map(len, adjacency(edges).values()), reverse=True)
    assert [r["deg"] for r in rows] == degs and [r["rank"] for r in rows] == list(range(1, len(degs) + 1))
    sizes = plain_segments(degs, k, squared)
    assert [r["segment"] for r in rows] == [i for i, n in enumerate(sizes) for _ in range(n)]
    at = 0
    for n in sizes:
        part = degs[at : at + n]
        middle = sorted(part)
        both = [round(sum(part) / n), round((middle[(n - 1) // 2] + middle[n // 2]) / 2)]
        cost = [sum(abs(d - c) ** (1 + squared) for d in part) for c in both]
        assert {r["target"] for r in rows[at : at + n]} == {both[0] if cost[0] < cost[1] else both[1]}
        at += n


def test_chained_links(spark):
    links = spark.createDataFrame([(i, i + 3 if i + 3 < 60 else None, i % 4) for i in range(-1, 60)], "s long, next long, w long")
    want, s, at = [], -1, 0
    while s is not None:
        want.append((s, at))
        s, at = (s + 3 if s + 3 < 60 else None), at + s % 4
    assert sorted(tuple(r) for r in segments.chained(links, -1).collect()) == want


def test_rewire_moves_towards_targets(spark):
    edges = random_edges(60, 200, 4)
    df = frame(spark, edges)
    targets = segments.degree_segments(df, 5).select("n", "target")
    want = {r["n"]: r["target"] for r in targets.collect()}
    out = [tuple(r) for r in segments.rewire(df, targets).collect()]
    assert all(u < v for u, v in out) and len(set(out)) == len(out)
    off = lambda adj: sum(abs(len(adj.get(n, ())) - t) for n, t in want.items())
    assert off(adjacency(out)) < off(adjacency(edges))


def test_forest_and_codes(spark):
    edges = random_edges(40, 45, 6)
    df, adj = frame(spark, edges), adjacency(edges)
    comp = connected_components(df)
    roots = comp.selectExpr("component AS n").distinct()
    forest = {r["n"]: r["parent"] for r in segments.spanning_forest(df, comp, structure.distances(df, roots)).collect()}
    assert len(forest) == len(adj) - len(parts(adj, adj)) and all(p in adj[n] for n, p in forest.items())
    vectors = structure.ncc_vectors(df)
    vec = {r["n"]: r["vec"] for r in vectors.collect()}
    for r in structure.ncc_distance(vectors, df).collect():
        a, b = vec[r["u"]], vec[r["v"]]
        gap = sum(abs(x - y) for x, y in itertools.zip_longest(a, b, fillvalue=0))
        assert abs(r["distance"] - gap / max(sum(a), sum(b), 1)) < 1e-12
    paths = structure.path_lengths(structure.distances(frame(spark, NAMED["two"]), graphs.nodes_of(frame(spark, NAMED["two"]))), 4).first()
    assert paths["reachable_mean"] == 1 and abs(paths["all_pairs_mean"] - 1 / 3) < 1e-12 and paths["pairs"] == 2


def test_code_distances_keep_whole_codes(spark):
    star = [(0, i) for i in range(1, 13)]
    clique = list(itertools.combinations(range(20, 32), 2))
    edges = star + clique + [(0, 20), (0, 21), (12, 22), (40, 41), (41, 42), (40, 42)]
    adj = adjacency(edges)
    codes = {}
    for n in adj:
        comps = [(len(c), [len(adj[x] & c) for x in c]) for c in map(set, parts(adj, adj[n]))]
        codes[n] = sorted(((size, sum(d) // 2, sorted(d, reverse=True)) for size, d in comps), reverse=True)
    width = max(len(d) for code in codes.values() for _, _, d in code)
    weight = {n: sum(s + e + sum(d) for s, e, d in code) for n, code in codes.items()}
    flat = {n: [x for s, e, d in code for x in (s, e, *d, *[0] * (width - len(d)))] for n, code in codes.items()}
    pairs = list(itertools.combinations(sorted(adj), 2))
    want = {(u, v): sum(abs(x - y) for x, y in itertools.zip_longest(flat[u], flat[v], fillvalue=0)) / max(weight[u], weight[v], 1) for u, v in pairs}
    df = frame(spark, edges)
    for made in (structure.ncc_vectors(df, None), structure.ncc_codes(df, None)):
        got = {(r["u"], r["v"]): r["distance"] for r in structure.ncc_distance(made, frame(spark, pairs)).collect()}
        assert got.keys() == want.keys() and all(abs(got[p] - want[p]) < 1e-12 for p in pairs)
    assert max(len(c) for c in codes.values()) > 8 and width > 9


def test_ranks_over_hot_degrees(spark):
    edges = spark.createDataFrame([(0, i) for i in range(1, 200)] + [(1, 2)], "u long, v long")
    got = [tuple(r) for r in compare.ordered_by_degree(edges).orderBy("rank").collect()]
    deg = {0: 199, 1: 2, 2: 2} | {i: 1 for i in range(3, 200)}
    assert got == [(n, d, i) for i, (n, d) in enumerate(sorted(deg.items(), key=lambda x: (-x[1], x[0])), 1)]


def test_results_and_mappings(spark, tmp_path):
    rows = spark.createDataFrame([("a", 2, 0.5), ("b", 5, float("nan")), ("c", 5, None)], "method string, k int, auc double")
    graphs.write_results(rows, f"{tmp_path}/r")
    back = graphs.read_results(spark, f"{tmp_path}/r", ["auc", "absent"])
    assert sorted(map(tuple, back.collect())) == [("a", "2", 0.5), ("b", "5", None), ("c", "5", None)]
    more = spark.createDataFrame([("b", 5, 0.9, 1), ("d", 5, 0.1, 2)], "method string, k int, auc double, n int")
    got = sorted(map(tuple, evaluate.overlaid([rows.where("k = 5"), more], ["method", "k"]).collect()))
    assert got == [("b", 5, 0.9, 1), ("c", 5, None, None), ("d", 5, 0.1, 2)]
    (tmp_path / "m.txt").write_text("1 2\n3 4 5\nx y\n1 7\n\n8\n9 9\n")
    assert sorted(map(tuple, graphs.read_mapping(spark, str(tmp_path / "m.txt")).collect())) == [(1, 7), (9, 9)]
    (tmp_path / "g").mkdir()
    (tmp_path / "g" / "cora-k5-x.pairs").write_text("1 2\n2 1\n3 3\n2 3\n")
    (row,) = graphs.folder_characteristics(spark, str(tmp_path / "g")).collect()
    assert (row["k"], row["nodes"], row["edges"], round(row["mean_degree"], 6)) == (5, 3, 2, round(4 / 3, 6))


def test_medoid_and_profile(spark):
    edges = spark.createDataFrame([(1, 2), (1, 3), (2, 3), (3, 4), (4, 5)], "u long, v long")
    groups = spark.createDataFrame([(n, d, i, 0) for i, (n, d) in enumerate([(1, 2), (2, 2), (4, 2), (5, 1)])], "n long, deg long, pos long, g long")
    codes = structure.ncc_codes(edges)
    assert [tuple(r) for r in anonymise.medoids(groups, codes).collect()] == [(0, 1)]
    scores = {r["n"]: r["score"] for r in anonymise.profile_scores(groups, codes).collect()}
    assert scores[1] == scores[2] == 0 and scores[5] > scores[4] > 0


def test_split_keeps_every_component_whole(spark):
    edges = spark.createDataFrame([(i, j) for b in (0, 10) for i in range(b, b + 6) for j in range(i + 1, b + 6)], "u long, v long")
    train, test = segments.protected_split(edges, 0.5)
    assert test.count() == 15 and train.count() == 15
    parts = {r["component"] for r in connected_components(train).collect()}
    assert parts == {0, 10} and connected_components(train).count() == 12
    with pytest.raises(ValueError):
        segments.sampled_non_edges(edges, 1000)


def test_rewire_reads_the_graph_once_for_all_rounds(spark, monkeypatch):
    edges = set(random_edges(40, 220, 5))
    rows = lambda s: [tuple(sorted(p)) for p in s]
    count = lambda s: {n: sum(n in p for p in s) for n in range(40)}
    deg = count(edges)
    target = {n: max(0, d + (n * 7) % 9 - 4) for n, d in deg.items()}
    md5 = lambda *x: hashlib.md5("|".join(map(str, x)).encode()).hexdigest()
    now = set(edges)
    for i in range(3):
        gap = {n: d - target[n] for n, d in count(now).items()}
        able = sorted((md5(i, u, v), u, v) for u, v in now if gap[u] > 0 and gap[v] > 0)
        first = lambda n: {(u, v) for _, u, v in [x for x in able if n in x[1:]][: gap[n]]}  # noqa: B023, E731
        gone = {(u, v) for _, u, v in able if (u, v) in first(u) and (u, v) in first(v)}
        want = [n for _, n in sorted((md5(f"w{i}", n, j), n) for n, g in gap.items() for j in range(1, 1 - g))]
        now = now - gone | {(min(p), max(p)) for p in zip(want[::2], want[1::2], strict=False) if p[0] != p[1]}
    counted, plain = [], segments.degrees
    monkeypatch.setattr(segments, "degrees", lambda e: counted.append(1) or plain(e))
    goal = spark.createDataFrame([(n, t) for n, t in target.items()], "n long, target long")
    assert sorted(tuple(r) for r in segments.rewire(frame(spark, sorted(edges)), goal).collect()) == sorted(rows(now))
    assert len(counted) == 1 and now != edges
    known = spark.createDataFrame([(n, deg[n], t) for n, t in target.items()], "n long, deg long, target long")
    assert sorted(tuple(r) for r in segments.rewire(frame(spark, sorted(edges)), known).collect()) == sorted(rows(now))
    assert len(counted) == 1
