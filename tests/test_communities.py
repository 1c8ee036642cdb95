import itertools
import math
import random
from collections import Counter

import pytest
from test_graphs import adjacency, frame, random_edges

from veilgraph.operators import communities, walks


def plain_modularity(edges, of):
    m, ends = len(edges), Counter()
    for u, v in edges:
        ends[of[u]] += 1
        ends[of[v]] += 1
    return sum(of[u] == of[v] for u, v in edges) / m - sum((d / (2 * m)) ** 2 for d in ends.values())


def planted(groups, size, inside, outside, seed):
    rng = random.Random(seed)
    n = groups * size
    return [(u, v) for u, v in itertools.combinations(range(n), 2) if rng.random() < (inside if u % groups == v % groups else outside)]


@pytest.mark.parametrize(("groups", "size", "inside", "outside"), [(4, 20, 0.5, 0.03)])
def test_planted_communities(spark, groups, size, inside, outside):
    edges = planted(groups, size, inside, outside, 1)
    df = frame(spark, edges)
    found = communities.louvain(df)
    of = {r["n"]: r["c"] for r in found.collect()}
    assert set(of) == set(adjacency(edges)) and all(min(n for n in of if of[n] == c) == c for c in set(of.values()))
    got, want = plain_modularity(edges, of), plain_modularity(edges, {n: n % groups for n in of})
    assert got >= 0.95 * want
    row = communities.modularity(df, found).first()
    assert row["communities"] == len(set(of.values())) and math.isclose(row["modularity"], got)


def test_hub_parts_and_nothing(spark):
    edges = [(0, i) for i in range(1, 60)] + [(100, 101), (101, 102), (100, 102)]
    of = {r["n"]: r["c"] for r in communities.louvain(frame(spark, edges)).collect()}
    assert len({of[n] for n in (100, 101, 102)}) == 1 and of[100] == 100 and len({of[n] for n in range(60)}) == 1
    none = communities.louvain(frame(spark, []))
    assert none.collect() == [] and communities.modularity(frame(spark, []), none).first()["modularity"] == 0


def test_walks_follow_edges_and_repeat(spark):
    edges = random_edges(20, 45, 5) + [(50, 51)]
    adj = adjacency(edges)
    run = lambda **more: sorted((r["n"], r["walk"], tuple(r["path"])) for r in walks.random_walks(frame(spark, edges), 5, 3, **more).collect())
    got = run(p=0.25, q=4.0)
    assert [(n, w) for n, w, _ in got] == sorted((n, w) for n in adj for w in range(3))
    assert all(p[0] == n and len(p) == 5 and all(b in adj[a] for a, b in itertools.pairwise(p)) for n, _, p in got)
    assert got == run(p=0.25, q=4.0) != run(p=0.25, q=4.0, seed=7)
    assert walks.random_walks(frame(spark, []), 4, 2).collect() == []


def test_transition_frequencies(spark):
    edges = [(0, 1), (0, 2), (1, 2), (1, 3), (1, 4)]  # from 0 by 1: back 1 / p, 2 is near 0, 3 and 4 are not
    p, q, many = 0.5, 2.0, 6000
    rows = walks.random_walks(frame(spark, edges), 3, many, p, q).where("n = 0 AND path[1] = 1").groupBy("path").count().collect()
    seen = {r["path"][2]: r["count"] for r in rows}
    odds = {0: 1 / p, 2: 1.0, 3: 1 / q, 4: 1 / q}
    total = sum(seen.values())
    assert abs(total / many - 0.5) < 0.03
    for n, w in odds.items():
        share = w / sum(odds.values())
        assert abs(seen[n] / total - share) < 4 * math.sqrt(share * (1 - share) / total)


def test_classes_from_walks(spark):
    edges = planted(2, 20, 0.5, 0.02, 3)
    df = frame(spark, edges)
    vectors = walks.walk_vectors(walks.random_walks(df, 8, 6), 8, 3)
    nodes = sorted(adjacency(edges))
    labels = spark.createDataFrame([(n, "ab"[n % 2]) for n in nodes], "n long, y string")
    parts = spark.createDataFrame([(n, "test" if n % 5 == 0 else "train") for n in nodes], "n long, part string")
    rows = walks.walk_classes(vectors, labels, parts).collect()
    assert {r["n"] for r in rows} == {n for n in nodes if n % 5 == 0}
    assert sum(r["y"] == r["guess"] for r in rows) >= 0.75 * len(rows)
