import itertools
import math

import pytest
from test_graphs import frame, random_edges

from veilgraph.operators import anonymise, cells, structure


@pytest.mark.parametrize("size", [60, 10_000])
def test_cells_against_brute_force(spark, monkeypatch, size):
    monkeypatch.setattr(cells, "CELL", size)
    pairs = sorted({*random_edges(30, 140, 3), *[(0, x) for x in range(1, 30)]})  # node 0 is a hub
    edges, near = frame(spark, pairs), {n: {m for p in pairs for m in p if n in p and m != n} for n in range(30)}
    t = structure.triangles(edges)
    assert "Join" not in t._jdf.queryExecution().toString()  # wedges stay in their cells
    found = [tuple(sorted(r)) for r in t.collect()]
    assert sorted(found) == [x for x in itertools.combinations(range(30), 3) if all(y in set(pairs) for y in itertools.combinations(x, 2))]
    asked = [(u, v) for u in range(0, 30, 2) for v in range(u + 1, 32)]  # 30 and 31 are no nodes
    for got, want in ((structure.edge_common_neighbours(edges), pairs), (structure.common_neighbours(edges, frame(spark, asked)), asked)):
        rows = {(r["u"], r["v"]): (r["common"], r["adamic_adar"]) for r in got.collect()}
        both = {p: near[p[0]] & near.get(p[1], set()) for p in want}
        assert set(rows) == {p for p, c in both.items() if c}
        for p, (c, s) in rows.items():
            assert c == len(both[p]) and math.isclose(s, sum(1 / math.log(len(near[w])) for w in both[p]), abs_tol=1e-9)
    common = {(r["u"], r["v"]): r["common"] for r in structure.edge_triangles(edges).collect()}
    assert common == {p: len(near[p[0]] & near[p[1]]) for p in pairs if near[p[0]] & near[p[1]]}


def test_counts_leave_cells_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(cells, "CELL", 60)
    monkeypatch.setattr(cells, "PART", 16)
    pairs = sorted(random_edges(30, 140, 3))
    edges, near = frame(spark, pairs), {n: {m for p in pairs for m in p if n in p and m != n} for n in range(30)}
    plan = structure.edge_common_neighbours(edges)._jdf.queryExecution().analyzed().toString()
    assert "Aggregate [u" not in plan  # no row an edge and cell is shuffled to be summed
    twice = frame(spark, [(0, 1), (2, 5), (0, 1)])
    assert sorted((r["u"], r["v"], r["common"]) for r in structure.common_neighbours(edges, twice).collect()) == [(u, v, len(near[u] & near[v])) for u, v in ((0, 1), (2, 5)) if near[u] & near[v]]


def test_significance_without_joins_of_edges(spark):
    pairs = sorted(random_edges(30, 140, 3))
    edges, near = frame(spark, pairs), {n: {m for p in pairs for m in p if n in p and m != n} for n in range(30)}
    scored = anonymise.edge_significance(edges)
    assert "Join LeftOuter" not in scored._jdf.queryExecution().analyzed().toString()
    top = max(map(len, near.values()))
    rows = {(r["u"], r["v"]): (r["nc"], r["common"]) for r in scored.collect()}
    assert set(rows) == set(pairs)
    for (u, v), (nc, common) in rows.items():
        assert common == len(near[u] & near[v]) and math.isclose(nc, (len(near[u]) + len(near[v]) - 2 * common) / (2 * top), abs_tol=1e-12)


@pytest.mark.parametrize("size", [60, 10_000])
def test_triangles_of_nodes_are_counted_in_cells(spark, monkeypatch, size):
    monkeypatch.setattr(cells, "CELL", size)
    pairs = sorted({*random_edges(30, 140, 3), (40, 41)})
    near = {n: {m for p in pairs for m in p if n in p and m != n} for n in {x for p in pairs for x in p}}
    got = structure.clustering(frame(spark, pairs))
    assert "explode" not in got._jdf.queryExecution().analyzed().toString()  # no triangle leaves its cell
    assert {r["n"]: r["triangles"] for r in got.collect()} == {n: sum(b in near[a] for a, b in itertools.combinations(s, 2)) for n, s in near.items()}
    assert structure.clustering(frame(spark, [(0, 1), (1, 2)])).agg({"triangles": "sum"}).first()[0] == 0


@pytest.mark.parametrize("size", [25, 40])
def test_passes_hold_few_copies_of_an_edge(spark, monkeypatch, size):
    monkeypatch.setattr(cells, "CELL", size)
    pairs = sorted({*random_edges(30, 140, 3), *[(0, x) for x in range(1, 30)]})
    edges, near = frame(spark, pairs), {n: {m for p in pairs for m in p if n in p and m != n} for n in range(30)}
    p = cells.colours(len(pairs))
    passes = cells.passes_of(p)
    assert p > 4
    at, when = cells._cells(p)[1], cells._passes(p, passes)
    for i, j in itertools.combinations_with_replacement(range(p), 2):
        copies = [sum(when[c] == now for c in set(at[i, j].tolist())) for now in range(passes)]
        assert 1 <= min(copies) and max(copies) <= 2 and sum(copies) == len(set(at[i, j].tolist()))
    monkeypatch.setattr(cells, "PART", 16)
    asked = [(u, v) for u in range(0, 30, 2) for v in range(u + 1, 32)]
    for got, want in ((structure.edge_common_neighbours(edges), pairs), (structure.common_neighbours(edges, frame(spark, asked)), asked)):
        both = {x: near[x[0]] & near.get(x[1], set()) for x in want}
        rows = {(r["u"], r["v"]): (r["common"], r["adamic_adar"]) for r in got.collect()}
        assert set(rows) == {x for x, c in both.items() if c}
        assert all(c == len(both[x]) and math.isclose(s, sum(1 / math.log(len(near[w])) for w in both[x]), abs_tol=1e-9) for x, (c, s) in rows.items())
    ends = {(r["u"], r["v"]): (r["du"], r["dv"]) for r in structure.edge_ends(edges).collect()}
    assert ends == {(u, v): (len(near[u]), len(near[v])) for u, v in pairs}
    want = {n: sum(b in near[a] for a, b in itertools.combinations(s, 2)) for n, s in near.items()}
    assert {r["n"]: r["triangles"] for r in structure.clustering(edges).collect()} == want
