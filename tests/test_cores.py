from test_graphs import frame, random_edges

from veilgraph.operators import structure


def brute(pairs):
    near = {}
    for u, v in pairs:
        near.setdefault(u, set()).add(v)
        near.setdefault(v, set()).add(u)
    core, k = {}, 0
    while near:
        n = min(near, key=lambda x: len(near[x]))
        core[n] = k = max(k, len(near[n]))
        for m in near.pop(n):
            near[m].discard(n)
    return core


def test_blocks_settle_at_once(spark, monkeypatch):
    path = [(x, x + 1) for x in range(300)]  # a value crosses the path a node a round unless blocks settle
    assert {r["n"]: r["core"] for r in structure.core_numbers(frame(spark, path), rounds=3).collect()} == brute(path)
    monkeypatch.setattr(structure, "BLOCK", 250)
    pairs = sorted({*random_edges(40, 200, 5), *[(0, x) for x in range(1, 90)], *[(x, x + 1) for x in range(100, 112)]})
    assert {r["n"]: r["core"] for r in structure.core_numbers(frame(spark, pairs)).collect()} == brute(pairs)


def test_blocks_tell_only_what_fell(spark, monkeypatch):
    from veilgraph.operators import cores

    told, staged = [], cores.staged

    def spied(df, what):
        out = staged(df, what)
        if what == "core" and "kind" in out.columns:
            told.append(sum(r["n"] for r in out.where(f"kind = {cores.TOLD}").collect()))
        return out

    monkeypatch.setattr(cores, "staged", spied)
    monkeypatch.setattr(structure, "BLOCK", 60)
    pairs = sorted({*random_edges(40, 200, 5), *[(x, x + 1) for x in range(100, 160)]})
    got = structure.core_numbers(frame(spark, pairs))
    assert {r["n"]: r["core"] for r in got.collect()} == brute(pairs)
    assert 0 < told[0] <= 2 * len(pairs) and told[-1] == 0 and all(x < told[0] for x in told[1:])
    assert structure.core_numbers(frame(spark, [])).collect() == []
