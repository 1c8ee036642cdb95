import math

import numpy as np

from veilgraph.llm import topk


def brute(rows, queries, k, scale=1024):
    ok = [(i, [math.floor(scale * x) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for i, v in sorted({i: min(w for j, w in ok if j == i) for i, _ in ok if i in queries}.items()):
        scores = sorted(((-sum(a * b for a, b in zip(v, w, strict=False)), j) for j, w in ok if j != i))[:k]
        out += [(i, r, j, -s) for r, (s, j) in enumerate(scores, 1)]
    return out


def run(spark, rows, queries, k=10):
    df = spark.createDataFrame([(i, v, "x") for i, v in rows], "vec_id long, embedding array<double>, id string")
    return sorted(tuple(r) for r in topk.top_k(df, df.where(df.vec_id.isin(queries)), k).collect())


def test_against_brute_force(spark, monkeypatch):
    rng = np.random.default_rng(2)
    rows = [(int(i), [float(x) for x in rng.normal(0, rng.choice([0.1, 1, 3]), 20)]) for i in range(300)]
    rows += [(1000 + i, rows[i % 7][1]) for i in range(40)]  # ties
    rows += [(5, rows[9][1]), (5, rows[5][1]), (None, rows[0][1]), (2000, None), (2001, [1.0, None]), (2002, [math.nan] * 20), (2003, [math.inf] * 20), (2004, []), (2005, [0.5] * 3), (2006, [-0.0001] * 20)]
    queries = [0, 5, 9, 100, 1000, 2000, 2002, 2004, 2005, 2006]
    want = sorted(brute(rows, queries, 10))
    assert run(spark, rows, queries) == want
    monkeypatch.setattr(topk, "GROUP", 3)
    monkeypatch.setattr(topk, "SAMPLE", 5)
    assert run(spark, rows, queries) == want


def test_few_and_none(spark):
    assert run(spark, [(1, [1.0]), (2, [2.0])], [1]) == [(1, 1, 2, 2048 * 1024)]
    assert run(spark, [(1, [1.0])], [1]) == []
    assert run(spark, [(1, None)], [1]) == []


def test_large_components(spark):
    rows = [(i, [float(2**18 + i % 3), float(i % 2)]) for i in range(30)]
    assert run(spark, rows, [3]) == brute(rows, [3], 10)


def test_scores_beyond_floats_are_exact(spark):
    rng = np.random.default_rng(5)
    rows = [(i, [float(x) for x in rng.uniform(1e5, 3e5, 8)]) for i in range(60)]
    assert run(spark, rows, [0, 7]) == sorted(brute(rows, [0, 7], 10))
    wide = [(i, [float(x) for x in rng.uniform(-1e9, 1e9, 3)]) for i in range(40)]
    most = 2**63 - 1
    clipped = sorted((q, -min(max(s, -most), most), v) for q, _, v, s in brute(wide, [3], 100))[:10]
    assert [(q, -s, v) for q, r, v, s in run(spark, wide, [3])] == clipped


def test_components_beyond_longs_count_as_their_limits(spark):
    got = run(spark, [(1, [1e300]), (2, [1e200]), (3, [-1e300]), (4, [1.0])], [1])
    assert [r[2] for r in got] == [2, 4, 3] and got[0][3] == 2**63 - 1
