import random

import pytest
from pyspark.sql import functions as F

from veilgraph.operators import nearest
from veilgraph.plans.staging import staged


def made(kind):
    """(n, t, a, b, c) rows."""
    rng = random.Random(kind)
    if kind == "copies":  # a third are one point, many others share theirs
        return [(i, -rng.randrange(3), *((1.0, 1.0, 0.0) if i % 3 == 0 else (float(rng.randrange(3)), float(rng.randrange(2)), 0.0))) for i in range(200)]
    if kind == "far":  # one row far from all others
        return [(i, 0, rng.random(), rng.random(), 0.5) for i in range(120)] + [(500, 0, 1e9, -1e9, 3.0)]
    if kind == "few":
        return [(1, 0, 0.0, 0.0, 0.0), (2, 0, 3.0, 4.0, 0.0)]
    return [(i, -i % 5, rng.gauss(i % 4 * 10, 1), rng.gauss(i % 3 * 10, 1), float(i % 7)) for i in range(300)]


def table(spark, rows):
    return spark.createDataFrame(rows, "n long, t long, a double, b double, c double")


@pytest.mark.parametrize("kind", ["copies", "far", "few", "clusters"])
def test_nearest_equals_all_pairs(spark, kind):
    rows, k = made(kind), 4
    got = {}
    for r in nearest.nearest(table(spark, rows), table(spark, rows).select(F.col("n").alias("seed")), ["a", "b", "c"], k, ties="t", most=8).collect():
        got.setdefault(r["seed"], {})[r["rank"]] = (r["n"], r["distance"])
    for n, _, *x in rows:
        order = sorted((round(sum((p - q) ** 2 for p, q in zip(x, y, strict=True)) ** 0.5, 9), t, m) for m, t, *y in rows if m != n)[:k]
        assert [got[n][i + 1][0] for i in range(len(order))] == [m for _, _, m in order] and len(got[n]) == len(order)
        assert all(abs(got[n][i + 1][1] - d) < 1e-8 * max(d, 1) for i, (d, _, _) in enumerate(order))


def test_only_cells_in_reach_are_visited(spark):
    rng = random.Random(1)
    rows = [(i, 0, rng.random() * 100, rng.random() * 100, 0.0) for i in range(3000)]
    points = table(spark, rows).select(F.array("a", "b", "c").alias("x"), F.lit(1).cast("long").alias("c"))
    tree, places = nearest.cells(points, 3, 16)
    sizes = [r["count"] for r in places.groupBy("cell").count().collect()]
    assert sum(sizes) == 3000 and max(sizes) <= 16 and tree.where("leaf").count() == len(sizes)
    queries = staged(nearest.bounds(tree, places, points.select("x"), 5), "queries")
    visits = nearest.in_reach(tree, queries).count()
    assert 3000 <= visits <= 3000 * 8 < 3000 * len(sizes) / 20


def test_rows_without_numbers(spark):
    rows = [(1, 0, 1.0, None, 0.0), (2, 0, float("nan"), 0.0, 0.0), (3, 0, float("inf"), 0.0, 0.0), (4, 0, 0.0, 0.0, 0.0), (5, 0, 1.0, 0.0, 0.0)]
    seeds = spark.createDataFrame([(i,) for i in (1, 2, 3, 4, 4, 99)], "seed long")
    got = nearest.nearest(table(spark, rows), seeds, ["a", "b", "c"], 2).collect()
    assert [tuple(r) for r in got] == [(4, 1, 5, 1.0)]
    assert nearest.nearest(table(spark, []), seeds, ["a", "b", "c"], 2).collect() == []
