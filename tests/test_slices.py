import random

import pytest
from test_graphs import frame, random_edges

from veilgraph.operators import anonymise


@pytest.mark.parametrize("scores", ["many", "one", "odd"])
def test_edges_are_numbered_in_slices(spark, monkeypatch, scores):
    monkeypatch.setattr(anonymise, "ORDERED", 40)
    sizes, ranked = [], anonymise.ranked
    monkeypatch.setattr(anonymise, "ranked", lambda df, *a, **k: sizes.append(df.count()) or ranked(df, *a, **k))
    rng = random.Random(4)
    rows = [(u, v, {"many": rng.random(), "one": 0.5, "odd": rng.choice([None, 0.25, 0.5, 1.0])}[scores]) for u, v in random_edges(40, 150, 6)]
    got = [tuple(r) for r in anonymise.by_significance(spark.createDataFrame(rows, "u long, v long, x double"), "x", len(rows)).orderBy("rank").collect()]
    assert got == [(i + 1, *r) for i, r in enumerate(sorted(rows, key=lambda r: (r[2] is not None, r[2] or 0, r[0], r[1])))]
    assert sum(sizes) == len(rows) and (scores != "many" or max(sizes) < len(rows) // 2)
