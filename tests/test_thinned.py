from test_graphs import frame, random_edges

from veilgraph.operators import components
from veilgraph.plans.staging import staged


def test_steps_hold_few_rows_a_node(spark, monkeypatch):
    pairs = sorted({*random_edges(60, 900, 3), *[(x, x + 1) for x in range(100, 180)], *[(500 + x, 600 - x) for x in range(40)]})
    want = {tuple(r) for r in components.connected_components(frame(spark, pairs)).collect()}
    sizes, write = [], components.staged
    monkeypatch.setattr(components, "staged", lambda df, what: sizes.append(df.count()) or write(df, what))
    monkeypatch.setattr(components, "MANY", 100)
    edges = staged(frame(spark, [*pairs, *pairs[:9], (7, 7)]), "edges")
    got = components.connected_components(edges)
    assert {tuple(r) for r in got.collect()} == want and got.dtypes == [("node", "bigint"), ("component", "bigint")]
    assert max(sizes) <= 4 * 221 and sizes[0] < len(pairs)
