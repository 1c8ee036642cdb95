from test_graphs import frame

from veilgraph.operators import walks


def test_tries_double_until_a_step_is_kept(spark, monkeypatch):
    asked = []
    staged = walks.staged
    monkeypatch.setattr(walks, "staged", lambda df, what: asked.append(what) or staged(df, what))
    got = walks.random_walks(frame(spark, [(1, 2)]), 3, 4, p=40.0).collect()  # the only step back is kept once in 40 tries
    assert sorted(tuple(r["path"]) for r in got) == [(1, 2, 1)] * 4 + [(2, 1, 2)] * 4
    assert asked.count("left") <= 8
