import tracemalloc

import numpy as np

from veilgraph.llm import decontaminate as D


def words(rng, n):
    return " ".join("".join(rng.choice(list("abcdefghijklmnop"), rng.integers(2, 9))) for _ in range(n))


def edited(rng, text, n):
    t = list(text)
    for i in sorted(rng.choice(np.arange(len(t)), n, replace=False))[::-1]:
        k = rng.integers(3)
        if k == 0:
            t[i] = "z"
        elif k == 1:
            t.insert(i, "z")
        else:
            del t[i]
    return "".join(t)


def align(x, item):
    """Whether n item characters align with a part of x in budget: the whole table, for each start in the item."""
    n = min(D.STRETCH, len(item))
    budget = min(D.EDITS * n // D.STRETCH, n // D.Q - 1)
    starts = len(item) - n + 1
    cost = np.zeros((starts, len(x) + 1), np.int32)
    rows = np.array([[ord(c) for c in item[s : s + n]] for s in range(starts)])
    text, ramp = np.array([ord(c) for c in x]), np.arange(len(x) + 1, dtype=np.int32)
    for i in range(n):
        step = np.full_like(cost, 1 << 20)
        step[:, 1:] = cost[:, :-1] + (text[None, :] != rows[:, i : i + 1])
        cost = np.minimum.accumulate(np.minimum(step, cost + 1) - ramp, axis=1) + ramp
    return bool((cost.min(axis=1) <= budget).any())


def brute(text, rows):
    """Items that leak, found without q-gram counts."""
    index = D.build(rows)
    x = D.normalise(text)[0].astype("<u4").tobytes().decode("utf-32-le")
    return {i for i, item in zip(index.ids, index.items, strict=True) if align(x, item)}


def test_planted_and_clean():
    rng = np.random.default_rng(3)
    items = [(str(i), words(rng, 40)) for i in range(8)] + [("short", words(rng, 6)), ("none", None), ("tiny", "xyz")]
    index = D.build(items)
    for k in range(40):
        i, edits = rng.integers(8), int(rng.integers(0, 5))
        piece = items[i][1][20 : 20 + int(rng.integers(100, 140))]
        text = words(rng, 30) + ". " + edited(rng, piece.upper() if k % 2 else piece.replace(" ", ",\n"), edits) + " " + words(rng, 30)
        got = D.leaks(text, index)
        assert [h[0] for h in got] == [str(i)]
        s, e = got[0][1:3]
        assert 75 <= e - s and got[0][3] <= D.EDITS
        assert k > 7 or {h[0] for h in got} == brute(text, items)
        clean = words(rng, 60) + items[i][1][:60] + words(rng, 20)
        assert D.leaks(clean, index) == [] and (k > 3 or brute(clean, items) == set())
    assert [h[0] for h in D.leaks("x " + items[8][1] + " y", index)] == ["short"]


def test_short_items():
    rng = np.random.default_rng(8)
    for n in (12, 17, 23, 24, 33, 35, 36, 47, 60, 79):
        item = (words(rng, 30)[: n - 1] + "q")[:n]
        index, budget = D.build([("i", item)]), min(D.EDITS * n // D.STRETCH, n // D.Q - 1)
        for edits in range(budget + 3):
            for _ in range(12):
                text = words(rng, 12) + " " + edited(rng, item, edits) + " " + words(rng, 12)
                assert {h[0] for h in D.leaks(text, index)} == brute(text, [("i", item)])
    index = D.build([("a", "to be"), ("b", "Be?"), ("c", "..."), ("d", "to be or no"), ("e", "to be")])
    got = {h[0]: h[1:] for h in D.leaks("So: TO  be, it", index)}
    assert got == {"a": (4, 10, 0), "e": (4, 10, 0), "b": (8, 10, 0)}
    assert D.leaks("tobe", index) == [] and D.leaks("", index) == []


def test_repeats_stay_small():
    index = D.build([("a", "a" * 3000), ("b", "ab" * 1500 + "x")])
    assert {h[0] for h in D.leaks("a" * 20000, index)} == {"a"}
    assert {h[0] for h in D.leaks("ba" * 9000, index)} == {"b"}
    assert D.leaks(("a" * 40 + " zq ") * 300, D.build([("c", "a" * 30 + "y" * 60)])) == []


def test_repeats_of_long_items_stay_small():
    for item, text in ((20_000, 20_000), (100_000, 2_000), (20_000, 60)):
        index = D.build([("a", "a" * item)])
        tracemalloc.start()
        got = {h[0] for h in D.leaks("a" * text + " zq" * 3, index)}
        peak = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        assert got == ({"a"} if text >= 75 else set()) and peak < 200 << 20


def test_parts_of_items_find_what_one_part_finds(monkeypatch):
    rng = np.random.default_rng(10)
    for _ in range(12):
        period = ["ab", "abc def ", "xyzzyq "][rng.integers(3)]
        items = [("r", (period * 200)[: int(rng.integers(200, 400))]), ("m", words(rng, 20) + " " + period * 12 + words(rng, 20)), ("w", words(rng, 40))]
        text = words(rng, 10) + " " + period * int(rng.integers(4, 20)) + " " + edited(rng, items[int(rng.integers(1, 3))][1], int(rng.integers(0, 12))) + " " + words(rng, 10)
        index = D.build(items)
        one = {h[0] for h in D.leaks(text, index)}
        assert one == brute(text, items)
        for pairs in (10, 2000):
            with monkeypatch.context() as m:
                m.setattr(D, "PAIRS", pairs)
                assert {h[0] for h in D.leaks(text, index)} == one


def test_parts_find_what_one_part_finds(monkeypatch):
    rng = np.random.default_rng(9)
    items = [(str(i), words(rng, 40)) for i in range(3)]
    index = D.build(items)
    text = " ".join(words(rng, 20) + " " + items[i % 3][1] for i in range(6))
    one = {h[0] for h in D.leaks(text, index)}
    monkeypatch.setattr(D, "PAIRS", 10)
    assert {h[0] for h in D.leaks(text, index)} == one == {"0", "1", "2"}


def test_table(spark):
    rng = np.random.default_rng(4)
    items = [(i, words(rng, 30), "x") for i in range(3)] + [(9, None, "x"), (None, words(rng, 30), "x")]
    bench = spark.createDataFrame(items, "item_id long, text string, doc_id string")
    long_text = words(rng, 3000)
    rows = [(1, items[0][1], "x"), (1, items[0][1], "x"), (2, None, "x"), (3, "", "x"), (None, items[1][1], "x"), (4, long_text + items[2][1] + long_text, "x"), (5, long_text, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, item_id string")
    got = sorted(((r["doc_id"], r["item_id"]) for r in D.find_leaks(docs, bench).collect()), key=str)
    assert got == [(1, "0"), (1, "0"), (4, "2"), (None, "1")]
    kept = D.drop_leaking(docs, bench)
    assert kept.columns == docs.columns and sorted(r["doc_id"] for r in kept.collect()) == [2, 3, 5]
    assert D.find_leaks(docs.limit(0), bench).collect() == [] and D.find_leaks(docs, bench.limit(0)).collect() == []


def test_blocks_give_what_one_index_gives(spark, monkeypatch):
    docs, bench = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "benchmark"))
    one = sorted(map(tuple, D.find_leaks(docs, bench).collect()))
    monkeypatch.setattr(D, "BLOCK_CHARS", 3000)
    assert sorted(map(tuple, D.find_leaks(docs, bench).collect())) == one != []
