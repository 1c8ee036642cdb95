import math
import random
import re
from collections import Counter

import duckdb
import numpy as np
import pandas as pd

from veilgraph.llm import lexical

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
DOCS, ITEMS = "doc_id long, text string, item string, n string", "item_id long, text string, doc_id string"


def terms(text):
    return TERM.findall("".join(c.lower() if c.isascii() else c for c in text or ""))


def brute(docs, items, k=10):
    bags = [(i, Counter(terms(t))) for i, t, *_ in docs]
    total, words = sum(1 for _, b in bags if b), sum(sum(b.values()) for _, b in bags)
    df, asked, out = Counter(w for _, b in bags for w in b), {}, []
    for i, t, *_ in items:
        asked.setdefault(i, set()).update(terms(t))
    for item, ws in asked.items():
        scores = []
        for d, b in bags:
            m = 100 - 90 + (90 * sum(b.values()) * total) // words if words else 0
            s = sum(math.floor(1000 * math.log((2 * total + 2) / (2 * df[w] + 1))) * ((1000000000 * b[w]) // (1000 * b[w] + 8 * m)) for w in ws if b[w])
            if s > 0:
                scores.append((-s, d is None, d or 0, d))
        out += [(item, r, d, -s) for r, (s, _, _, d) in enumerate(sorted(scores)[:k], 1)]
    return sorted(out, key=str)


def corpus(seed, n):
    rng = random.Random(seed)
    pool = [f"w{i}" for i in range(60)] + ["Ä", "straße", "数据", "x2", "ǅ"]
    weights = [1 / (i + 1) for i in range(len(pool))]
    docs = [(i, rng.choice([" ", ", ", "\n", "\x00-"]).join(rng.choices(pool, weights, k=rng.randrange(1, 60))), "x", "y") for i in range(n)]
    return docs, [(i, " ".join(rng.choices(pool, k=8)).upper().replace("SS", "ss"), "z") for i in range(25)]


def run(spark, docs, items, k=10, **more):
    got = lexical.search(spark.createDataFrame(docs, DOCS), spark.createDataFrame(items, ITEMS), k, **more)
    assert got.columns == ["item_id", "rank", "doc_id", "score"]
    return sorted([tuple(r) for r in got.collect()], key=str)


def test_against_brute_force(spark):
    docs, items = corpus(1, 300)
    docs += [(1000 + i, docs[i % 5][1], None, "") for i in range(40)] + [(7, docs[7][1], "", ""), (None, docs[3][1], "", ""), (2000, None, "", ""), (2001, "", "", ""), (2002, " .,-", "", ""), (2003, "w1 " * 30000, "", "")]
    items += [(100, None, ""), (101, "", ""), (102, "nowhere", ""), (103, "w0 w0 W0", ""), (1, "straße w59", ""), (None, "w3 数据", "")]
    want = brute(docs, items)
    assert run(spark, docs, items) == want
    assert run(spark, docs, items, block=60) == want
    assert run(spark, docs, items, 1) == brute(docs, items, 1)


def test_sql(spark):
    docs, items = corpus(2, 200)
    con = duckdb.connect()
    con.register("documents", pd.DataFrame([d[:2] for d in docs], columns=["doc_id", "text"]))
    con.register("benchmark", pd.DataFrame([i[:2] for i in items], columns=["item_id", "text"]))
    assert sorted(map(tuple, con.sql(lexical.sql()).df().astype(int).to_numpy().tolist()), key=str) == run(spark, docs, items) == brute(docs, items)


def test_nothing(spark):
    docs, items = corpus(3, 5)
    assert run(spark, [], items) == run(spark, docs, []) == run(spark, [], []) == run(spark, [(1, None, "", ""), (2, "--", "", "")], items) == []


def test_accumulators_stop_and_stay_exact():
    acc = lexical.Accumulators(docs=6, k=2, least=0)
    acc.add(np.array([0, 1, 2]), np.array([50, 40, 1]), rest=100)
    assert acc.growing and acc.kth() == 40
    acc.add(np.array([3]), np.array([40]), rest=40)  # a new one may still tie
    assert acc.growing and acc.scores[3] == 40
    acc.add(np.array([1, 2, 4, 5]), np.array([5, 5, 30, 39]), rest=39)
    assert not acc.growing and acc.scores.tolist() == [50, 45, 6, 40, 0, 0]
    held = lexical.Accumulators(docs=2, k=2, least=30)
    held.add(np.array([0]), np.array([29]), rest=29)
    assert not held.growing and held.scores.sum() == 0


def test_few_accumulators_for_items_that_few_documents_hold(monkeypatch):
    made = []
    real = lexical.Accumulators

    class Counted(real):
        def add(self, docs, gain, rest):
            super().add(docs, gain, rest)
            made.append(int((self.scores > 0).sum()))

    acc = Counted(docs=10_000, k=10, least=0)
    rare = np.arange(20)
    for _ in range(5):
        acc.add(rare, np.full(20, 1000), rest=9000)
    acc.add(np.arange(10_000), np.full(10_000, 3), rest=6)
    acc.add(np.arange(10_000), np.full(10_000, 3), rest=3)
    assert max(made) == 20 and acc.scores[:20].tolist() == [5006] * 20
