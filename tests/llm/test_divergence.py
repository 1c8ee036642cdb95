import random
import re
from collections import Counter, defaultdict

import duckdb
import pandas as pd
import pytest

from veilgraph.llm import divergence

TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
SCHEMA = "doc_id long, lang string, source string, text string, digest long, word string, tf int"


def brute(docs, least=3, ranks=200):
    df, tf, groups = defaultdict(Counter), defaultdict(Counter), set()
    for _, lang, source, text, *_ in docs:
        lang, source = lang or "", source or ""
        ws = TERM.findall("".join(c.lower() if c.isascii() else c for c in text or ""))
        groups.add((lang, source))
        df[lang].update(set(ws))
        tf[lang, source].update(ws)
    out = []
    for lang in {g[0] for g in groups}:
        kept = [w for w, c in df[lang].items() if c >= least]
        own = {s: Counter({w: tf[lang, s][w] for w in kept if tf[lang, s][w]}) for x, s in groups if x == lang}
        whole = sum(own.values(), Counter())
        p = lambda c, w: 1 + (1000000000 * (c[w] + 1)) // (sum(c.values()) + len(kept))  # noqa: B023, E731
        f = lambda a, b: (a - b) * (a - b) // b
        for s, c in own.items():
            pairs = [(-sum(f(p(c, w), p(o, w)) for w in kept), h) for h, o in own.items() if h != s]
            words = [(-f(p(c, w), p(whole, w)), w.encode()) for w in kept if c[w] and p(c, w) > p(whole, w)]
            out += [(lang, s, "pair", h, -v, r) for r, (v, h) in enumerate(sorted(pairs), 1)]
            out += [(lang, s, "term", w.decode(), -v, r) for r, (v, w) in enumerate(sorted(words)[:ranks], 1)]
    return sorted(out)


def corpus(n=200):
    rng = random.Random(4)
    pool = [f"{a}{b}" for a in "abcdefghij" for b in "klmnopqrst"] + ["Ä", "ä", "straße", "\U0001f600x", "数据"]
    docs = []
    for i in range(n):
        lang = rng.choice(["en", "de", None, ""])
        part = rng.sample(pool, 30)
        docs.append((i, lang, rng.choice(["web", "web", "web", "news", "", None, "wiki"]), rng.choice([" ", "1", "\n", "\x00"]).join(rng.choices(part, k=rng.randrange(0, 80))).title(), 1, "w", 2))
    docs += [(i, "fr", s, None, 0, "", 0) for i, s in enumerate(["x", "y", "z", "x"])] + [(9, "it", "only", "uno uno", 0, "", 0), (9, "de", "mute", " 12 ", 0, "", 0), docs[3], docs[3], (10, "en", "long", "zebra " * 40000, 0, "", 0)]
    return docs


@pytest.mark.parametrize(("bits", "ranks", "held"), [(64, 200, 200_000), (4, 5, 50)])
def test_against_brute_force(spark, monkeypatch, bits, ranks, held):
    monkeypatch.setattr(divergence, "HELD", held)
    docs = corpus()
    got = divergence.audit(spark.createDataFrame(docs, SCHEMA), ranks=ranks, bits=bits)
    assert got.columns == ["lang", "source", "part", "item", "value", "rank"]
    assert sorted(tuple(r) for r in got.collect()) == brute(docs, ranks=ranks)


def test_sql():
    docs = corpus()
    con = duckdb.connect()
    con.register("documents", pd.DataFrame([d[1:4] for d in docs], columns=["lang", "source", "text"]))
    assert sorted(con.sql(divergence.sql()).fetchall()) == brute(docs)


def test_nothing(spark):
    assert divergence.audit(spark.createDataFrame([], SCHEMA)).collect() == []
    same = [(i, "en", s, "a a b", 0, "", 0) for i, s in enumerate("ppqq")]
    assert sorted(tuple(r) for r in divergence.audit(spark.createDataFrame(same, SCHEMA)).collect()) == brute(same)


def test_shares_of_counts_beyond_64_bits(spark):
    n = 3 * 10**12
    row = spark.range(1).selectExpr(f"{n}L AS c", f"{7 * 10**14}L AS w", "1000000L AS k")
    got = row.select(divergence.share(row.c, row.w, row.k)).first()[0]
    assert got == 1 + 10**9 * (n + 1) // (7 * 10**14 + 10**6)
