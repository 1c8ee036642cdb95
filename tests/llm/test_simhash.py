import numpy as np
import pandas as pd

from veilgraph.llm import simhash

SCHEMA = "doc_id long, text string, fp string, component string"


def brute(rows, words, bits):
    fps = [simhash.fingerprint(t, words) for _, t in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= bits:
                root[find(i)] = find(j)
    ids = {}
    for i in range(len(rows)):
        if rows[i][0] is not None:
            ids.setdefault(find(i), []).append(rows[i][0])
    return sorted(((rows[i][0], fps[i], min(ids[find(i)]) if find(i) in ids else None) for i in range(len(rows))), key=str)


def corpus():
    rng = np.random.default_rng(5)
    vocab = [f"w{i}" for i in range(300)]
    base = [" ".join(rng.choice(vocab, 400)) for _ in range(12)]
    rows = [(None, "lost id here"), (900, None), (901, ""), (902, " \t\n"), (903, "One"), (904, "one"), (905, "a b"), (906, "a  B"), (906, "a  B"), (907, "long " * 30000)]
    k = 0
    for b in base:
        for n in (0, 0, 1, 1, 2, 3, 5, 8):
            w = b.split()
            for _ in range(n):
                w[rng.integers(len(w))] = "x"
            rows.append((k := k + 1, " ".join(w)))
    return rows


def test_against_brute_force(spark):
    rows = corpus()
    df = spark.createDataFrame([(i, t, "clash", "clash") for i, t in rows], SCHEMA)
    for words in (3, 5):
        got = sorted(((r["id"], r["fp"] & (1 << 64) - 1, r["component"]) for r in simhash.simhash_groups(df, words=words).collect()), key=str)
        assert got == brute(rows, words, 2)


def test_every_pair_within_two_bits_meets():
    rng = np.random.default_rng(1)
    x = rng.integers(0, 2**63, 300)
    for flips in (0, 1, 2):
        y = x.copy()
        for i in range(len(y)):
            for b in rng.choice(64, flips, replace=False):
                y[i] ^= np.int64(-(2**63)) if b == 63 else np.int64(1 << int(b))
        rx, ax, hx = simhash.anchors(x, 2)
        ry, ay, _ = simhash.anchors(y, 2)
        home = dict(zip(rx[hx], ax[hx], strict=True))
        near = set(zip(ry, ay, strict=True))
        assert len(home) == len(x) and all((i, a) in near for i, a in home.items())


def test_matches_spark_hash(spark):
    r = spark.sql("select lpad(hex(xxhash64('one two three')), 16, '0') h").first()
    assert int(r["h"], 16) == simhash.fingerprint("One  two\nTHREE")


def test_empty_table(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert simhash.simhash_groups(df).collect() == []
    assert simhash.keep_one(df).columns == df.columns and simhash.keep_one(df).collect() == []


def test_forest_joins_chains():
    node, root = simhash._forest(np.array([1, 2, 3, 9]), np.array([2, 3, 4, 8]))
    assert pd.Series(root, node).to_dict() == {1: 1, 2: 1, 3: 1, 4: 1, 8: 8, 9: 8}


def jaccard(a, b, words=5):
    a, b = (set(zip(*(w[i:] for i in range(words)), strict=False)) for w in (a.split(), b.split()))
    return len(a & b) / max(1, len(a | b))


def test_keeps_one_of_near_copies(spark):
    rng = np.random.default_rng(8)
    vocab = [f"v{i}" for i in range(3000)]
    shared = " ".join(rng.choice(vocab, 70))
    rows, clean, k = [], set(), 0
    for b in range(40):
        w = list(rng.choice(vocab, int(rng.integers(60, 900))))
        rows.append((k := k + 1, " ".join(w)))
        clean.add(k)
        for _ in range(4):
            v = list(w)
            for _ in range(len(w) // 60):
                v[rng.integers(len(v))] = "edit"
            if jaccard(" ".join(v), " ".join(w)) >= 0.8:
                rows.append((k := k + 1, " ".join(v)))
        rows.append((k := k + 1, shared + " " + " ".join(rng.choice(vocab, 200)) + " " + shared[:200]))
        clean.add(k)
    rows += [(5000, ""), (5001, None), (5002, "lone word"), (None, "no id at all but some words here"), (5003, "no id at all but some words here"), (5004, "twice"), (5004, "twice")]
    df = spark.createDataFrame([(i, t, "x", "x") for i, t in rows], SCHEMA)
    out = simhash.keep_one(df)
    got = sorted(r["doc_id"] for r in out.collect())
    assert out.columns == df.columns and len(got) == len(set(got))
    assert clean <= set(got) and {5000, 5002, 5003, 5004} <= set(got) and 5001 not in got
    assert len(got) <= len(clean) + 4 + 0.03 * len(rows)


def survivors(rows, similarity=0.8):
    """Smallest identifiers of the groups that pairs of the similarity join, by comparing all pairs."""
    sets = []
    for _, t in rows:
        w = t.lower().split()
        sets.append(set(zip(*(w[i:] for i in range(5)), strict=False)) if len(w) >= 5 else {" ".join(w)})
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both >= similarity * (len(sets[i]) + len(sets[j]) - both):
                root[find(i)] = find(j)
    least = {}
    for i, (k, _) in enumerate(rows):
        least[find(i)] = min(k, least.get(find(i), k))
    return sorted(least.values())


def test_no_pair_of_the_similarity_is_lost(spark):
    rng = np.random.default_rng(3)
    vocab = [f"v{i}" for i in range(4000)]
    line = " ".join(rng.choice(vocab, 30))
    texts, edits = [], 0
    for size in (200, 300, 120):  # stars: copies near the original and not each other
        base = list(rng.choice(vocab, size))
        texts.append(" ".join(base))
        for _ in range(150):
            w = list(base)
            for i in rng.choice(np.arange(5, size, 10), size // 50, replace=False):
                w[i] = f"e{(edits := edits + 1)}"
            texts.append(" ".join(w))
    w = list(rng.choice(vocab, 250))
    for i in range(30):  # a chain: each near the next
        w[8 * i + 4] = f"c{i}"
        texts.append(" ".join(w))
    texts += [line + " " + " ".join(rng.choice(vocab, int(n))) for n in rng.integers(3, 60, 120)]
    short = list(rng.choice(vocab, 9))
    texts += [" ".join(short), " ".join(short[:8]), " ".join(short[:7])]
    rows = [(int(k), t) for k, t in zip(rng.permutation(len(texts)), texts, strict=True)]
    got = simhash.keep_one(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted(r["doc_id"] for r in got.collect()) == survivors(rows)


def test_repeated_lines_neither_link_nor_part(spark):
    rng = np.random.default_rng(4)
    vocab = [f"v{i}" for i in range(4000)]
    line, base = " ".join(rng.choice(vocab, 12)), " ".join(rng.choice(vocab, 150))
    rows = [(k, " ".join([line] * 60 + list(rng.choice(vocab, own)))) for own, ks in ((40, range(50)), (100, range(50, 100))) for k in ks]
    rows += [(100, f"{base} {line}"), (101, " ".join([base] + [line] * 20)), (102, " ".join([base] + [line] * 60))]
    got = simhash.keep_one(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted(r["doc_id"] for r in got.collect()) == survivors(rows) == list(range(101))


def test_simhash_proposes_what_is_compared(spark, monkeypatch):
    asked = []
    proposed = simhash._proposed
    monkeypatch.setattr(simhash, "_proposed", lambda heads, bits: asked.append(bits) or proposed(heads, bits))
    rng = np.random.default_rng(6)
    base = [f"v{i}" for i in rng.choice(4000, 900)]
    texts = [" ".join(base), " ".join([*base[:-1], "end"]), " ".join(f"u{i}" for i in rng.choice(4000, 900))]
    heads = spark.createDataFrame([(k, int(np.uint64(simhash._majority(simhash.shingle_set(t, 5))).view(np.int64))) for k, t in enumerate(texts)], "row long, fp long")
    assert [tuple(r) for r in proposed(heads, 2).collect()] == [(0, 1)]
    rows = list(enumerate(texts))
    got = simhash.keep_one(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted(r["doc_id"] for r in got.collect()) == survivors(rows) == [0, 2] and asked == [2]
