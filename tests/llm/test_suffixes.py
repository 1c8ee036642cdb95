import hashlib
from collections import Counter

import numpy as np

from veilgraph.llm import suffixes as S


def brute(rows):
    """By counting every window of every text."""
    texts = [(t or "").encode() for _, t in rows]
    seen = Counter(t[i : i + S.WIDTH] for t in texts for i in range(len(t) - S.WIDTH + 1))
    out = []
    for (i, _), t in zip(rows, texts, strict=True):
        gone = np.zeros(len(t) + 1, bool)
        for p in range(len(t) - S.WIDTH + 1):
            if seen[t[p : p + S.WIDTH]] > 1:
                gone[p : p + S.WIDTH] = True
        kept = bytes(np.frombuffer(t, np.uint8)[~gone[:-1]])
        out.append((i, len(t), int(gone.sum()), int((np.diff(gone.astype(int), prepend=0) == 1).sum()), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def corpus(seed):
    rng = np.random.default_rng(seed)
    vocab = ["".join(rng.choice(list("abcdéfgh"), rng.integers(2, 8))) for _ in range(200)]

    def text(n):
        return " ".join(rng.choice(vocab, n))

    passage, base = text(60), [text(int(n)) for n in rng.integers(20, 300, 30)]
    rows = [(i, t) for i, t in enumerate(base)]
    for k in range(60):  # near copies, shared passages with other surroundings, repeats inside a text
        w = base[k % 7].split()
        for j in rng.integers(0, len(w), k % 5):
            w[j] = "zz"
        rows.append((100 + k, " ".join(w)))
        rows.append((200 + k, text(int(rng.integers(1, 40))) + passage[k % 9 :] + text(int(rng.integers(1, 40)))))
    rows += [(400, base[3] + " q " + base[3]), (401, None), (402, ""), (403, "x" * 199), (404, "x" * 200), (405, "y" * 700), (406, "ab" * 500), (407, base[5]), (407, base[5]), (None, base[6] + "!"), (408, "short"), (409, "short")]
    return rows


def run(spark, rows):
    df = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, id string")
    return sorted(map(tuple, S.remove_repeats(df).collect()), key=str)


def test_against_brute_force(spark, monkeypatch):
    rows = corpus(1)
    want = brute(rows)
    assert run(spark, rows) == want
    monkeypatch.setattr(S, "BUCKET_RUNS", 8)
    assert run(spark, rows) == want


def test_sorting_finds_equal_suffixes():
    rng = np.random.default_rng(2)
    for alphabet in (1, 2, 4):
        data = rng.integers(0, alphabet, 3000).astype(np.uint8)
        data[1000:1400] = data[100:500]
        data[2000:2230] = data[300:530]
        start = rng.choice(2700, 900, replace=False)
        group = rng.integers(0, 3, 900)
        n = Counter((g, data[s : s + S.WIDTH].tobytes()) for g, s in zip(group, start, strict=True))
        want = [n[g, data[s : s + S.WIDTH].tobytes()] > 1 for g, s in zip(group, start, strict=True)]
        assert S.equal_suffixes(data, start, group).tolist() == want


def test_empty_and_long(spark):
    assert run(spark, []) == []
    rng = np.random.default_rng(3)
    long = "".join(rng.choice(list("abcdefgh"), 100_000))
    assert run(spark, [(1, long), (2, long[500:900])]) == brute([(1, long), (2, long[500:900])])
