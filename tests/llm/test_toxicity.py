import zlib

import numpy as np

from veilgraph.llm import toxicity as T


def texts(n, bad, seed):
    rng = np.random.default_rng(seed)
    words = [f"w{i}" for i in range(400)]
    out = []
    for _ in range(n):
        w = list(rng.choice(words, rng.integers(30, 300)))
        for _ in range(bad):
            w.insert(rng.integers(len(w)), str(rng.choice(["vile", "awful", "nasty", "rotten"])))
        out.append(" ".join(w))
    return out


def test_learns_words_of_one_class():
    model = T.fit_texts(texts(150, 3, 1), texts(400, 0, 2))
    yes, no = T.score_texts(model, texts(100, 3, 3)), T.score_texts(model, [*texts(100, 0, 4), "", None, "!?"])
    assert (yes >= 0.7).mean() > 0.95 and (no < 0.7).mean() > 0.98
    assert ((yes >= 0) & (yes <= 1)).all()


def test_one_class_only():
    assert (T.score_texts(T.fit_texts([], ["a b"]), ["a", None]) < 0.5).all()
    assert (T.score_texts(T.fit_texts([], []), ["a", None]) < 0.5).all()


def test_fold_and_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    model = T.fit(docs, labels)
    rows = T.score(docs, model).join(labels, "doc_id").select("doc_id", "score", "toxic", T.held_out(docs["doc_id"]).alias("h")).collect()
    assert all(r["h"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) for r in rows)
    test = [r for r in rows if r["h"]]
    caught = [r for r in test if r["score"] >= 0.7]
    assert sum(r["toxic"] for r in caught) >= 0.8 * sum(r["toxic"] for r in test)
    assert sum(r["toxic"] for r in caught) >= 0.95 * len(caught)


def test_edges(spark):
    docs = spark.createDataFrame([(None, None, "x"), (1, "", "x"), (1, "", "x"), (2, "word " * 100000, "x")], "doc_id long, text string, _text string")
    labels = spark.createDataFrame([(1, 1), (2, None), (None, 0), (9, 0)], "doc_id long, toxic int")
    rows = T.score(docs, T.fit(docs, labels)).collect()
    assert len(rows) == 4 and all(0 <= r["score"] <= 1 for r in rows)
    assert T.score(docs.limit(0), T.fit(docs.limit(0), labels.limit(0))).collect() == []
