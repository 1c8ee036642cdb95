import sys
import zlib
from pathlib import Path

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

sys.path.insert(0, str(Path(__file__).parents[2]))
import corpus_pipeline  # noqa: E402
from veilgraph.llm import decontaminate, mixing, simhash, toxicity  # noqa: E402

SF = "/root/testdata/sf0.001"


def test_stages_one_by_one(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = {r["doc_id"]: r for r in docs.collect()}
    stage = dict(corpus_pipeline.STAGES)
    assert list(stage) == [n for n, _ in corpus_pipeline.STAGES] and len(stage) == 5

    model = toxicity.fit(docs, spark.read.parquet(f"{SF}/labels.parquet"))
    clean = stage["toxicity"](spark, docs, SF)
    assert clean.columns == docs.columns
    ids = sorted(rows)
    scores = toxicity.score_texts(model, [rows[i]["text"] for i in ids])
    assert sorted(r["doc_id"] for r in clean.collect()) == [i for i, s in zip(ids, scores, strict=True) if s < 0.7]

    kept = stage["simhash near-dedup"](spark, docs, SF)
    left = {r["doc_id"] for r in kept.collect()}
    assert kept.columns == docs.columns and left < set(rows)
    by_text = {}
    for i in ids:
        by_text.setdefault(rows[i]["text"], []).append(i)
    assert all(len(left.intersection(same)) <= 1 for same in by_text.values())
    sets = {i: {hash(s) for s in zip(*(rows[i]["text"].lower().split()[k:] for k in range(5)), strict=False)} for i in ids}
    near = lambda i, least: any(j != i and len(sets[i] & sets[j]) >= least * max(1, len(sets[i] | sets[j])) for j in ids)
    assert all(near(i, 0.6) or len(sets[i]) < 3 for i in set(rows) - left)

    safe = stage["benchmark decontamination"](spark, docs, SF)
    index = decontaminate.build([(r["item_id"], r["text"]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()])
    assert sorted(r["doc_id"] for r in safe.collect()) == [i for i in ids if not decontaminate.leaks(rows[i]["text"], index)]

    mixed = stage["source mixing"](spark, docs, SF)
    assert mixed.columns == docs.columns and {r["doc_id"] for r in mixed.collect()} == set(rows)
    assert mixing and simhash


def test_run_is_the_stages_in_order(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for _, f in corpus_pipeline.STAGES[:-1]:
        docs = spark.createDataFrame(f(spark, docs, SF).collect(), docs.schema)
    tok, want = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json")), []
    for r in docs.collect():
        ids = np.array(tok.encode(r["text"], add_special_tokens=False).ids + [2], "<u4")
        want.append((r["doc_id"], len(ids), zlib.crc32(ids.tobytes())))
    got = corpus_pipeline.run(spark, SF).orderBy("start").collect()
    assert [(r["doc_id"], r["n_tokens"], r["ids_crc32"]) for r in got] == sorted(want)
