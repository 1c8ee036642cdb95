import io
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from veilgraph.llm import token_table as T

PATH = public_tokenizers.path("word_bpe_49k.json")


def test_round_trip_and_lookup(spark, tmp_path):
    texts = ["", None, "One two  three", "<|endoftext|> a<|startoftext|>b", "É́ x ﬁ Σας \x1c!\x1c!  y　z İI", "long " * 50000, "it's 12,5\tI'll\r\n\nnow\x0b\x0cend", "é" * 3000, "same", "same"]
    rows = [(i * 7 - 11, t, "x") for i, t in enumerate(texts)] + [(4, "again", "x"), (4, "again", "x"), (None, "no id", "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, id string")
    shards = T.write_tables(df, f"file://{tmp_path}/out", PATH, shards=3)
    got = T.read_tables(spark, shards).orderBy("start").collect()
    tok = Tokenizer.from_file(PATH)
    want, at = [], 0
    for i, t, _ in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        ids = np.array(tok.encode(t or "", add_special_tokens=False).ids + [2], "<u4")
        want.append((i, at, len(ids), zlib.crc32(ids.tobytes())))
        at += len(ids)
    assert [tuple(r) for r in got] == want
    readers = [T.TableReader(s["path"]) for s in shards]
    for i, t, _ in rows:
        found = [x for r in readers for x in r.lookup(i)]
        assert len(found) == sum(r[0] == i for r in rows)
        assert list(found[0]) == tok.encode(t or "", add_special_tokens=False).ids + [2]
    assert not any(r.lookup(10**12) for r in readers)


def test_whole_documents_as_the_library_encodes_them(spark):
    texts = [r["text"] for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    tok = Tokenizer.from_file(PATH)
    assert [list(x) for x in T.encoder(PATH)(texts)] == [e.ids for e in tok.encode_batch(texts, add_special_tokens=False)]


def test_empty_table(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert T.token_tables(df, PATH).collect() == []


def test_order_and_wide_ids():
    out = io.BytesIO()
    w = T.TableWriter(out)
    w.add(T.key_of(-5), np.array([1, 70000], "<u4"))
    with pytest.raises(ValueError):
        w.add(T.key_of(-5), np.array([1], "<u4"))
    assert T.key_of(None) < T.key_of(-(2**63)) < T.key_of(-1) < T.key_of(0) < T.key_of(2**63 - 1)


def test_random_unicode_as_the_library_encodes_it():
    tok, rng = Tokenizer.from_file(PATH), np.random.default_rng(7)
    odd = [chr(c) for c in range(1, 0x3000) if chr(c).isalpha()] + list("İıſßẞΣςŉǰΐᾳﬁ\u0307\u0301") * 40
    texts = ["İ.", "KEDİ, VE", "GELDİ! EVET"]
    for _ in range(4000):
        word = lambda: "".join(rng.choice(odd, rng.integers(1, 5))) + "".join(rng.choice(list(".,;:!?"), rng.integers(0, 3)))
        texts.append(" ".join(word() for _ in range(rng.integers(1, 4))))
    assert [list(x) for x in T.encoder(PATH)(texts)] == [e.ids for e in tok.encode_batch(texts, add_special_tokens=False)]


def test_long_chunks_are_not_kept():
    encode = T.encoder(PATH)
    assert len(encode(["q" * 5000])[0]) and "q" * 5000 not in T._state["chunks"]
