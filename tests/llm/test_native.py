import random

import duckdb
import pandas as pd
import pytest

from veilgraph.llm import licences, mixing

DOCS = [
    (1, "All rights reserved.\nx y z", "a"), (1, "ALL  rights -- reserved", "a"), (2, None, "a"), (3, "", "b"), (None, "Released under the MIT License.\nreleased under the mit license", "b"),
    (4, "This work is licensed under the GNU General Public License, version 3.\nThis work is licensed under the GNU General Public License, version 3 or later.", None),
    (5, "word " * 60000, "b"), (6, "one", None), (7, "licensed under the Apache License Version 2.0 now\n\n \n", "c"), (8, "a b c d", "d"), (8, "a b c d", "d"), (9, " \n", "e"),
]


def duck(sql, docs):
    con = duckdb.connect()
    con.register("documents", docs)
    return con.sql(sql).df()


def plain(v):
    if pd.isna(v):
        return None
    v = v.item() if hasattr(v, "item") else v
    return int(v) if isinstance(v, float) and v.is_integer() else v


def rows(df):
    return sorted([tuple(map(plain, r)) for r in df.itertuples(index=False)], key=str)


def test_scan(spark):
    pdf = pd.DataFrame(DOCS, columns=["doc_id", "text", "source"]).astype({"doc_id": "Int64"})
    docs = spark.createDataFrame([(*d, "x") for d in DOCS], "doc_id long, text string, source string, licence string")
    got = licences.scan(docs, licences.templates(spark)).toPandas().rename(columns={"id": "doc_id"})
    assert rows(got) == rows(duck(licences.sql(), pdf))
    found = {(i, k): x for i, k, *x in rows(got)}
    assert found[1, "all-rights-reserved"] == [1, 0, 3] and found[None, "MIT"] == [1, 0, 5] and found[4, "GPL-3.0"] == [1, 0, 12] and (7, "Apache-2.0") in found
    assert licences.scan(docs.limit(0), licences.templates(spark)).collect() == []
    assert licences.scan(docs, licences.templates(spark).limit(0)).collect() == []


def test_scan_finds_wrapped_edited_and_embedded_texts(spark):
    rng, texts = random.Random(3), dict(licences.TEXTS)
    rows, want = [], {}
    for i in range(60):
        name = rng.choice(list(texts))
        words = texts[name].split()
        for _ in range(rng.randrange(3)):
            words[rng.randrange(len(words))] = rng.choice(["", "changed", "two words"])
        lines = "".join(w + rng.choice([" ", "\n", "\n * "]) for w in words)
        rows.append((i, " ".join(rng.choice(["the", "of", "software", "x"]) for _ in range(50)) + ". " + lines + "Copyright 2020 X. All rights reserved. " + "of the " * 30))
        want[i] = name
    rows += [(100, "all rights are reserved"), (101, " ".join(texts["MIT"].split()[:25])), (102, "all rights reserved " * 300)]
    pdf = pd.DataFrame(rows, columns=["doc_id", "text"]).astype({"doc_id": "Int64"})
    got = licences.scan(spark.createDataFrame(rows, "doc_id long, text string"), licences.templates(spark)).toPandas().rename(columns={"id": "doc_id"})
    assert globals()["rows"](got) == globals()["rows"](duck(licences.sql(), pdf))
    found = set(zip(got["doc_id"], got["licence"], strict=True))
    assert all((i, n) in found and (i, "all-rights-reserved") in found for i, n in want.items())
    assert not [x for x in found if x[0] in (100, 101)] and (102, "all-rights-reserved") in found


@pytest.mark.parametrize(("entropy", "repeats", "whole"), [(0.95, 4.0, False), (1.0, 2.0, False), (0.2, 4.0, True), (0.99, 1000.0, True)])
def test_mix(spark, entropy, repeats, whole):
    many = DOCS + [(100 + i, "t " * (1 + i % 13), "big") for i in range(900)] + [(2000 + i, "t t t", f"s{i % 3}") for i in range(60)]
    pdf = pd.DataFrame(many, columns=["doc_id", "text", "source"]).astype({"doc_id": "Int64"})
    docs = spark.createDataFrame([(*d, "x") for d in many], "doc_id long, text string, source string, s string")
    out = mixing.mix(docs, entropy, repeats, whole=whole)
    assert out.columns == [*docs.columns, "_epoch"]
    got = out.select("doc_id", "source", "_epoch").toPandas()
    assert rows(got) == rows(duck(mixing.sql(entropy=entropy, repeats=repeats, whole=whole), pdf))
    assert set(got["_epoch"]) and (whole or got["_epoch"].max() <= repeats + 1)
    assert not whole or set(got["doc_id"].dropna()) == set(pdf["doc_id"].dropna())


def test_mix_nothing(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, source string")
    assert mixing.mix(docs).collect() == []
    one = spark.createDataFrame([(1, "a", "x", 5, "y", 7), (2, "b c", "x", None, None, None)], "doc_id long, text string, source string, _epoch int, _row string, _f int")
    rows = mixing.mix(one).collect()
    assert sorted(r["doc_id"] for r in rows) == [1, 2] and {r["_epoch"] for r in rows} == {5, None} and {r["__epoch"] for r in rows} == {0}
