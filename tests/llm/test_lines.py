import hashlib
import random
from collections import defaultdict

import duckdb
import pandas as pd
import pytest

from veilgraph.llm import lines
from veilgraph.llm.words import LOWER, UPPER

BLANKS = " \t\n\x0b\x0c\r"
SCHEMA = "doc_id long, text string, row string, n_lines int, h string"


def key(line):
    return line.strip(BLANKS).translate(str.maketrans(UPPER, LOWER))


def brute(docs, least, first=False):
    have, starts = defaultdict(set), {}
    for i, t, *_ in docs:
        for at, line in enumerate((t or "").split("\n")):
            have[key(line)].add((i, t or ""))
            place = (i is not None, i or 0, hashlib.md5(f"{'-' if i is None else i}|{t or ''}".encode()).digest(), at)
            starts[key(line)] = min(starts.get(key(line), place), place)
    out = []
    for i, t, *_ in docs:
        ls = (t or "").split("\n")
        gone = [a for a, x in enumerate(ls) if key(x) and len(have[key(x)]) >= least and not (first and starts[key(x)][:2] == (i is not None, i or 0) and starts[key(x)][3] == a)]
        kept = "\n".join(x for a, x in enumerate(ls) if a not in set(gone))
        out.append((i, len(ls), len(gone), kept))
    return sorted(out, key=str)


def corpus(n=120):
    rng = random.Random(5)
    pool = [f"Line {i}" for i in range(40)] + ["ÄÖ Übung", "äö Übung", "", " ", "\t", " x", "COMMON"]
    docs = []
    for i in range(n):
        ls = [rng.choice([" ", "", "\t"]) + rng.choice([str, str.upper, str.lower])(rng.choice(pool)) + rng.choice(["", "\r", "  "]) for _ in range(rng.randrange(0, 9))]
        docs.append((i, "\n".join(["common" * (i % 3 > 0), *ls]), "r", 1, "h"))
    docs += [(500, None, "", 0, ""), (501, "", "", 0, ""), (502, "\n\n", "", 0, ""), (503, "common\nLINE 1\n" * 4000, "", 0, ""), (5, docs[5][1], "", 9, ""), (5, docs[6][1], "", 0, ""), (None, docs[7][1], None, 0, "")]
    return docs


@pytest.mark.parametrize(("least", "first"), [(10, False), (1, False), (5, True)])
def test_against_brute_force(spark, least, first):
    docs = [(i, t, r, n, h) for i, t, r, n, h in corpus()]
    if first:  # ties of id are broken by row; here ids differ
        docs = docs[:-3]
    df = spark.createDataFrame(docs, SCHEMA)
    bitmaps = lines.keep_bitmaps(df, least, first)
    assert bitmaps.columns == ["row", "id", "n_lines", "n_dropped", "turns"] and bitmaps.count() == len({(i, t) for i, t, *_ in docs})
    out = lines.apply(df, bitmaps)
    assert out.columns == [*df.columns, "_n_lines", "n_dropped", "kept"]
    got = sorted([(r["doc_id"], r["_n_lines"], r["n_dropped"], r["kept"]) for r in out.collect()], key=str)
    assert got == brute(docs, least, first)
    for r in bitmaps.collect():
        t = r["turns"]
        assert len(t) % 2 == 0 and t == sorted(set(t)) and sum(t[1::2]) - sum(t[::2]) == r["n_dropped"]


def test_sql(spark):
    docs = corpus()
    con = duckdb.connect()
    con.register("documents", pd.DataFrame([d[:2] for d in docs], columns=["doc_id", "text"]).astype({"doc_id": "Int64"}))
    want = sorted([(None if pd.isna(i) else int(i), n, d, h) for i, n, d, h in con.sql(lines.sql()).df()[["doc_id", "n_lines", "n_dropped", "kept_sha256"]].itertuples(index=False)], key=str)
    assert want == sorted([(i, n, d, hashlib.sha256(k.encode()).hexdigest()) for i, n, d, k in brute(docs, 10)], key=str)


def test_nothing_and_everything(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert lines.keep_bitmaps(none).collect() == [] == lines.apply(none, lines.keep_bitmaps(none)).collect()
    same = spark.createDataFrame([(i, "a\nA \n", "", 0, "") for i in range(400)], SCHEMA)  # every line is of one hash
    out = lines.apply(same, lines.keep_bitmaps(same)).collect()
    assert len(out) == 400 and {(r["n_dropped"], r["kept"]) for r in out} == {(2, "")}
    stay = lines.apply(same, lines.keep_bitmaps(same, first=True)).where("kept <> ''").collect()
    assert [(r["doc_id"], r["n_dropped"], r["kept"]) for r in stay] == [(0, 1, "a\n")]
