"""Toxicity by compression distance: how much shorter a toxic dictionary makes a text's windows.

Words and their stems become 8-byte codes, so that every word costs a compressor alike; a window is 24 codes. Two
zstandard dictionaries are made, one from toxic and one from ordinary training texts: each holds the words
common to both and, besides, the words that its own class has clearly more often. A window's gain is its
compressed length with the ordinary dictionary less that with the toxic one. The threshold on gains and the
logistic weights on a text's (log of windows over the threshold, largest gain) are fitted on training texts.
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass

import numpy as np
import pandas as pd
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WINDOW, LEVEL, BASE_WORDS = 24, 6, 256
STEMS = (4, 6)
#: Bounds of the training sample, in labelled documents of each class.
TOXIC_DOCS, ORDINARY_DOCS = 2000, 4000
MIN_RATIO, MIN_Z, MIN_SHARE = 20.0, 5.0, 0.012
_WORD = re.compile(r"\w+")
_made: dict = {}


@dataclass(frozen=True)
class Model:
    toxic: bytes
    ordinary: bytes
    threshold: int
    weights: tuple[float, float, float]  # constant, log(1 + windows over threshold), largest gain


def codes(text: str | None) -> bytes:
    """A code for each word and, after it, for its stems: its first STEMS letters, for each number of letters that it has."""
    digest, out = xxhash.xxh64_digest, []
    for w in _WORD.findall((text or "").lower()):
        out.append(digest(w))
        for n in STEMS:
            if len(w) >= n:
                out.append(digest(w[:n], n))
    return b"".join(out)


def _compressor(content: bytes) -> zstandard.ZstdCompressor:
    more = {}
    if len(content) >= 8:
        more["dict_data"] = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        more["dict_data"].precompute_compress(level=LEVEL)
    return zstandard.ZstdCompressor(level=LEVEL, write_content_size=False, write_checksum=False, write_dict_id=False, **more)


def features(data: bytes, toxic: zstandard.ZstdCompressor, ordinary: zstandard.ZstdCompressor) -> np.ndarray:
    """Gains of the windows of codes; the last one is whole too, by overlap or, in a short text, by repetition."""
    if not data:
        return np.zeros(0, np.int64)
    step, a, b = 8 * WINDOW, ordinary.compress, toxic.compress
    if len(data) < step:
        data = (data * WINDOW)[:step]
    starts = [*range(0, len(data) - step, step), len(data) - step]
    return np.array([len(a(w := data[i : i + step])) - len(b(w)) for i in starts], dtype=np.int64)


def _inputs(gains: list[np.ndarray], threshold: int) -> np.ndarray:
    return np.array([(1.0, math.log1p((g >= threshold).sum()), math.log1p(g[g >= threshold].sum())) for g in gains]).reshape(-1, 3)


def _distinct(texts: list[str]) -> list[bytes]:
    """Codes of the texts but near copies: a text goes if one of four least shingle hashes was met before."""
    seen, out = [set() for _ in range(4)], []
    for t in texts:
        w = codes(t)
        h = np.array([xxhash.xxh64_intdigest(w[i : i + 40]) for i in range(0, max(1, len(w) - 39), 8)], dtype=np.uint64)
        least = [int((h * np.uint64(m)).min()) for m in (1, 0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)]
        if not any(x in s for x, s in zip(least, seen, strict=True)):
            out.append(w)
        for x, s in zip(least, seen, strict=True):
            s.add(x)
    return out


def _document_counts(docs: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Codes, ascending, and in how many documents each occurs."""
    return np.unique(np.concatenate([np.unique(np.frombuffer(d, "<u8")) for d in docs]), return_counts=True)


def fit_texts(toxic: list[str], ordinary: list[str]) -> Model:
    """A model of the two classes; without texts of one, it scores every text by the other's base rate."""
    yes, no = _distinct(toxic), _distinct(ordinary)
    n, m = len(yes), len(no)
    if not n or not m:
        return Model(b"", b"", 1, (math.log((n + 0.5) / (m + 0.5)) if n + m else -4.0, 0.0, 0.0))
    found = [_document_counts(yes), _document_counts(no)]
    every = np.unique(np.concatenate([x for x, _ in found]))
    a, b = (np.zeros(len(every), np.int64) for _ in range(2))
    for into, (x, c) in zip((a, b), found, strict=True):
        into[np.searchsorted(every, x)] = c

    def own(x: np.ndarray, y: np.ndarray, n: int, m: int) -> np.ndarray:
        both = (x + y) / (n + m)
        z = (x / n - y / m) / np.sqrt(np.maximum(both * (1 - both), 1e-9) * (1 / n + 1 / m))
        clear = (x / n >= MIN_SHARE) & ((x + 0.5) / (n + 1) > MIN_RATIO * (y + 0.5) / (m + 1)) & (z > MIN_Z)
        return np.flatnonzero(clear)[np.argsort(z[clear], kind="stable")]

    mine, theirs = own(a, b, n, m), own(b, a, m, n)
    common = np.argsort(a + b, kind="stable")[-BASE_WORDS:]
    base = common[~np.isin(common, np.r_[mine, theirs])]
    dictionaries = tuple(np.r_[every[x], every[base]].astype("<u8").tobytes() for x in (mine, theirs))
    t, o = map(_compressor, dictionaries)
    gains = [features(w, t, o) for w in yes + no]
    y = np.r_[np.ones(n), np.zeros(m)]
    best = (-1.0, 1)
    for threshold in range(1, 25):
        hit = np.array([g.max(initial=0) >= threshold for g in gains])
        best = max(best, (2 * y[hit].sum() / (hit.sum() + n), -threshold))
    threshold = -best[1]
    x, weights = _inputs(gains, threshold), np.zeros(3)
    for _ in range(25):  # Newton's steps on the penalised likelihood
        p = 1 / (1 + np.exp(-np.clip(x @ weights, -30, 30)))
        h = (x * (p * (1 - p))[:, None]).T @ x + np.diag([1e-3, 0.1, 0.1])
        weights += np.linalg.solve(h, x.T @ (y - p) - np.array([1e-3, 0.1, 0.1]) * weights)
    return Model(*dictionaries, int(threshold), tuple(float(v) for v in weights))


def score_texts(model: Model, texts) -> np.ndarray:
    if _made.get("model") != model:
        _made.update(model=model, pair=(_compressor(model.toxic), _compressor(model.ordinary)))
    x = _inputs([features(codes(t), *_made["pair"]) for t in texts], model.threshold)
    return 1 / (1 + np.exp(-np.clip(x @ np.array(model.weights), -30, 30)))


def held_out(doc_id: Column) -> Column:
    """Whether crc32 of the identifier as text leaves 1 over 3; false for null."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> Model:
    """Learns from at most TOXIC_DOCS and ORDINARY_DOCS labelled rows outside the held-out third, in hash order.

    Null labels and texts are left out, and so are documents labelled both ways. Rows that share an identifier all
    teach; near copies teach once (see _distinct).
    """
    known = labels.where(~held_out(F.col("doc_id")) & F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").alias("_id")).agg(F.max("toxic").alias("_toxic"), F.min("toxic").alias("_least")).where("_toxic = _least")
    chosen = [known.where(F.col("_toxic") == c).orderBy(F.xxhash64("_id"), "_id").limit(n).select("_id", "_toxic") for c, n in ((1, TOXIC_DOCS), (0, ORDINARY_DOCS))]
    ids = F.broadcast(chosen[0].unionByName(chosen[1]))  # bounded by the two limits
    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")).where(F.col("_text").isNotNull()).join(ids, "_id")
    got = sorted(rows.select("_id", "_text", "_toxic").collect())
    return fit_texts([r[1] for r in got if r[2] == 1], [r[1] for r in got if r[2] == 0])


def score(docs: DataFrame, model: Model, text_col: str = "text", to: str = "score") -> DataFrame:
    """docs with a column `to`, in place of one of that name: the chance, 0 to 1, that a text is toxic.

    Null and empty texts have no window and get the chance that follows from the constant alone.
    """
    @F.pandas_udf("double")
    def of(texts: pd.Series) -> pd.Series:
        return pd.Series(score_texts(model, texts))

    return docs.withColumn(to, of(F.col(text_col)))
