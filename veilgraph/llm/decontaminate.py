"""Benchmark decontamination by the q-gram lemma.

Texts are normalised to lower-case letters and digits with single blanks. A stretch of STRETCH item characters
that a document repeats with at most EDITS edits shares at least STRETCH + 1 - Q * (EDITS + 1) q-grams with it,
all on diagonals at most EDITS apart. So shared q-grams are counted in bands of diagonals that overlap by
EDITS; where a band holds that many within one stretch, each of its runs of q-grams is extended either way by a
banded alignment of up to EDITS edits, and the item leaks if a run and its extensions make a stretch within the
budget. A stretch in budget holds a whole run, so none is missed. Items shorter than a stretch must leak whole, with
EDITS in proportion to their length, but never more edits than leave a shared q-gram; items shorter than a q-gram must
stand in the document word for word.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilgraph.llm.batches import slices

Q, STRETCH, EDITS = 12, 80, 5
#: Benchmark characters that a task holds at once; a larger benchmark is searched block by block.
BLOCK_CHARS = 4_000_000
#: Pairs of equal q-grams that are looked at together, and places by which such parts of a document overlap.
PAIRS, OVERLAP = 500_000, STRETCH + 2 * EDITS
_FILTER_BITS = 22
_tables: list[np.ndarray] = []


def _char_tables() -> list[np.ndarray]:
    if not _tables:
        chars = [chr(i) for i in range(1 << 16)]
        lower = np.array([ord(c.lower()) if len(c.lower()) == 1 else ord(c) for c in chars], dtype=np.uint32)
        _tables.extend((lower, np.array([c.isalnum() for c in chars])))
    return _tables


def normalise(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Code points of the normalised text and where each stands in the text."""
    lower, alnum = _char_tables()
    x = np.frombuffer((text or "").encode("utf-32-le", "replace"), dtype="<u4")
    near = np.minimum(x, 0xFFFF)
    word = alnum[near] | (x > 0xFFFF)
    keep = word.copy()
    keep[1:] |= word[:-1]
    at = np.flatnonzero(keep)
    return np.where(word[at], np.where(x[at] > 0xFFFF, x[at], lower[near[at]]), 32).astype(np.uint64), at


def qgrams(x: np.ndarray) -> np.ndarray:
    """A hash of the Q = 12 points from each place on."""
    if len(x) < Q:
        return np.zeros(0, np.uint64)
    h = (x + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    h ^= h >> np.uint64(29)
    for n in (1, 2):
        h = h[:-n] * np.uint64(0xBF58476D1CE4E5B9 if n == 1 else 0x94D049BB133111EB) + h[n:]
    four = h
    eight = four[:-4] * np.uint64(0xD6E8FEB86659FD93) + four[4:]
    h = eight[:-4] * np.uint64(0xFF51AFD7ED558CCD) + four[8:]
    return h ^ h >> np.uint64(32)


@dataclass
class Index:
    """The q-grams of a block of items, sorted, with the item and place of each, and the place in all items one after
    another, which ascends among equal q-grams; words are the items without one."""

    ids: list
    items: list[str]
    words: dict[int, dict[str, list]]
    stretch: np.ndarray
    budget: np.ndarray
    hashes: np.ndarray
    owner: np.ndarray
    place: np.ndarray
    whole: np.ndarray
    filter: np.ndarray


def points(x: np.ndarray) -> str:
    return x.astype("<u4").tobytes().decode("utf-32-le", "replace")


def build(rows: list[tuple]) -> Index:
    """Of (id, text) rows; items without a letter or digit are left out."""
    ids, items, words = [], [], {}
    for i, t in rows:
        x, _ = normalise(t)
        x = x[:-1] if len(x) and x[-1] == 32 else x
        if len(x) >= Q:
            ids.append(i)
            items.append(x)
        elif len(x):
            w = points(x)
            words.setdefault(w.count(" ") + 1, {}).setdefault(w, []).append(i)
    grams = [qgrams(x) for x in items]
    h = np.concatenate(grams) if grams else np.zeros(0, np.uint64)
    owner = np.repeat(np.arange(len(items)), [len(g) for g in grams])
    place = np.concatenate([np.arange(len(g)) for g in grams]) if grams else np.zeros(0, np.int64)
    order = np.argsort(h, kind="stable")
    seen = np.zeros(1 << _FILTER_BITS, dtype=bool)
    seen[h >> np.uint64(64 - _FILTER_BITS)] = True
    stretch = np.minimum(STRETCH, np.array([len(x) for x in items], dtype=np.int64))
    budget = np.minimum(EDITS * stretch // STRETCH, stretch // Q - 1)
    return Index(ids, [points(x) for x in items], words, stretch, budget, h[order], owner[order], place[order], order, seen)


def reach(a: str, b: str, budget: int) -> list[tuple[int, int]]:
    """For 0, 1, .. budget edits, how far (characters of a, of b) an alignment of their beginnings gets.

    The furthest place on each diagonal of the band, edit by edit; equal characters are always taken.
    """

    def slide(i: int, j: int) -> int:
        while i < len(a) and j < len(b) and a[i] == b[j]:
            i, j = i + 1, j + 1
        return i

    front = {0: slide(0, 0)}
    out = [(front[0], front[0])]
    for e in range(1, budget + 1):
        new = {}
        for k in range(-e, e + 1):
            i = max(front.get(k, -2) + 1, front.get(k + 1, -2) + 1, front.get(k - 1, -2))
            i = min(i, len(a), len(b) - k)
            if i >= 0 and i + k >= 0:
                new[k] = slide(i, i + k)
        front = new
        out.append(max(((i, i + k) for k, i in front.items()), default=out[-1]))
    return out


@functools.lru_cache(maxsize=4096)
def _extended(item_left: str, left: str, item_right: str, right: str, length: int, n: int, budget: int) -> tuple[int, int, int] | None:
    """(characters to the left, to the right, edits) by which a run grows to n item characters in budget; texts on the left
    are turned around. Repeats ask the same again and again, so answers are kept."""
    before, after = reach(item_left, left, budget), reach(item_right, right, budget)
    for edits in range(budget + 1):
        for e in range(edits + 1):
            if before[e][0] + length + after[edits - e][0] >= n:
                return before[e][1], after[edits - e][1], edits
    return None


def verify(x: str, item: str, p: int, o: int, length: int, n: int, budget: int) -> tuple[int, int, int] | None:
    """(start, end, edits) in x if a stretch of n item characters in budget holds item[o : o + length] at p."""
    grown = _extended(item[max(0, o - n) : o][::-1], x[max(0, p - n - budget) : p][::-1], item[o + length : o + length + n], x[p + length : p + length + n + budget], length, n, budget)
    return grown and (p - grown[0], p + length + grown[1], grown[2])


def short_leaks(x: np.ndarray, where: np.ndarray, index: Index) -> list[tuple]:
    """As leaks(), for the items that are shorter than a q-gram: their first whole-word occurrence."""
    text = points(x)
    ends = [i for i, c in enumerate(text) if c == " "] + [len(text)]
    starts = [0] + [e + 1 for e in ends[:-1]]
    found: dict = {}
    for n, items in index.words.items():
        for i in range(len(starts) - n + 1):
            s, e = starts[i], ends[i + n - 1]
            if e - s < Q and e > s:
                for item in items.get(text[s:e], ()):
                    found.setdefault(item, (item, int(where[s]), int(where[e - 1]) + 1, 0))
    return list(found.values())


def _parts(n: np.ndarray, p: np.ndarray) -> Iterator[tuple[int, int]]:
    """Ranges of the ascending places p, each with n pairs: of about PAIRS pairs, but at least twice OVERLAP places wide, by
    which they overlap."""
    total, s = np.cumsum(n), 0
    while True:
        e = max(s + 1, int(np.searchsorted(total, (total[s - 1] if s else 0) + PAIRS, "right")))
        e = max(e, int(np.searchsorted(p, p[s] + 2 * OVERLAP)))
        yield s, min(e, len(p))
        if e >= len(p):
            return
        s = int(np.searchsorted(p, p[e] - OVERLAP))


def _cells(p: np.ndarray, a: np.ndarray, n: np.ndarray, index: Index, done: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(p, a, n) of one part of a document, dealt into parts of the items if it has more than PAIRS pairs.

    Parts overlap on both sides, so a stretch lies in one of them whole; what items found before would add is left out.
    """
    if n.sum() <= PAIRS:
        yield p, a, n
        return
    first, at, times = np.unique(a, return_inverse=True, return_counts=True)
    sizes = np.zeros(len(first), np.int64)
    sizes[at] = n
    gram = np.repeat(np.arange(len(first)), sizes)
    entry = np.repeat(first - np.cumsum(sizes) + sizes, sizes) + np.arange(len(gram))
    key = gram * (len(index.hashes) + 1) + index.whole[entry]  # ascends
    left = ~done[index.owner[entry]]
    order = np.argsort(index.whole[entry[left]], kind="stable")
    whole, pairs = index.whole[entry[left]][order], times[gram[left]][order]
    base = np.cumsum(sizes) - sizes
    for s, e in _parts(pairs, whole) if len(whole) else ():
        low, high = (np.searchsorted(key, np.arange(len(first)) * (len(index.hashes) + 1) + w) for w in (whole[s], whole[e - 1] + 1))
        some = (high > low)[at]
        if some.any():
            yield p[some], (first + low - base)[at][some], (high - low)[at][some]


def leaks(text: str | None, index: Index, one: bool = False) -> list[tuple]:
    """(item id, start, end, edits) of each item that the text leaks, at its first region found; if `one`, of one item.

    Documents go part by part, and a part that repeats much of the items goes part by part of these, so that repeats in
    text and item cost bounded memory; an item that was found in a part is not looked for in those after it.
    """
    x, where = normalise(text)
    found = short_leaks(x, where, index) if index.words and len(x) else []
    if not len(index.hashes) or (one and found):
        return found
    h = qgrams(x)
    p = np.flatnonzero(index.filter[h >> np.uint64(64 - _FILTER_BITS)])
    if not len(p):
        return found
    a, b = (np.searchsorted(index.hashes, h[p], side) for side in ("left", "right"))
    some = b > a
    p, a, n = p[some], a[some], (b - a)[some]
    if not len(p):
        return found
    string, done = points(x), np.zeros(len(index.ids), bool)
    for s, e in _parts(n, p):
        for cell in _cells(p[s:e], a[s:e], n[s:e], index, done):
            for o, hit in _part_leaks(string, *cell, index, done):
                done[o] = True
                found.append((index.ids[o], int(where[hit[0]]), int(where[hit[1] - 1]) + 1, hit[2]))
                if one:
                    return found
    return found


def _part_leaks(text: str, p: np.ndarray, a: np.ndarray, n: np.ndarray, index: Index, done: np.ndarray) -> Iterator[tuple]:
    """(item, (start, end, edits)) of the items not yet done that leak where places p share n q-grams from a on."""
    p = np.repeat(p, n)
    k = np.repeat(a - np.cumsum(n) + n, n) + np.arange(len(p))
    owner, place = index.owner[k], index.place[k]
    left = ~done[owner]
    owner, place, p = owner[left], place[left], p[left]
    wide = 4 * EDITS
    band = (p - place) // wide
    second = p - place - band * wide < EDITS  # also the top of the band below, which reaches EDITS up
    owner, p, band, place = np.r_[owner, owner[second]], np.r_[p, p[second]], np.r_[band, band[second] - 1], np.r_[place, place[second]]
    order = np.lexsort((p, band, owner))
    owner, p, band, place = owner[order], p[order], band[order], place[order]
    stretch = index.stretch[owner]
    bound = stretch + 1 - Q * (index.budget[owner] + 1)
    last = np.arange(len(p)) + bound - 1
    inside = last < len(p)
    last = np.minimum(last, len(p) - 1)
    good = inside & (owner[last] == owner) & (band[last] == band) & (p[last] - p <= stretch + EDITS - Q)
    met: set = set()
    for o, d in dict.fromkeys(zip(owner[good].tolist(), band[good].tolist(), strict=True)):
        if o in met:
            continue
        s, e = np.searchsorted(owner, [o, o + 1])
        here = s + np.flatnonzero(band[s:e] == d)
        here = here[np.lexsort((p[here], p[here] - place[here]))]
        q, r = p[here], place[here]
        first = np.flatnonzero(np.r_[True, (np.diff(q) != 1) | (np.diff(r) != 1)])
        for i, j in zip(first, np.r_[first[1:], len(q)], strict=True):  # runs of q-grams on a diagonal
            hit = verify(text, index.items[o], int(q[i]), int(r[i]), int(q[j - 1] - q[i]) + Q, int(index.stretch[o]), int(index.budget[o]))
            if hit:
                met.add(o)
                yield o, hit
                break


def _search(index: Index):
    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in slices(parts):
            rows = [(i, *hit) for i, null, t in zip(part["id"], part["no_id"], part["text"], strict=True) for hit in leaks(t, index) for i in [None if null else int(i)]]
            if rows:
                yield pd.DataFrame({"doc_id": pd.array([r[0] for r in rows], dtype="Int64"), "item_id": [r[1] for r in rows], "start": [r[2] for r in rows], "stop": [r[3] for r in rows], "edits": [r[4] for r in rows]})

    return run


def _blocks(benchmark: DataFrame, item_col: str, text_col: str) -> Iterator[Index]:
    rows, size = [], 0
    for item, text in benchmark.select(F.col(item_col).cast("string"), text_col).where(F.col(text_col).isNotNull()).orderBy(item_col, text_col).toLocalIterator():
        if rows and size + len(text) > BLOCK_CHARS:
            yield build(rows)
            rows, size = [], 0
        rows.append((item, text))
        size += len(text)
    yield build(rows)


def _shared(docs: DataFrame, benchmark: DataFrame, item_col: str, item_text: str) -> Iterator:
    return (docs.sparkSession.sparkContext.broadcast(index) for index in _blocks(benchmark, item_col, item_text))


def find_leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """(doc_id, item_id, start, stop, edits): each document and benchmark item that it leaks, with the region.

    No shuffle: every block of the benchmark, BLOCK_CHARS at most, goes to the tasks that read the documents, which are
    read once a block. Null texts leak nothing and null items and those without a letter or digit are not searched for;
    repeated rows are reported each; null identifiers stay null. item_id is text. start and stop are code points of the
    document. Other columns are ignored.
    """
    rows = docs.select(F.coalesce(F.col(id_col), F.lit(0)).cast("long").alias("id"), F.col(id_col).isNull().alias("no_id"), F.col(text_col).alias("text"))
    out = None
    for shared in _shared(docs, benchmark, item_col, item_text):
        part = rows.mapInPandas(lambda parts, shared=shared: _search(shared.value)(parts), "doc_id long, item_id string, start int, stop int, edits int")
        out = part if out is None else out.unionByName(part)
    return out


def drop_leaking(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """The rows of docs whose text leaks no item; no shuffle, and what one block drops the next does not read."""

    def clean(shared):
        @F.pandas_udf("boolean")
        def of(texts: pd.Series) -> pd.Series:
            return pd.Series([not leaks(t, shared.value, one=True) for t in texts])

        return of

    for shared in _shared(docs, benchmark, item_col, item_text):
        docs = docs.where(clean(shared)(docs[text_col]))
    return docs
