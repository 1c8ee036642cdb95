"""Personal data by bootstrapped contextual extraction.

Base expressions find e-mail and IP addresses, card and phone numbers; these are the seeds, and so are long
hexadecimal strings, the seeds of a fifth kind, secrets. Everything that looks like an identifier, seed or not, is an
instance, and the one, two and three words before it are patterns. Spark scores the pattern-instance graph in rounds: a
pattern by the mean score of the distinct values that follow it, a value by its best pattern, until no further pattern
is trusted. Values that trusted patterns introduce become spans of that kind; a secret is only one with such a pattern.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilgraph.llm.batches import slices
from veilgraph.plans.staging import discard, staged

KINDS = ("email", "ip", "card", "phone", "secret")
SECRET = 4
#: A pattern is trusted with this score over this many distinct values; words of the longest pattern.
TRUST, SUPPORT, WORDS = 0.7, 4, 3
#: Digits that a token must have to look like an identifier, and the least and most of a number written in groups.
MIN_DIGITS, GROUP_DIGITS = 4, (7, 19)
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_TOKEN = re.compile(r"(?<!\S)[^\s0-9@]*+[0-9@]\S*")
_GROUP = re.compile(r"(?<![^\s\"'<\[{,;:=])[+(]?[0-9][0-9 ().-]*[0-9]")
_SECRET = re.compile(r"(?=[0-9A-Fa-f]*[0-9])(?=[0-9A-Fa-f]*[A-Fa-f])[0-9A-Fa-f]{32,}")
_WORDS = re.compile(r"\S+")


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) * (1 + i % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind, start, end) by kind and start; leftmost matches of a kind do not overlap, those of two kinds may."""
    out, end, at = [], 0, text.find("@")
    while at >= 0:
        s = at
        while s > end and text[s - 1] in _LOCAL:
            s -= 1
        m = _DOMAIN.match(text, at + 1) if s < at else None
        if m:
            out.append((0, s, end := m.end()))
        at = text.find("@", max(at + 1, end))
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p[-4:]) <= 255 for p in m[0].split(".")):
            out.append((1, m.start(), m.end()))
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 16 and 16 <= len(d := m[0].replace(" ", "").replace("-", "")) <= 19 and luhn(d):
            out.append((2, m.start(), m.end()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 8 <= sum(c in "0123456789" for c in m[0]) <= 15:
                out.append((3, m.start(), m.end()))
    return out


def _candidates(text: str) -> Iterator[tuple[int, int]]:
    """Numbers written in groups that blanks, brackets, dots or hyphens join, and tokens with @ or MIN_DIGITS digits."""
    for m in _GROUP.finditer(text):
        if GROUP_DIGITS[0] <= sum(c.isdigit() for c in m[0]) <= GROUP_DIGITS[1]:
            yield m.span()
    for m in _TOKEN.finditer(text):
        s, e = m.span()
        while s < e and not text[s].isalnum() and text[s] != "+":
            s += 1
        while e > s and not text[e - 1].isalnum():
            e -= 1
        if "@" in text[s:e] or sum(c.isdigit() for c in text[s:e]) >= MIN_DIGITS:
            yield s, e


def instances(text: str, spans: list[tuple[int, int, int]]) -> list[tuple]:
    """(kind or None, start, end, patterns, value) of seeds and of what else looks like an identifier.

    Marks around a token are not part of it. What overlaps a base span, or a longer candidate, is no instance.
    """
    found, covered = list(spans), []  # covered: disjoint, ascending
    for s, e in sorted((s, e) for _, s, e in spans):
        if covered and s < covered[-1][1]:
            covered[-1] = (covered[-1][0], max(e, covered[-1][1]))
        else:
            covered.append((s, e))
    for s, e in sorted(_candidates(text), key=lambda x: (x[0] - x[1], x[0])):
        i = bisect_left(covered, (s, e))
        if not (i and covered[i - 1][1] > s) and not (i < len(covered) and covered[i][0] < e):
            found.append((SECRET if _SECRET.fullmatch(text, s, e) else None, s, e))
            covered.insert(i, (s, e))
    if not found:
        return []
    words = [m.span() for m in _WORDS.finditer(text)]
    starts = [s for s, _ in words]
    out = []
    for kind, s, e in found:
        i = bisect_left(starts, s)
        before = [text[a : min(b, s)].lower() for a, b in words[max(0, i - WORDS) : i]]
        patterns = [f"{n} {' '.join(before[-n:])}" for n in range(1, len(before) + 1)]
        out.append((kind, s, e, patterns, hashlib.md5(text[s:e].encode("utf-8", "surrogatepass")).hexdigest()))
    return out


def _line(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for k, s, e in spans)


_SCHEMA = (
    "doc_id long, row long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, "
    "base array<struct<kind:int,start:int,stop:int>>, seen array<struct<kind:int,start:int,stop:int,patterns:array<string>,value:string>>"
)


def _extract(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for part in slices(parts):
        rows = []
        for doc_id, null, row, text in zip(part["id"], part["no_id"], part["row"], part["text"], strict=True):
            spans = base_spans(text)
            seen = instances(text, spans)
            rows.append((None if null else doc_id, row, *(sum(k == j for k, _, _ in spans) for j in range(4)), hashlib.sha256(_line(spans).encode()).hexdigest(), [dict(zip(("kind", "start", "stop"), x, strict=True)) for x in spans], [dict(zip(("kind", "start", "stop", "patterns", "value"), x, strict=True)) for x in seen]))
        out = pd.DataFrame(rows, columns=["doc_id", "row", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "base", "seen"])
        out["doc_id"] = pd.array(out["doc_id"], dtype="Int64")
        yield out


def trusted_values(edges: DataFrame, trust: float = TRUST, support: int = SUPPORT) -> DataFrame:
    """(pattern, kind, score): trusted patterns of edges (pattern, value, seed): seed is the value's kind or null.

    Rounds go on until one trusts no further pattern; trust only grows, so they end.
    """
    graph = staged(edges.distinct(), "graph")
    seeds = graph.where("seed is not null").select("value", F.col("seed").alias("kind"), F.lit(1.0).alias("score")).distinct()
    sizes = graph.groupBy("pattern").agg(F.countDistinct("value").alias("n"))
    scores, good, known = seeds, None, -1
    while True:
        rated = graph.select("pattern", "value").distinct().join(scores, "value").groupBy("pattern", "kind").agg(F.sum("score").alias("s"), F.count(F.lit(1)).alias("k"))
        new = staged(rated.join(sizes, "pattern").where((F.col("k") >= support) & (F.col("s") >= trust * F.col("n"))).select("pattern", "kind", (F.col("s") / F.col("n")).alias("score")), "patterns")
        if good is not None:
            discard(good)
        good, now = new, new.count()
        if now == known:
            return good
        known = now
        learned = graph.where("seed is null").select("pattern", "value").join(good, "pattern").select("value", "kind", "score")
        scores = seeds.unionByName(learned).groupBy("value", "kind").agg(F.max("score").alias("score"))


def find(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_learned), one row a row of docs.

    Counts and base_sha256 are of the base spans; spans holds them and the learned ones, by kind and start, as
    kind:start:end; n_learned counts the latter. Null texts are empty; repeated rows are each reported and their values count once as support;
    null identifiers stay null. Other columns are ignored. A token trusted as two kinds is given the better
    scored, the earlier listed in a tie.
    """
    rows = docs.select(F.coalesce(F.col(id_col), F.lit(0)).cast("long").alias("id"), F.col(id_col).isNull().alias("no_id"), F.monotonically_increasing_id().alias("row"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    base = staged(rows.mapInPandas(_extract, _SCHEMA), "spans")
    seen = base.select("row", F.explode("seen").alias("x")).select("row", "x.*")
    either = seen.withColumn("pattern", F.explode("patterns"))
    good = trusted_values(either.select("pattern", "value", F.col("kind").alias("seed")))
    hits = either.where(f"kind is null or kind = {SECRET}").drop("kind").join(good, "pattern").groupBy("row", "start", "stop").agg(F.min(F.struct((-F.col("score")).alias("a"), "kind")).alias("best"))
    learned = hits.groupBy("row").agg(F.collect_list(F.struct(F.col("best.kind").alias("kind"), "start", "stop")).alias("learned"))
    both = base.drop("seen").join(learned, "row", "left")
    names = F.array(*map(F.lit, KINDS))
    every = F.array_sort(F.concat("base", F.coalesce("learned", F.array().cast("array<struct<kind:int,start:int,stop:int>>"))))
    text = F.array_join(F.transform(every, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["stop"].cast("string"))), ",")
    return both.select("doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", text.alias("spans"), F.coalesce(F.size("learned"), F.lit(0)).cast("long").alias("n_learned"))
