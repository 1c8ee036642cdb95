"""Main text of web pages by differencing each with the page of the nearest URL on its host.

Pages are ordered by host and URL path, in ranges; a page is paired with whichever neighbour in that order
shares more of its path. The text lines (blocks) of the two are aligned by their longest common subsequence and
the shared lines go. The page's own markup decides what differencing cannot: what stands in menus, headers,
footers, sidebars, notices, adverts, forms, scripts and reader comments goes, shared or not, and what stands in
an article is kept, for articles share lines of their own too; a page with an article keeps that alone, and is
not aligned.
"""

from __future__ import annotations

import html
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veilgraph.llm.batches import slices

ARTICLE, OTHER, DROPPED = 0, 1, 2
#: Names of elements and words of class, id or role that mark what is not main text.
SKIPPED = ("script", "style", "template", "noscript", "iframe", "svg", "canvas", "object", "textarea", "title")
BOILER = ("nav", "footer", "aside", "form", "head", "menu", "select", "button", "dialog")
MAIN = ("article", "main")
VOID = ("area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr")
LOOSE = ("p", "li", "dt", "dd", "tr", "td", "th", "option")
INLINE = "a abbr b bdi bdo big cite code data del dfn em font i ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr".split()
MARKS = (
    "ad ads adv advert adverts advertisement advertising alert banner breadcrumb breadcrumbs comment comments consent cookie cookies "
    "disqus footer gdpr header login masthead menu modal nav navbar navigation newsletter notice popup promo related reply replies "
    "respond search share sharing sidebar signup social sponsor sponsored subscribe toolbar widget"
).split()
#: Words of a class that is named after the content, not what the content is.
CONTENT = ("article", "body", "content", "entry", "has", "main", "no", "page", "post", "story", "text", "with", "without")
#: Pages of a range, about.
RANGE_ROWS = 50_000

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*>?|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)(?:>|\Z)", re.S)
_MARKED = re.compile(r"""(?:^|\s)(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.I)
_PARTS = re.compile(r"[a-z]+")
_MARK_SET, _CONTENT_SET, _SETS = frozenset(MARKS), frozenset(CONTENT), {k: frozenset(v) for k, v in (("skip", SKIPPED), ("boiler", BOILER), ("main", MAIN), ("void", VOID), ("loose", LOOSE), ("inline", INLINE))}


def _boiler(name: str, attributes: str, inside_main: bool) -> bool:
    if name in _SETS["boiler"] or (name == "header" and not inside_main):
        return True
    if "=" not in attributes or name in ("html", "body", *MAIN):
        return False
    return any(marked(token) for m in _MARKED.findall(attributes) for token in "".join(m).lower().split())


def marked(token: str) -> bool:
    """Whether a class, id or role names what is not main text: by its first word, or by its last if none is of CONTENT."""
    parts = _PARTS.findall(token)
    return bool(parts) and (parts[0] in _MARK_SET or (parts[-1] in _MARK_SET and not _CONTENT_SET.intersection(parts)))


def blocks(page: str | None) -> list[tuple[str, int]]:
    """The text blocks of a page in order, white space single, with ARTICLE, OTHER or DROPPED each."""
    page = page or ""
    out, words, stack, at = [], [], [], 0
    state, size = OTHER, len(page)
    held: Counter = Counter()

    def flush() -> None:
        text = " ".join(html.unescape("".join(words)).split())
        words.clear()
        if text:
            out.append((text, state))

    while at < size:
        m = _TOKEN.search(page, at)
        if m is None:
            words.append(page[at:])
            break
        words.append(page[at : m.start()])
        at = m.end()
        name = (m[2] or m[5] or "").lower()
        if not name:
            continue
        if m[1] or m[4]:
            if name in _SETS["inline"] and not held[name]:
                continue
            flush()
            while held[name]:
                last, state = stack.pop()
                held[last] -= 1
                if last == name:
                    break
            continue
        if name in _SETS["skip"]:
            flush()
            end = re.compile(rf"</{re.escape(name)}\s*>", re.I).search(page, at)
            at = end.end() if end else size
            continue
        if name in _SETS["void"]:
            words.append(" " if name in ("br", "hr") else "")
            continue
        attributes = m[3] or m[6] or ""
        main = any(held[n] for n in MAIN)
        boiler = state != DROPPED and _boiler(name, attributes, main)
        if name in _SETS["inline"] and not boiler:
            continue
        if stack and name in _SETS["loose"] and stack[-1][0] == name:
            flush()
            state = stack.pop()[1]
            held[name] -= 1
        flush()
        if boiler or name not in _SETS["loose"]:
            stack.append((name, state))
            held[name] += 1
            if boiler:
                state = DROPPED
            elif name in _SETS["main"] and state != DROPPED:
                state = ARTICLE
    flush()
    return out


def _scores(a: list, b: list) -> np.ndarray:
    """Lengths of the longest common subsequences of a with each prefix of b, bits of one integer at a time."""
    masks: dict = {}
    for j, x in enumerate(b):
        masks[x] = masks.get(x, 0) | 1 << j
    full = (1 << len(b)) - 1
    v = full
    for x in a:
        u = v & masks.get(x, 0)
        v = (v + u | v - u) & full
    bits = np.unpackbits(np.frombuffer((v ^ full).to_bytes(len(b) // 8 + 1, "little"), np.uint8), bitorder="little")[: len(b)]
    return np.r_[0, np.cumsum(bits.astype(np.int64))]


def shared(a: list, b: list) -> set[int]:
    """Places in a of a longest common subsequence with b, in space that follows the longer of the two."""
    out, todo = set(), [(0, len(a), 0, len(b))]
    while todo:
        i, n, j, m = todo.pop()
        while i < n and j < m and a[i] == b[j]:
            out.add(i)
            i, j = i + 1, j + 1
        while i < n and j < m and a[n - 1] == b[m - 1]:
            n, m = n - 1, m - 1
            out.add(n)
        here = set(b[j:m])
        if i == n or j == m or not any(x in here for x in a[i:n]):
            continue
        if n - i == 1:
            out.add(i)
            continue
        half = (i + n) // 2
        cut = j + int((_scores(a[i:half], b[j:m]) + _scores(a[half:n][::-1], b[j:m][::-1])[::-1]).argmax())
        todo += [(i, half, j, cut), (half, n, cut, m)]
    return out


def _common(a: str, b: str) -> int:
    for i, (x, y) in enumerate(zip(a, b, strict=False)):
        if x != y:
            return i
    return min(len(a), len(b))


def main_text(page: list[tuple[str, int]], other: list[tuple[str, int]]) -> str:
    """The page's main text, given its blocks and those of the page it is paired with (none: no differencing)."""
    if any(s == ARTICLE for _, s in page):
        return " ".join(t for t, s in page if s == ARTICLE)
    gone = shared([t for t, _ in page], [t for t, _ in other]) if other else set()
    return " ".join(t for i, (t, s) in enumerate(page) if s == OTHER and i not in gone)


def _pack(page: list[tuple[str, int]]) -> bytes:
    return zstandard.compress("\n".join(f"{s}{t}" for t, s in page).encode("utf-8", "surrogatepass"), 3)


def _unpack(data: bytes) -> list[tuple[str, int]]:
    text = zstandard.decompress(data).decode("utf-8", "surrogatepass")
    return [(x[1:], int(x[0])) for x in text.split("\n")] if text else []


def _parse(shared_ends):
    """Rows with their range, and copies of the first and last rows of ranges for the ranges beside them."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        lows, highs, names = shared_ends.value
        for part in slices(parts):
            keys = list(zip(part["host"], part["path"], part["id"], part["h"], strict=True))
            data = [_pack(blocks(p)) for p in part["html"]]
            rows = []
            for r, key in enumerate(keys):
                k = min(bisect_left(highs, key), len(highs) - 1)
                rows.append((k, r, True))
                if key == highs[k] and k + 1 < len(highs):
                    rows.append((k + 1, r, False))
                if key == lows[k] and k:
                    rows.append((k - 1, r, False))
            out = part.drop(columns="html").assign(data=data).iloc[[r for _, r, _ in rows]].reset_index(drop=True)
            yield out.assign(part=[names[k] for k, _, _ in rows], own=[o for _, _, o in rows])

    return run


def _difference(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows in order; each but copies leaves once its neighbours are known."""
    before, now = None, None

    def result(a, x, b) -> dict:
        near = [(_common(x["path"], y["path"]), -i, y) for i, y in enumerate((a, b)) if y and y["part"] == x["part"] and y["host"] == x["host"]]
        text = main_text(x["blocks"], max(near, key=lambda n: n[:2])[2]["blocks"] if near else [])
        return {"page_id": None if x["no_id"] else x["id"], "url": x["url"], "text": text, "n_chars": len(text)}

    def frame(rows: list[dict]) -> pd.DataFrame:
        return pd.DataFrame({"page_id": pd.array([r["page_id"] for r in rows], dtype="Int64"), "url": [r["url"] for r in rows], "text": [r["text"] for r in rows], "n_chars": [r["n_chars"] for r in rows]})

    for part in slices(parts):
        rows = []
        for x in part.to_dict("records"):
            x["blocks"] = _unpack(x.pop("data"))
            if now and now["own"]:
                rows.append(result(before, now, x))
            before, now = now, x
        if rows:
            yield frame(rows)
    if now and now["own"]:
        yield frame([result(before, now, None)])


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(page_id, url, text, n_chars): every page with its main text, empty if it has none.

    The only shuffle of page texts carries compressed blocks, in ranges of (host, path, identifier) that split a
    host as needed; rows at the ends of a range are copied to the ranges beside it. Null URLs share an empty
    host; null html has no text; repeated rows are kept and are each other's neighbours; null identifiers stay
    null. Of two neighbours that share as much of the path the one before is taken. Other columns are ignored. The
    driver gets two keys a range; there is one for about RANGE_ROWS pages, and four a shuffle partition at least.
    """
    spark = pages.sparkSession
    n = max(4 * int(spark.conf.get("spark.sql.shuffle.partitions")), -(-pages.count() // RANGE_ROWS))
    url = F.coalesce(F.col(url_col), F.lit(""))
    keyed = pages.select(
        F.coalesce(F.col(id_col), F.lit(0)).cast("long").alias("id"), F.col(id_col).isNull().alias("no_id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"),
        F.lower(F.regexp_extract(url, r"^\w*:?//([^/?#]*)", 1)).alias("host"), F.regexp_extract(url, r"^(?:\w*:?//[^/?#]*)?([^?#]*)", 1).alias("path"), F.xxhash64(url).alias("h"),
    )
    key = ["host", "path", "id", "h"]
    ends = keyed.select(*key).repartitionByRange(n, *key).groupBy(F.spark_partition_id().alias("k")).agg(F.min(F.struct(*key)).alias("low"), F.max(F.struct(*key)).alias("high")).collect()
    lows, highs = sorted(tuple(r["low"]) for r in ends), sorted(tuple(r["high"]) for r in ends)
    kinds = "id long, no_id boolean, url string, host string, path string, h long, data binary, part int, own boolean"
    if not ends:
        lows = highs = [("", "", 0, 0)]
    parsed = keyed.mapInPandas(_parse(spark.sparkContext.broadcast((lows, highs, _apart(spark, n)))), kinds)
    return parsed.repartition(n, "part").sortWithinPartitions("part", *key).mapInPandas(_difference, "page_id long, url string, text string, n_chars long")


def _apart(spark: SparkSession, n: int) -> list[int]:
    """n integers that hash to n different partitions, so that no task gets two ranges."""
    tried = spark.range(20 * n + 400).select(F.col("id").cast("int").alias("i"))
    found = tried.groupBy(F.pmod(F.hash("i"), F.lit(n)).alias("p")).agg(F.min("i").alias("i")).select("i").collect()
    return [r["i"] for r in found] + [-1 - i for i in range(n - len(found))]
