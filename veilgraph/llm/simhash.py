"""SimHash near-duplicates by anchor points of a covering code.

Two blocks of 23 fingerprint bits are each decoded to the perfect binary Golay code (covering radius 3), so
the anchors are pairs of code words. A fingerprint lives at its own anchor and is copied to every anchor that
lies within the covering radius plus the threshold; two fingerprints at most `bits` apart then meet at the
home anchor of either, whatever the other 18 bits are, and are compared there on all 64.
"""

from __future__ import annotations

import functools
import operator
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from veilgraph.llm.batches import slices
from veilgraph.operators.components import connected_components
from veilgraph.plans.staging import discard, staged

#: Generator polynomial of the (23, 12) Golay code, its length and covering radius.
GENERATOR, LENGTH, RADIUS = 0xC75, 23, 3
MOST_BITS = 2
SEED = 42
_BIT_OF_BYTE = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1).astype(np.int64)


def fingerprint(text: str | None, words: int = 3) -> int:
    """Unsigned 64-bit SimHash of the word shingles, repeats included; 0 without words or for null."""
    w = (text or "").encode().lower().split()
    if not w:
        return 0
    if len(w) < words:
        hashes = xxhash.xxh64_digest(b" ".join(w), SEED)
    else:
        join, digest = b" ".join, xxhash.xxh64_digest
        hashes = b"".join([digest(join(s), SEED) for s in zip(*(w[i:] for i in range(words)), strict=False)])
    return _majority(hashes)


def _majority(hashes: bytes) -> int:
    """The bits that are set in over half of big-endian hashes of 64 bits."""
    table = np.frombuffer(hashes, dtype=np.uint8).reshape(-1, 8)
    bits = np.concatenate([np.bincount(table[:, i], minlength=256) @ _BIT_OF_BYTE for i in range(8)])
    return int.from_bytes(np.packbits(2 * bits > len(table)).tobytes(), "big")


def fingerprints(docs: DataFrame, id_col: str, text_col: str, words: int) -> DataFrame:
    """(id, fp): fp is the fingerprint's bits as a signed long."""
    @F.pandas_udf("long")
    def of(texts: pd.Series) -> pd.Series:
        return pd.Series(np.array([fingerprint(t, words) for t in texts], dtype=np.uint64).view(np.int64))

    return docs.select(F.col(id_col).alias("id"), of(F.col(text_col)).alias("fp"))


class _Golay:
    """Coset tables: for each syndrome, the error words of weight up to RADIUS + MOST_BITS, by excess over RADIUS."""

    def __init__(self) -> None:
        unit = []
        for i in range(LENGTH):
            r = 1 << i
            for j in range(i, 10, -1):
                if r >> j & 1:
                    r ^= GENERATOR << (j - 11)
            unit.append(r)
        self.low, self.high = np.zeros(4096, np.int64), np.zeros(2048, np.int64)
        for i in range(12):
            self.low[np.arange(4096) >> i & 1 == 1] ^= unit[i]
        for i in range(11):
            self.high[np.arange(2048) >> i & 1 == 1] ^= unit[12 + i]
        every = [np.zeros(1, np.int64)]
        for _ in range(RADIUS + MOST_BITS):  # words of one more bit, each bit above those set
            every.append(np.concatenate([(last := every[-1])[last < (1 << i)] | (1 << i) for i in range(LENGTH)]))
        self.start, self.errors = [], []
        for k in range(MOST_BITS + 1):
            e = np.concatenate(every[: RADIUS + 1]) if k == 0 else every[RADIUS + k]
            s = self.syndrome(e)
            order = np.argsort(s, kind="stable")
            self.errors.append(e[order])
            self.start.append(np.searchsorted(s[order], np.arange(2049)))

    def syndrome(self, x: np.ndarray) -> np.ndarray:
        return self.low[x & 4095] ^ self.high[x >> 12]

    def words(self, x: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Row numbers and code words at a distance of up to RADIUS for k = 0, of RADIUS + k else."""
        s = self.syndrome(x)
        first, n = self.start[k][s], self.start[k][s + 1] - self.start[k][s]
        row = np.repeat(np.arange(len(x)), n)
        return row, x[row] ^ self.errors[k][np.repeat(first - np.cumsum(n) + n, n) + np.arange(len(row))]


_code: list[_Golay] = []


def anchors(fp: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row number, anchor and whether it is the row's home, for each anchor within radius plus bits."""
    if not _code:
        _code.append(_Golay())
    code, u = _code[0], fp.view(np.uint64)
    mask = np.uint64((1 << LENGTH) - 1)
    a, b = (u & mask).astype(np.int64), (u >> np.uint64(LENGTH) & mask).astype(np.int64)
    rows, at, home = [], [], []
    for i in range(bits + 1):
        ra, wa = code.words(a, i)
        for j in range(bits + 1 - i):
            rb, wb = code.words(b[ra], j)
            rows.append(ra[rb])
            at.append(wa[rb] | wb << LENGTH)
            home.append(np.full(len(rb), i + j == 0))
    return np.concatenate(rows), np.concatenate(at), np.concatenate(home)


def _replicas(bits: int):
    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            fp = part["fp"].to_numpy(np.int64)
            for i in range(0, len(fp), 4096):
                row, at, home = anchors(block := fp[i : i + 4096], bits)
                yield pd.DataFrame({"anchor": at, "fp": block[row], "away": ~home})

    return run


def _forest(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each end of the links x-y with the smallest end that it reaches over them."""
    nodes, ends = np.unique(np.concatenate([x, y]), return_inverse=True)
    a, b = ends[: len(x)], ends[len(x) :]
    label = np.arange(len(nodes))
    while True:
        new = label.copy()
        np.minimum.at(new, a, label[b])
        np.minimum.at(new, b, label[a])
        new = new[new]
        if (new == label).all():
            return nodes, nodes[label]
        label = new


def _compare(bits: int):
    """Rows come by anchor, homes first; links come out as a forest of each anchor and block of rows."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        anchor, homes = None, np.zeros(0, np.int64)
        for part in parts:
            at, fp, away = (part[c].to_numpy() for c in ("anchor", "fp", "away"))
            edges = np.flatnonzero(np.r_[True, at[1:] != at[:-1]])
            counts = np.diff(np.r_[edges, len(at)])
            here = np.add.reduceat(~away, edges)
            xs, ys = [], []
            for g in np.flatnonzero((counts > 1) & (here > 0) | (np.arange(len(edges)) == 0)):
                s, e = edges[g], edges[g] + counts[g]
                own = fp[s:e][~away[s:e]]
                all_homes = np.r_[homes, own] if at[s] == anchor else own
                for i in range(s, e, step := max(1, 1 << 20 >> max(1, len(all_homes)).bit_length())):
                    part_fp = fp[i : min(e, i + step)]
                    n = np.bitwise_count((part_fp[:, None] ^ all_homes[None, :]).view(np.uint64))
                    p, q = np.nonzero((n <= bits) & (n > 0))
                    if len(p):
                        xs.append(part_fp[p])
                        ys.append(all_homes[q])
            last = edges[-1]
            own = fp[last:][~away[last:]]
            homes = np.r_[homes, own] if at[last] == anchor else own
            anchor = at[last]
            if xs:
                node, root = _forest(np.concatenate(xs), np.concatenate(ys))
                yield pd.DataFrame({"u": node, "v": root})[node != root]

    return run


def _links(prints: DataFrame, bits: int) -> DataFrame:
    """(u, v): links that join the distinct fingerprints (fp) at most `bits` apart into their groups."""
    spark = prints.sparkSession
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)
    copies = prints.mapInPandas(_replicas(bits), "anchor long, fp long, away boolean")
    return copies.repartition(n, "anchor").sortWithinPartitions("anchor", "away").mapInPandas(_compare(bits), "u long, v long")


def simhash_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3, bits: int = 2) -> DataFrame:
    """One row a document: id, fp (long) and component, the smallest id reachable over links of `bits` or fewer.

    Nulls and texts without words have fingerprint zero and link like any other. Repeated rows and equal
    texts share a fingerprint, which is compared once. Null ids are kept; they name a group only if it has no
    other id. Other columns are ignored, whatever their names. Work follows distinct fingerprints: each makes
    some 60 small rows, spread by anchor; an anchor's links leave as a forest, not as pairs.
    """
    if not 0 <= bits <= MOST_BITS:
        raise ValueError(f"bits must be 0 to {MOST_BITS}")
    spark = docs.sparkSession
    prints = staged(fingerprints(docs, id_col, text_col, words), "prints")
    classes = staged(prints.groupBy("fp").agg(F.min("id").alias("rep")), "classes")
    comp = connected_components(_links(classes.select("fp"), bits))
    named = staged(
        comp.join(classes, comp["node"] == classes["fp"]).groupBy("component").agg(F.min("rep").alias("group")).join(comp, "component").select(F.col("node").alias("fp"), "group"),
        "named",
    )
    by_fp = classes.join(named, "fp", "left").select("fp", F.coalesce("group", "rep").alias("component"))
    return prints.join(by_fp, "fp").select("id", "fp", "component")


#: Texts whose shingles are counted to tell popular ones, a shingle's least count there, and the most that are told. They steer
#: the work and not the result: any order of shingles that all texts share finds every pair.
SAMPLE, POPULAR, MOST_POPULAR = 30000, 3, 200000
#: Bytes of texts or sets that a Python function gets at once.
BATCH = "4m"
#: Words of the sketch by which pairs of texts that differ too much are told before they leave the join.
SKETCH = 8


def shingle_set(text: str | None, words: int) -> bytes:
    """The hashes of a text's word shingles, each once, ascending, as bytes."""
    w = (text or "").encode().lower().split()
    shingles = [b" ".join(w)] if len(w) < words else map(b" ".join, zip(*(w[i:] for i in range(words)), strict=False))
    return np.unique(np.frombuffer(b"".join([xxhash.xxh64_digest(s, SEED) for s in shingles]), ">u8")).tobytes()


def jaccard(a: bytes, b: bytes) -> float:
    x, y = np.frombuffer(a, ">u8"), np.frombuffer(b, ">u8")
    both = len(np.intersect1d(x, y, assume_unique=True))
    return both / (len(x) + len(y) - both)


def prefix(hashes: np.ndarray, popular: tuple[np.ndarray, np.ndarray], similarity: float) -> np.ndarray:
    """The first shingles of a set, popular ones last, of which two sets of the similarity share one at least."""
    names, counts = popular
    if len(names):
        at = np.minimum(np.searchsorted(names, hashes), len(names) - 1)
        hashes = hashes[np.lexsort((hashes, np.where(names[at] == hashes, counts[at], 0)))]
    return hashes[: len(hashes) - int(np.ceil(similarity * len(hashes) - 1e-9)) + 1]


def sketch(hashes: np.ndarray) -> np.ndarray:
    """SKETCH words of 64 bits, each bit the parity of the shingles that fall on it.

    Two sets whose sketches differ in d bits differ in d shingles at least.
    """
    return np.packbits(np.bincount((hashes % np.uint64(64 * SKETCH)).astype(np.int64), minlength=64 * SKETCH).astype(np.uint8) & 1).view(np.int64)


def _shingle_rows(words: int):
    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in slices(parts):
            yield pd.DataFrame({"s": np.concatenate([np.frombuffer(shingle_set(t, words), ">u8").astype(np.uint64).view(np.int64) for t in part["t"]])})

    return run


def _popular(docs: DataFrame, text_col: str, words: int) -> tuple[np.ndarray, np.ndarray]:
    """Shingles that several of a sample of distinct texts have, ascending, and their counts."""
    mark = F.xxhash64(F.col(text_col))
    part = docs.select(F.col(text_col).alias("t"), mark.alias("m")).where(F.pmod("m", F.lit(max(1, docs.count() // SAMPLE))) == 0)
    counts = part.dropDuplicates(["m"]).select("t").mapInPandas(_shingle_rows(words), "s long").groupBy("s").count().where(F.col("count") >= POPULAR)
    rows = counts.orderBy(F.col("count").desc(), "s").limit(MOST_POPULAR).toPandas()
    names = rows["s"].to_numpy(np.int64).view(np.uint64)
    order = np.argsort(names)
    return names[order], rows["count"].to_numpy(np.int64)[order]


def _described(text: str | None, popular: tuple[np.ndarray, np.ndarray], words: int, similarity: float) -> tuple:
    """A digest of a text's set, its size, its SimHash, its prefix and its sketch."""
    data = shingle_set(text, words)
    hashes = np.frombuffer(data, ">u8").astype(np.uint64)
    return xxhash.xxh3_128_digest(data), len(hashes), int(np.uint64(_majority(data)).view(np.int64)), prefix(hashes, popular, similarity).view(np.int64), *sketch(hashes).tolist()


def _set_bytes(words: int):
    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in slices(parts):
            yield pd.DataFrame({"row": part["row"], "s": [shingle_set(t, words) for t in part["t"]]})

    return run


def _names(id_col: str, text_col: str) -> list:
    """Two hashes that know a row by its identifier and text."""
    return [F.xxhash64(F.col(id_col), F.col(text_col)).alias("k1"), F.xxhash64(F.lit(1), F.col(text_col), F.col(id_col)).alias("k2")]


def _proposed(heads: DataFrame, bits: int) -> DataFrame:
    """(u, v): pairs of rows (row, fp) that SimHash proposes: with the first row of their fingerprint, and such rows of
    fingerprints at most `bits` apart that join their groups."""
    leads = staged(heads.groupBy("fp").agg(F.min("row").alias("lead")), "leads")
    alike = heads.join(leads, "fp").where("row > lead").select(F.col("lead").alias("u"), F.col("row").alias("v"))
    a, b = (leads.select(F.col("fp").alias(x), F.col("lead").alias(y)) for x, y in (("u", "p"), ("v", "q")))
    apart = _links(leads.select("fp"), bits).distinct().join(a, "u").join(b, "v")
    return alike.unionByName(apart.select(F.least("p", "q").alias("u"), F.greatest("p", "q").alias("v"))).distinct()


def near_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, similarity: float = 0.8, most_bits: int = MOST_BITS) -> DataFrame:
    """(k1, k2, id, group): rows known by two hashes of id and text, and the group that each is in.

    Two texts are linked if the Jaccard similarity of their sets of word shingles is at least `similarity`; groups are
    what links join, and no such pair is lost. Texts of equal sets are met once. SimHashes of the sets are met first, as
    simhash_groups() meets them, and what they propose is compared; they find the closest copies. Of what is left two sets
    of the similarity share a shingle of their prefixes, and nearly all of these are in one prefix only. Of those that share
    a shingle each is then compared with the text that shares most of its prefix, as an original does; then all pairs that this has
    not joined are met, and those that share enough of their prefixes compared; of these the join itself lets go all that
    sketches show to differ too much, so that a large group under the similarity leaves few rows.
    """
    spark = docs.sparkSession
    popular = spark.sparkContext.broadcast(_popular(docs, text_col, words))

    @F.pandas_udf("double")
    def exact(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([jaccard(x, y) for x, y in zip(a, b, strict=True)])

    bits = [f"b{i}" for i in range(SKETCH)]
    columns = ["same", "n", "fp", "prefix", *bits]

    @F.pandas_udf(f"same binary, n long, fp long, prefix array<long>, {', '.join(f'{b} long' for b in bits)}")
    def of(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([_described(t, popular.value, words, similarity) for t in texts], columns=columns)

    seen = staged(docs.select(F.monotonically_increasing_id().alias("row"), *_names(id_col, text_col), F.col(id_col).alias("id"), of(F.col(text_col)).alias("x")).select("row", "k1", "k2", "id", "x.*"), "sets", BATCH)

    def linked(pairs: DataFrame) -> DataFrame:
        """Those of the pairs (u, v) of rows that have the similarity."""
        asked = seen.select("row", "k1", "k2").join(pairs.select(F.explode(F.array("u", "v")).alias("row")).distinct(), "row")
        texts = docs.select(*_names(id_col, text_col), F.col(text_col).alias("t")).join(asked, ["k1", "k2"]).dropDuplicates(["row"])
        sets = staged(texts.select("row", "t").mapInPandas(_set_bytes(words), "row long, s binary"), "shingles", BATCH)
        held = pairs.join(sets.select(F.col("row").alias("u"), F.col("s").alias("p")), "u").join(sets.select(F.col("row").alias("v"), F.col("s").alias("q")), "v")
        out = staged(held.select("u", "v", exact("p", "q").alias("j")).where(F.col("j") >= similarity).select("u", "v"), "linked", BATCH)
        discard(sets)
        return out

    classes = staged(seen.groupBy("same").agg(F.min("row").alias("rep")), "classes")
    heads = seen.join(classes.select(F.col("rep").alias("row")), "row", "left_semi")
    close = linked(staged(_proposed(heads.select("row", "fp"), most_bits), "pairs", BATCH))
    closest = staged(connected_components(close).withColumnRenamed("node", "k"), "closest")
    by_shingle = Window.partitionBy("shingle")
    met = heads.select(F.col("row").alias("k"), F.explode("prefix").alias("shingle")).withColumn("c", F.count(F.lit(1)).over(by_shingle)).where("c > 1").drop("c")
    shared = staged(met, "shared")
    rated = shared.groupBy("k").agg(F.count(F.lit(1)).alias("m")).join(heads.select(F.col("row").alias("k"), "n", F.size("prefix").cast("long").alias("p")), "k")
    spots = staged(shared.join(rated, "k"), "spots")
    discard(shared)
    fits = lambda a, b: F.least(a, b) >= similarity * F.greatest(a, b) - 1e-9
    best = spots.groupBy("shingle").agg(F.max(F.struct((F.col("m") / F.col("p")).alias("rate"), "n", F.col("k").alias("lead"))).alias("best"))
    to_best = spots.join(best.select("shingle", "best.lead", F.col("best.n").alias("o")), "shingle").where((F.col("k") != F.col("lead")) & fits(F.col("n"), F.col("o")))
    led = closest.select(F.col("k").alias("lead"), F.col("component").alias("c2"))
    open_still = to_best.select("k", "lead").distinct().join(closest, "k", "left").join(led, "lead", "left").where("component IS NULL OR c2 IS NULL OR component <> c2")
    first = close.unionByName(linked(staged(open_still.select(F.least("k", "lead").alias("u"), F.greatest("k", "lead").alias("v")).distinct(), "pairs")))

    comp = connected_components(first)
    named = spots.join(comp.withColumnRenamed("node", "k"), "k", "left").select("shingle", "k", "n", "p", F.coalesce("component", "k").alias("c"))
    apart = named.withColumn("low", F.min("c").over(by_shingle)).withColumn("high", F.max("c").over(by_shingle)).where("low < high").drop("low", "high")
    apart = staged(apart.join(seen.select(F.col("row").alias("k"), *bits), "k"), "apart")
    discard(spots)
    held = ("k", "n", "p", "c", *bits)
    x, y = (apart.select("shingle", *[F.col(c).alias(f"{c}_{i}") for c in held]).withColumnsRenamed({f"{c}_{i}": f"{c}{i}" for c in held[:4]}) for i in (1, 2))
    differ = functools.reduce(operator.add, [F.bit_count(F.col(f"{b}_1").bitwiseXOR(F.col(f"{b}_2"))) for b in bits])
    near = fits(F.col("n1"), F.col("n2")) & (differ <= (1 - similarity) / (1 + similarity) * (F.col("n1") + F.col("n2")) + 1e-6)
    both = x.join(y, "shingle").where((F.col("k1") < F.col("k2")) & (F.col("c1") != F.col("c2")) & near)
    # What a pair shares is in both prefixes or in what follows one of them.
    need = similarity / (1 + similarity) * (F.col("n1") + F.col("n2")) - 1e-6 - F.greatest(F.col("n1") - F.col("p1"), F.col("n2") - F.col("p2"))
    enough = both.groupBy("k1", "k2", "n1", "n2", "p1", "p2").agg(F.count(F.lit(1)).alias("share")).where(F.col("share") >= need)
    rest = linked(staged(enough.select(F.col("k1").alias("u"), F.col("k2").alias("v")), "pairs"))
    comp = connected_components(first.unionByName(rest))
    groups = classes.join(comp, classes["rep"] == comp["node"], "left").select("same", F.coalesce("component", "rep").alias("group"))
    return seen.join(groups, "same").select("k1", "k2", "id", "group")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, similarity: float = 0.8) -> DataFrame:
    """docs without near copies: of each group the row with the smallest identifier, null last, is kept.

    Of rows equal in identifier and text one is kept. Texts without words are copies of each other.
    """
    groups = staged(near_groups(docs, id_col, text_col, words, similarity), "groups")
    key = ["k1", "k2"]
    best = groups.groupBy("group").agg(F.min(F.struct(F.col("id").isNull().alias("none"), "id", *key)).alias("best")).select("best.k1", "best.k2")
    again = groups.join(best, key, "left_semi").groupBy(*key).count().where("count > 1")
    one, two = (c.alias(n) for c, n in zip(_names(id_col, text_col), ("_k1", "_k2"), strict=True))
    marked = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("_row"), one, two)
    kept = marked.join(best.select(F.col("k1").alias("_k1"), F.col("k2").alias("_k2")), ["_k1", "_k2"], "left_semi")
    kept = kept.dropDuplicates(["_k1", "_k2"]) if again.limit(1).count() else kept
    return kept.select(*[F.col("_row")[c].alias(c) for c in docs.columns])


__all__ = ["anchors", "fingerprint", "fingerprints", "keep_one", "near_groups", "prefix", "simhash_groups"]
