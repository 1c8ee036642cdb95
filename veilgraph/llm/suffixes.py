"""Removal of repeated byte strings by deep-shallow suffix sorting.

A window is WIDTH bytes; a byte goes if a window over it also starts anywhere else. Equal texts are one class,
kept once with its number of copies. Every window is owned by its anchor, the place of its least 32-byte hash;
equal windows have equal anchors at equal offsets, so only windows whose anchor hash recurs can repeat. Runs of
windows with one anchor whose bytes are equal throughout repeat as a whole. The suffixes of the other runs are
sorted, cut at WIDTH bytes, bucket by bucket: by multikey quicksort on words to a shallow depth, then what is
still equal by blind tries, which look only at the words where strings part. Suffixes that stay together to the
end repeat. Runs of buckets too large for a task are cut into pieces of a few windows; equal pieces repeat, and the
windows of pieces that only share their core are counted by a digest of their bytes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veilgraph.llm.batches import slices
from veilgraph.plans.staging import discard, new_path, staged

WIDTH, GRAM, WORD = 200, 32, 8
PLACES = WIDTH - GRAM + 1
SHALLOW = 4
#: Distinct runs of a bucket that one task sorts, and suffixes that it sorts at a time.
BUCKET_RUNS, BATCH = 512, 100_000
#: Windows of a piece of a run in a bucket too large for that.
PIECE = 8
#: Places take 34 bits of an anchor's hash; a text has fewer bytes than that in Spark. Lengths take 31 bits of a key.
_LOW, _LENGTH = np.uint64((1 << 34) - 1), (1 << 31) - 1


def anchors(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hash, place, first, last): the anchors of data and the windows, by start, that each owns."""
    x = np.frombuffer(data, np.uint8)
    if len(x) < WIDTH:
        return (np.zeros(0, np.int64),) * 4
    h = (x.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    h ^= h >> np.uint64(31)
    for i, c in enumerate((0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0xD6E8FEB86659FD93, 0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53)):
        h = h[: -(1 << i)] * np.uint64(c) + h[1 << i :]
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(32)
    least = (h & ~_LOW) | np.arange(len(h), dtype=np.uint64)  # ties: the first place
    span = 1
    while 2 * span <= PLACES:
        least = np.minimum(least[:-span], least[span:])
        span *= 2
    least = np.minimum(least[: len(h) - PLACES + 1], least[PLACES - span :][: len(h) - PLACES + 1])
    at = (least & _LOW).astype(np.int64)
    first = np.flatnonzero(np.r_[True, at[1:] != at[:-1]])
    last = np.r_[first[1:], len(at)] - 1
    place = at[first]
    return h[place].view(np.int64), place, first, last


def _key(record, n: int) -> tuple[np.ndarray, np.ndarray]:
    return np.full(n, record.id, np.int64), np.full(n, record.n_bytes, np.int64)


def _each(parts: Iterator[pd.DataFrame], one, columns: list[str], rows: int = 50_000) -> Iterator[pd.DataFrame]:
    """Frames of the columns that one(record) gives as arrays."""
    held, size = [], 0
    for part in slices(parts):
        for record in part.itertuples(index=False):
            got = one(record)
            if len(got[0]):
                held.append(got)
                size += len(got[0])
            if size >= rows:
                yield pd.DataFrame({c: np.concatenate([g[i] for g in held]) for i, c in enumerate(columns)})
                held, size = [], 0
    if held:
        yield pd.DataFrame({c: np.concatenate([g[i] for g in held]) for i, c in enumerate(columns)})


def _anchor_rows(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    def one(r) -> tuple:
        h, place, first, last = anchors(r.data)
        return h, *_key(r, len(h)), place << 16 | (place - first) << 8 | (place - last)

    return _each(parts, one, ["hash", "id", "n_bytes", "packed"])


def _unpack(packed: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(place, first, last) of an anchor."""
    place = packed >> 16
    return place, place - (packed >> 8 & 255), place - (packed & 255)


def _contexts(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """A digest of the bytes of each run of windows, with where the anchor is in it."""

    def one(r) -> tuple:
        a = np.array([(x["hash"], x["packed"]) for x in r.runs], dtype=np.int64).reshape(-1, 2)
        place, first, last = _unpack(a[:, 1])
        digest = [xxhash.xxh3_128_digest(r.data[f : e + WIDTH] + b"%d" % (p - f)) for p, f, e in zip(place.tolist(), first.tolist(), last.tolist(), strict=True)]
        d = np.frombuffer(b"".join(digest), "<i8").reshape(-1, 2)
        return a[:, 0], d[:, 0], d[:, 1], *_key(r, len(a)), a[:, 1]

    return _each(parts, one, ["hash", "d1", "d2", "id", "n_bytes", "packed"])


def _runs(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The bytes of runs that are to be sorted."""
    for part in slices(parts):
        rows = [(x["hash"], r.id, r.n_bytes, x["packed"], x["whole"], r.data[f : e + WIDTH]) for r in part.itertuples(index=False) for x in r.runs for f, e in [map(int, _unpack(np.int64(x["packed"]))[1:])]]
        if rows:
            yield pd.DataFrame(rows, columns=["hash", "id", "n_bytes", "packed", "whole", "data"])


def _pieces(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Runs of oversized buckets cut into PIECE windows by the anchor's offset, with digests of each piece's bytes
    and of its core, the bytes that any window of such a piece holds."""

    def one(r) -> tuple:
        d, c, p, q, w = [], [], [], [], []
        for x in r.runs:
            place, first, last = map(int, _unpack(np.int64(x["packed"])))
            for cell in range((place - last) // PIECE, (place - first) // PIECE + 1):
                low, high = max(first, place - cell * PIECE - PIECE + 1), min(last, place - cell * PIECE)
                core = place - cell * PIECE
                d.append(xxhash.xxh3_128_digest(r.data[low : high + WIDTH] + b"%d" % (place - low)))
                c.append(xxhash.xxh3_128_digest(r.data[core : core + WIDTH - PIECE + 1] + b"%d" % cell))
                p.append(low)
                q.append(high)
                w.append(x["whole"])
        v, u = (np.frombuffer(b"".join(y), "<i8").reshape(-1, 2) for y in (d, c))
        return v[:, 0], v[:, 1], u[:, 0], u[:, 1], *_key(r, len(v)), np.array(p, np.int64), np.array(q, np.int64), np.array(w, bool)

    return _each(parts, one, ["d1", "d2", "c1", "c2", "id", "n_bytes", "p", "q", "whole"])


def _windows(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """A digest of each window of some pieces."""

    def one(r) -> tuple:
        spots = [(i, x["done"]) for x in r.runs for i in range(x["p"], x["q"] + 1)]
        v = np.frombuffer(b"".join([xxhash.xxh3_128_digest(r.data[i : i + WIDTH]) for i, _ in spots]), "<i8").reshape(-1, 2)
        return v[:, 0], v[:, 1], *_key(r, len(v)), np.array([i for i, _ in spots], np.int64), np.array([x for _, x in spots], bool)

    return _each(parts, one, ["d1", "d2", "id", "n_bytes", "p", "done"])


def equal_suffixes(data: np.ndarray, start: np.ndarray, group: np.ndarray) -> np.ndarray:
    """Whether another suffix of the group has the same first WIDTH bytes; data has WIDTH bytes after each start."""
    step = np.arange(WORD)
    found = np.zeros(len(start), bool)

    def word(rows: np.ndarray, k: int) -> np.ndarray:
        return data[start[rows, None] + (WORD * k + step)].view(">u8").ravel().astype(np.uint64)

    def split(rows: np.ndarray, g: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rows in the order of their group and word, grouped by both, without those then alone."""
        order = np.lexsort((w, g))
        rows, g, w = rows[order], g[order], w[order]
        head = np.r_[True, (g[1:] != g[:-1]) | (w[1:] != w[:-1])]
        g = np.cumsum(head) - 1
        many = np.bincount(g, minlength=1)[g] > 1
        return rows[many], g[many]

    rows, g = split(np.arange(len(start)), group, np.zeros(len(start), np.uint64))
    for k in range(SHALLOW):
        if not len(rows):
            return found
        rows, g = split(rows, g, word(rows, k))
    while len(rows):  # blind tries, all of them a branch deeper each time
        head = np.r_[True, g[1:] != g[:-1]]
        which = np.cumsum(head) - 1
        first = rows[head][which]
        parts_at = np.full(len(rows), WIDTH // WORD)
        for k in range(SHALLOW, WIDTH // WORD):
            open_rows = np.flatnonzero(parts_at == WIDTH // WORD)
            differ = open_rows[word(rows[open_rows], k) != word(first[open_rows], k)]
            parts_at[differ] = k
        branch = np.minimum.reduceat(parts_at, np.flatnonzero(head))[which]
        leaf = branch == WIDTH // WORD
        found[rows[leaf]] = True
        rows, g, branch = rows[~leaf], which[~leaf], branch[~leaf]
        if len(rows):
            w = data[start[rows, None] + (WORD * branch[:, None] + step)].view(">u8").ravel().astype(np.uint64)
            rows, g = split(rows, g, w)
    return found


def _sort_batch(rows: list[tuple]) -> list[tuple[int, int, int, int]]:
    """(id, n_bytes, start, end) of bytes to remove, for whole buckets of (hash, id, n_bytes, packed, whole, bytes)."""
    packed = np.array([r[3] for r in rows], np.int64)
    place, first, last = _unpack(packed)
    n = last - first + 1
    data = np.frombuffer(b"".join(r[5] for r in rows), np.uint8)
    base = np.cumsum([0, *(len(r[5]) for r in rows)])[:-1]
    which = np.repeat(np.arange(len(rows)), n)
    i = np.arange(len(which)) - np.repeat(np.cumsum(n) - n, n)
    bucket = np.unique(np.array([r[0] for r in rows], np.int64), return_inverse=True)[1]
    offset = place[which] - first[which] - i
    hit = equal_suffixes(data, base[which] + i, bucket[which] * 256 + offset)
    hit &= ~np.array([r[4] for r in rows], bool)[which]
    at = np.flatnonzero(hit)
    if not len(at):
        return []
    head = np.flatnonzero(np.r_[True, (np.diff(at) != 1) | (np.diff(which[at]) != 0)])
    tail = np.r_[head[1:], len(at)] - 1
    return [(*rows[which[at[h]]][1:3], int(first[which[at[h]]] + i[at[h]]), int(first[which[at[t]]] + i[at[t]]) + WIDTH) for h, t in zip(head, tail, strict=True)]


def _sort(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows come by hash; buckets are sorted together, some BATCH suffixes at a time."""
    held, size = [], 0

    def out(rows: list[tuple]) -> Iterator[pd.DataFrame]:
        found = _sort_batch(rows)
        if found:
            yield pd.DataFrame(found, columns=["id", "n_bytes", "start", "stop"])

    for part in parts:
        for row in part.itertuples(index=False, name=None):
            if size >= BATCH and held[-1][0] != row[0]:
                yield from out(held)
                held, size = [], 0
            held.append(row)
            size += len(row[5]) - WIDTH + 1
    if held:
        yield from out(held)


def _cut(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Bytes and runs removed from each class and the SHA-256 of what is left."""
    for part in slices(parts):
        rows = []
        for r in part.itertuples(index=False):
            kept, at, runs, gone = hashlib.sha256(), 0, 0, 0
            ends = -1
            for s, e in sorted((x["start"], x["stop"]) for x in (r.spans if r.spans is not None else ())):
                if s > ends:
                    kept.update(r.data[at:s])
                    runs += 1
                    gone += e - s
                    at = ends = e
                elif e > ends:
                    gone += e - ends
                    at = ends = e
            kept.update(r.data[at:])
            rows.append((r.id, r.n_bytes, gone, runs, kept.hexdigest()))
        yield pd.DataFrame(rows, columns=["id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])


def _bucketed(spark: SparkSession, df: DataFrame, n: int) -> tuple[DataFrame, str]:
    """df as a table under the shared folder, bucketed by id and n_bytes, and its name: joins on both move only the other side."""
    path = new_path(spark, "texts")
    name = path.rsplit("/", 1)[1].replace("-", "_")
    df.write.bucketBy(n, "id", "n_bytes").option("path", path).saveAsTable(name, format="parquet")
    out = spark.table(name)
    out._veilgraph_path = path
    return out, name


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256), one row a row of docs.

    Null and empty texts have no bytes and lose none; texts under WIDTH bytes lose none. Repeated rows are
    copies of each other; null identifiers stay null. Other columns are ignored. Texts are known by 92 bits of
    their SHA-256 and their length. The result is written; what led to it is deleted.
    """
    spark = docs.sparkSession
    n = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    data = F.coalesce(F.col(text_col), F.lit("")).cast("binary")
    rows = docs.select(F.col(id_col).alias("doc_id"), data.alias("data")).withColumn("id", F.conv(F.substring(F.sha2("data", 256), 1, 15), 16, 10).cast("long"))
    more = F.conv(F.substring(F.sha2("data", 256), 16, 8), 16, 10).cast("long")
    rows = rows.withColumn("n_bytes", more * (_LENGTH + 1) + F.octet_length("data"))
    size = F.col("n_bytes").bitwiseAND(F.lit(_LENGTH))
    key = ["id", "n_bytes"]
    copies = staged(rows.select("doc_id", *key), "copies")
    many = copies.groupBy(*key).agg(F.count(F.lit(1)).alias("copies"))
    texts, name = _bucketed(spark, rows.where(size >= WIDTH).groupBy(*key).agg(F.first("data").alias("data")), n)

    def runs_of(refs: DataFrame, *columns: str) -> DataFrame:
        return texts.join(refs.groupBy(*key).agg(F.collect_list(F.struct(*columns)).alias("runs")), key)

    known = texts.select("id", "n_bytes", "data")
    found = known.mapInPandas(_anchor_rows, "hash long, id long, n_bytes long, packed long")
    again = staged(found.groupBy("hash").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("hash"), "again")  # apart, so that a hot hash splits
    repeated = staged(found.join(again, "hash"), "repeated")
    contexts = staged(runs_of(repeated, "hash", "packed").mapInPandas(_contexts, "hash long, d1 long, d2 long, id long, n_bytes long, packed long"), "contexts")
    distinct = staged(contexts.groupBy("hash", "d1", "d2").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("id", "n_bytes", "packed")).alias("x")), "distinct")
    whole = contexts.join(distinct.where("n > 1").select("hash", "d1", "d2"), ["hash", "d1", "d2"]).select(*key, *_span(F.col("packed")))
    sizes = staged(distinct.groupBy("hash").agg(F.count(F.lit(1)).alias("m")).where("m > 1"), "sizes")
    mixed = staged(distinct.join(sizes, "hash").select("hash", "m", "x.*", (F.col("n") > 1).alias("whole")), "mixed")
    sortable = runs_of(mixed.where(F.col("m") <= BUCKET_RUNS), "hash", "packed", "whole").mapInPandas(_runs, "hash long, id long, n_bytes long, packed long, whole boolean, data binary")
    sort = sortable.repartition(n, "hash").sortWithinPartitions("hash").mapInPandas(_sort, "id long, n_bytes long, start long, stop long")
    big = runs_of(mixed.where(F.col("m") > BUCKET_RUNS), "hash", "packed", "whole")
    pieces = staged(big.mapInPandas(_pieces, "d1 long, d2 long, c1 long, c2 long, id long, n_bytes long, p long, q long, whole boolean"), "pieces")
    kinds = staged(pieces.groupBy("d1", "d2", "c1", "c2").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("id", "n_bytes", "p", "q")).alias("x"), F.max("whole").alias("whole")), "kinds")
    alike = pieces.where(~F.col("whole")).join(kinds.where("n > 1").select("d1", "d2"), ["d1", "d2"]).select(*key, F.col("p").alias("start"), (F.col("q") + WIDTH).alias("stop"))
    cores = kinds.groupBy("c1", "c2").agg(F.count(F.lit(1)).alias("k")).where("k > 1").select("c1", "c2")
    parted = kinds.join(cores, ["c1", "c2"]).select("x.*", ((F.col("n") > 1) | F.col("whole")).alias("done"))
    windows = runs_of(parted, "p", "q", "done").mapInPandas(_windows, "d1 long, d2 long, id long, n_bytes long, p long, done boolean")
    twice = windows.groupBy("d1", "d2").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("d1", "d2")
    large = alike.unionByName(windows.where(~F.col("done")).join(twice, ["d1", "d2"]).select(*key, F.col("p").alias("start"), (F.col("p") + WIDTH).alias("stop")))
    spans = whole.unionByName(sort).unionByName(large).groupBy(*key).agg(F.collect_list(F.struct("start", "stop")).alias("spans"))
    columns = "id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"
    cut = texts.join(spans, key, "left").select("id", "n_bytes", "data", "spans").mapInPandas(_cut, columns)
    classes = many.join(cut, key, "left")
    nothing, empty = F.lit(0).cast("long"), hashlib.sha256(b"").hexdigest()
    gone = (F.col("copies") > 1) & (size >= WIDTH)
    result = classes.select(
        *key, F.when(gone, size).otherwise(F.coalesce("n_removed", nothing)).alias("n_removed"), F.when(gone, 1).otherwise(F.coalesce("n_spans", nothing)).cast("long").alias("n_spans"),
        F.when(gone, F.lit(empty)).otherwise(F.col("kept_sha256")).alias("kept_sha256"),
    )
    short = rows.where(size < WIDTH).select("doc_id", size.alias("n_bytes"), nothing.alias("n_removed"), nothing.alias("n_spans"), F.sha2("data", 256).alias("kept_sha256"))
    long = copies.where(size >= WIDTH).join(result, key).select("doc_id", size.alias("n_bytes"), "n_removed", "n_spans", "kept_sha256")
    out = staged(long.unionByName(short), "removed")
    spark.sql(f"DROP TABLE {name}")
    for done in (texts, copies, again, repeated, contexts, distinct, sizes, mixed, pieces, kinds):
        discard(done)
    return out


def _span(packed):
    place = F.shiftright(packed, 16)
    return (place - F.shiftright(packed, 8).bitwiseAND(255)).alias("start"), (place - packed.bitwiseAND(255) + WIDTH).alias("stop")
