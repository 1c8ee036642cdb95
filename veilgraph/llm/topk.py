"""Exact inner-product search: vectors by descending length, SVD-rotated partial sums, Cauchy-Schwarz bounds.

Components are quantised to floor(scale * x), so scores are integers. Vectors are packed into blocks by descending
length and queries into groups; blocks and groups meet in cells, a cell holding one group and streaming its blocks
longest first. A query is done with a block if the product of lengths cannot reach its threshold, and a pair if the
sum over the leading rotated components plus the product of what is left of the two lengths cannot. The rotation and
the first thresholds come from a bounded sample of the vectors; they decide how much is pruned, never what is found.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from veilgraph.plans.staging import discard, staged

#: Queries of a group (about), vectors of the sample, vectors of a block and rotated components summed first.
GROUP, SAMPLE, BLOCK, LEAD = 4096, 4096, 2048, 16
NONE = np.iinfo(np.int64).min
_TOP = np.iinfo(np.int64).max


def quantised(df: DataFrame, id_col: str, vec_col: str, scale: int) -> DataFrame:
    """(id, v, norm2) of the usable rows: v are the integers as doubles, norm2 their squared length."""
    x = F.col(vec_col).cast("array<double>")
    bad = F.exists(x, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    rows = df.where(F.col(id_col).isNotNull() & F.col(vec_col).isNotNull() & ~bad).select(F.col(id_col).cast("long").alias("id"), F.transform(x, lambda c: F.floor(c * scale).cast("double")).alias("v"))
    return rows.withColumn("norm2", F.aggregate("v", F.lit(0.0), lambda a, c: a + c * c))


def _matrix(vectors, width: int) -> np.ndarray:
    out = np.zeros((len(vectors), width))
    for i, v in enumerate(vectors):
        out[i, : len(v)] = v
    return out


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact a @ b.T of integers held as doubles, as longs; what no long holds becomes the nearest but NONE."""
    most = np.sqrt((a**2).sum(1).max(initial=0.0) * (b**2).sum(1).max(initial=0.0))
    if most < 1 << 52:
        return (a @ b.T).astype(np.int64)
    if most < 1 << 62:
        return a.astype(np.int64) @ b.astype(np.int64).T
    whole = np.vectorize(int, otypes=[object])
    return np.clip(whole(a) @ whole(b).T, NONE + 1, _TOP).astype(np.int64)


def best_of(scores: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k largest scores of each row and their ids, ties to smaller ids; ids ascend or are given a row each."""
    if ids.ndim == 1 and scores.shape[1] > k and np.abs(scores, where=scores > NONE, out=np.zeros_like(scores)).max(initial=0) < 1 << 50:
        ranked = np.where(scores > NONE, scores, -(1 << 50)) * BLOCK + np.arange(len(ids))[::-1]
        top = np.argpartition(-ranked, k - 1, axis=1)[:, :k]
        scores, ids = np.take_along_axis(scores, top, 1), ids[top]
    ids = np.broadcast_to(ids, scores.shape)
    order = np.lexsort((ids, ~scores), axis=1)[:, :k]
    return np.take_along_axis(scores, order, 1), np.take_along_axis(ids, order, 1)


def _bytes(x: np.ndarray) -> bytes:
    return np.ascontiguousarray(x).tobytes()


def _blocks(width: int, cells: int):
    """Vectors, longest first, as rows of up to BLOCK vectors dealt over the cells."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        n = TaskContext.get().partitionId()
        for part in parts:
            for s in range(0, len(part), BLOCK):
                p = part.iloc[s : s + BLOCK].sort_values("id", kind="stable")
                n += 1
                yield pd.DataFrame({"r": [n % cells], "kind": [1], "top": [float(np.sqrt(p["norm2"].max()))], "ids": [_bytes(p["id"].to_numpy(np.int64))], "v": [_bytes(_matrix(p["v"].to_numpy(), width))], "floor": [b""]})

    return run


def _groups(shared, width: int, k: int):
    """The queries of a partition as one row, with the k-th best score in the sample for each."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        every = list(parts)
        rows = pd.concat(every) if every else []
        if not len(rows):
            return
        sample_ids, sample, _ = shared.value
        ids, q = rows["id"].to_numpy(np.int64), _matrix(rows["v"].to_numpy(), width)
        floor = np.full(len(q), NONE)
        if len(sample) > k:
            scores = products(q, sample)
            scores[ids[:, None] == sample_ids[None, :]] = NONE
            floor = np.partition(scores, -k, axis=1)[:, -k]
        yield pd.DataFrame({"g": [TaskContext.get().partitionId()], "kind": [0], "top": [0.0], "ids": [_bytes(ids)], "v": [_bytes(q)], "floor": [_bytes(floor)]})

    return run


class _Cell:
    """A group of queries and the best that its cell has found for each."""

    def __init__(self, ids: np.ndarray, q: np.ndarray, floor: np.ndarray, turn: np.ndarray, k: int) -> None:
        self.ids, self.q, self.floor, self.turn, self.k = ids, q, floor, turn, k
        rotated = q @ turn
        self.lead, self.rest = np.ascontiguousarray(rotated[:, :LEAD]), np.sqrt((rotated[:, LEAD:] ** 2).sum(1))
        self.norm = np.sqrt((q**2).sum(1))
        self.best, self.owner = np.full((len(ids), k), NONE), np.full((len(ids), k), _TOP)

    def meet(self, ids: np.ndarray, v: np.ndarray, top: float) -> None:
        floor = np.maximum(self.floor, self.best[:, -1])
        low = np.where(floor > NONE, floor.astype(np.float64), -np.inf)
        slack = 1e-9 * self.norm * top + 1e-6
        open_q = np.flatnonzero(self.norm * top + slack >= low)
        if not len(open_q):
            return
        r = v @ self.turn
        bound = self.lead[open_q] @ r[:, :LEAD].T
        bound += self.rest[open_q, None] * np.sqrt((r[:, LEAD:] ** 2).sum(1))
        bound += (slack - low)[open_q, None]
        reach = bound >= 0
        rows, cols = reach.any(1), reach.any(0)
        if not rows.any():
            return
        open_q, ids, v, reach = open_q[rows], ids[cols], v[cols], reach[np.ix_(rows, cols)]
        scores = products(self.q[open_q], v)
        scores[~reach | (self.ids[open_q][:, None] == ids[None, :])] = NONE
        found, whose = best_of(scores, ids, self.k)
        self.best[open_q], self.owner[open_q] = best_of(np.concatenate([self.best[open_q], found], 1), np.concatenate([self.owner[open_q], whose], 1), self.k)

    def result(self) -> pd.DataFrame:
        i, j = np.nonzero((self.best > NONE) & (self.best >= self.floor[:, None]))
        return pd.DataFrame({"query_id": self.ids[i], "vec_id": self.owner[i, j], "score": self.best[i, j]})


def _search(shared, width: int, k: int):
    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, cell = None, None
        for part in parts:
            for row in part.itertuples(index=False):
                if (row.g, row.r) != at:
                    if cell is not None:
                        yield cell.result()
                    at, cell = (row.g, row.r), None
                ids, v = np.frombuffer(row.ids, np.int64), np.frombuffer(row.v).reshape(-1, width)
                if row.kind == 0:
                    cell = _Cell(ids, v, np.frombuffer(row.floor, np.int64), shared.value[2], k)
                elif cell is not None:
                    cell.meet(ids, v, row.top)
        if cell is not None:
            yield cell.result()

    return run


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 10, id_col: str = "vec_id", vec_col: str = "embedding", scale: int = 1024) -> DataFrame:
    """(query_id, rank, vec_id, score): each query's k largest inner products over all vectors, ties to smaller ids.

    Rows whose identifier or vector is null, or whose vector holds null or non-finite components, take no part;
    shorter vectors count as padded with zeros. A vector with the query's identifier is not its candidate;
    repeated candidates count each; of queries that share an identifier the least vector is used. Scores are exact;
    components and scores that no long holds count as the nearest that one does. Queries never pass the driver: they
    are dealt to groups of about GROUP, and every group meets all blocks of vectors in cells. Other columns are ignored.
    """
    spark = vectors.sparkSession
    n = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    usable, asked = quantised(vectors, id_col, vec_col, scale), quantised(queries, id_col, vec_col, scale)
    asked = staged(asked.groupBy("id").agg(F.min("v").alias("v")), "queries")
    count, wide = asked.agg(F.count(F.lit(1)), F.coalesce(F.max(F.size("v")), F.lit(1))).first()
    sample = usable.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.max(F.size("v")), F.lit(1)).alias("w")).first()
    width = max(1, wide, sample["w"])
    share = min(1.0, 2.0 * SAMPLE / max(1, sample["n"]))
    picked = usable.where(F.pmod(F.xxhash64("id"), F.lit(1 << 30)) < int(share * (1 << 30)) + 1).orderBy(F.xxhash64("id"), "v").limit(SAMPLE).select("id", "v").collect()
    sample_v = _matrix([r["v"] for r in picked], width)
    turn = np.linalg.svd(sample_v, full_matrices=True)[2].T if len(picked) else np.eye(width)
    shared = spark.sparkContext.broadcast((np.array([r["id"] for r in picked], np.int64), sample_v, turn))
    groups = max(1, -(-count // GROUP))
    cells = max(1, n // groups)
    longest = F.col("norm2").desc()
    placed = usable.repartitionByRange(n, longest, "id").sortWithinPartitions(longest, "id")
    blocks = placed.mapInPandas(_blocks(width, cells), "r int, kind int, top double, ids binary, v binary, floor binary")
    q = staged(asked.repartition(groups, "id").mapInPandas(_groups(shared, width, k), "g int, kind int, top double, ids binary, v binary, floor binary"), "groups")
    every = lambda c, m: F.explode(F.sequence(F.lit(0), F.lit(m - 1))).alias(c)
    met = q.select("g", every("r", cells), "kind", "top", "ids", "v", "floor").unionByName(blocks.select(every("g", groups), "r", "kind", "top", "ids", "v", "floor"))
    ordered = met.repartition(n, "g", "r").sortWithinPartitions("g", "r", "kind", F.col("top").desc())
    found = staged(ordered.mapInPandas(_search(shared, width, k), "query_id long, vec_id long, score long"), "found")
    discard(asked)
    discard(q)
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
