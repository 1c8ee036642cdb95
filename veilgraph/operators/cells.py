"""Triangles and common neighbours met in cells of three colours, so that no wedge is shuffled.

Nodes get one of p colours by hash, and a cell is a multiset of three colours. An edge goes to the p cells that hold
both of its colours, packed with others into blocks; a triangle then lies whole in the one cell of its three colours, and
its wedges are made and dropped there, a slice at a time. p grows with the square root of the edges, so that a cell
stays as large as it was; from five colours on cells are filled in passes, each with those of two or so of the cells that an
edge goes to, so that what lies on disk at once grows with the edges only. What a cell counts for its edges, or for pairs, leaves it as blocks too: every cell of two colours
holds their edges in the same order, so that only one of them sends the edges, and the others their counts in that order.
"""

from __future__ import annotations

import functools
import itertools
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilgraph.plans.staging import ROWS, discard, staged
from veilgraph.sources.graphs import both_ways

#: Edges of a cell, wedges that are made at once, rows that are packed at once on the way to cells, and on the way from them.
CELL, WEDGES, HELD, PART = 12_000_000, 1 << 21, 1 << 21, 1 << 19
EDGE, PAIR, DEGREE = 0, 1, 2


def colours(edges: int) -> int:
    """How many colours keep cells of three different ones under CELL edges; some for the sake of tasks."""
    return max(1, min(4, edges // 50_000), math.ceil(math.sqrt(6 * edges / CELL)))


def passes_of(p: int) -> int:
    """In how many passes the cells of p colours are filled, so that an edge goes to four of them at most at once."""
    return 1 if p <= 4 else -(-p // 2)


def colour(n: np.ndarray, p: int) -> np.ndarray:
    return ((n.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(33)) % np.uint64(p)).astype(np.int64)


def _cells(p: int) -> tuple[list[tuple], np.ndarray]:
    """The colours of each cell, and the cell of each three colours."""
    every, at = list(itertools.combinations_with_replacement(range(p), 3)), np.zeros((p, p, p), np.int64)
    for i, cell in enumerate(every):
        for x in itertools.permutations(cell):
            at[x] = i
    return every, at


def squeeze(*columns: np.ndarray) -> bytes:
    """Columns of 64 bits, by planes of bytes, compressed."""
    return pa.compress(np.stack(columns).view(np.uint8).reshape(len(columns), -1, 8).transpose(0, 2, 1).tobytes(), "zstd", asbytes=True)


def expand(data: bytes, columns: int, n: int) -> np.ndarray:
    raw = np.frombuffer(pa.decompress(data, 8 * columns * n, "zstd", asbytes=True), np.uint8).reshape(columns, 8, n)
    return np.ascontiguousarray(raw.transpose(0, 2, 1)).view(np.int64)[:, :, 0]


def pack(a: np.ndarray, b: np.ndarray) -> bytes:
    """Rows of two longs in order, as gaps."""
    order = np.lexsort((b, a))
    return squeeze(np.diff(a[order], prepend=np.int64(0)), b[order] - a[order])


def unpack(data: bytes, n: int) -> tuple[np.ndarray, np.ndarray]:
    gaps, above = expand(data, 2, n)
    a = np.cumsum(gaps)
    return a, a + above


def gathered(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The rows of parts, HELD and more at a time."""
    held, size = [], 0
    for part in parts:
        held.append(part)
        size += len(part)
        if size >= HELD:
            yield pd.concat(held)
            held, size = [], 0
    if size:
        yield pd.concat(held)


def _packed(p: int):
    """Of rows (kind, a, b): blocks (kind, colours, n, data) of the rows of each one or two colours."""

    def blocks(held: pd.DataFrame) -> pd.DataFrame:
        kind, a, b = (held[c].to_numpy(np.int64) for c in ("kind", "a", "b"))
        i, j = colour(a, p), colour(b, p)
        group = (kind * p + np.minimum(i, j)) * p + np.maximum(i, j)
        group = np.where(kind == DEGREE, (kind * p + i) * p, group)
        order = np.argsort(group, kind="stable")
        out = []
        for rows in np.split(order, np.flatnonzero(np.diff(group[order])) + 1):
            k, g = divmod(int(group[rows[0]]), p * p)
            out.append((k, g, len(rows), pack(a[rows], b[rows])))
        return pd.DataFrame(out, columns=["kind", "colours", "n", "data"])

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for held in gathered(parts):
            yield blocks(held)

    return run


def _passes(p: int, passes: int) -> np.ndarray:
    """The pass of each cell. Every two colours have a cell in each pass, and two passes have none in common."""
    return np.array([sum(cell) for cell in _cells(p)[0]]) % passes


def _dealt(p: int, passes: int, now: int):
    """Of packed blocks: a copy (cell, kind, n, data) for every cell of this pass that needs it."""
    at, when = _cells(p)[1], _passes(p, passes)

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            out = []
            for kind, g, n, data in part.itertuples(index=False):
                cells = np.unique(at[g // p] if kind == DEGREE else at[g // p, g % p])
                out += [(cell, kind, n, data) for cell in cells[when[cells] == now].tolist()]
            yield pd.DataFrame(out, columns=["cell", "kind", "n", "data"])

    return run


class _Cell:
    """The edges of a cell by local number, ascending, with a table of bits that most other pairs miss."""

    def __init__(self, p: int, cell: tuple, u: np.ndarray, v: np.ndarray) -> None:
        self.nodes = np.unique(np.concatenate([u, v]))
        self.n, self.cell = len(self.nodes), np.array(cell)
        self.colour = colour(self.nodes, p)
        self.keys = np.sort(np.searchsorted(self.nodes, u) * self.n + np.searchsorted(self.nodes, v))
        size = 1 << max(16, (8 * len(self.keys)).bit_length())
        s, t = np.divmod(self.keys, max(self.n, 1))
        wide = 1 << np.ceil(np.log2(np.clip(8 * np.bincount(s, minlength=self.n), 1024, size // 2))).astype(np.int64)
        self.mask = wide - 1
        self.base = (np.arange(self.n).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - size.bit_length() + 1)).astype(np.int64) % (size - wide)
        self.table = np.zeros(size, bool)
        self.table[self.spot(s, t)] = True

    def spot(self, s: np.ndarray, t: np.ndarray) -> np.ndarray:
        """Where the bit of a pair is: those of a lesser node lie near each other, for they are asked one after another."""
        return self.base[s] + (t & self.mask[s])

    def meet(self, a: np.ndarray, b: np.ndarray, first: np.ndarray, count: np.ndarray, others: np.ndarray) -> Iterator[tuple]:
        """(row, place among others, edge): of each row (a, b) those of its `count` others from `first` on that are next to b,
        and with a and b have the colours of the cell."""
        ends = np.cumsum(count)
        start = 0
        while start < len(a):
            base = ends[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(ends, base + WEDGES, "right")))
            some = count[start:stop]
            row = np.repeat(np.arange(start, stop), some)
            place = np.arange(len(row)) + np.repeat(first[start:stop] - (ends[start:stop] - some - base), some)
            x, y = b[row], others[place]
            x, y = np.minimum(x, y), np.maximum(x, y)
            hit = np.flatnonzero(self.table[self.spot(x, y)])
            row, place, key = row[hit], place[hit], x[hit] * self.n + y[hit]
            edge = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            of = np.sort(np.stack([self.colour[a[row]], self.colour[b[row]], self.colour[others[place]]], axis=1), axis=1)
            hit = (self.keys[edge] == key) & (of == self.cell).all(axis=1)
            yield row[hit], place[hit], edge[hit]
            start = stop

    def wedges(self) -> tuple:
        """The edges (a, b) from the end of lesser (degree, number), by a and b, and which edge each is."""
        s, t = np.divmod(self.keys, self.n)
        deg = np.bincount(s, minlength=self.n) + np.bincount(t, minlength=self.n)
        up = deg[s] <= deg[t]
        a, b = np.where(up, s, t), np.where(up, t, s)
        order = np.lexsort((b, a))
        a, b = a[order], b[order]
        here = np.arange(len(a))
        return a, b, here + 1, np.searchsorted(a, a, "right") - here - 1, order

    def triangles(self) -> Iterator[tuple]:
        a, b, first, count, edge = self.wedges()
        for row, place, third in self.meet(a, b, first, count, b):
            yield a[row], b[row], b[place], edge[row], edge[place], third

    def common(self, x: np.ndarray, y: np.ndarray) -> Iterator[tuple]:
        """(pair, third node) of pairs of nodes with a common neighbour."""
        s, t = np.divmod(self.keys, self.n)
        a, b = np.concatenate([s, t]), np.concatenate([t, s])
        order = np.argsort(a, kind="stable")
        b, ptr = b[order], np.searchsorted(a[order], np.arange(self.n + 1))
        where = [np.minimum(np.searchsorted(self.nodes, z), self.n - 1) for z in (x, y)]
        known = np.flatnonzero((self.nodes[where[0]] == x) & (self.nodes[where[1]] == y))
        x, y = where[0][known], where[1][known]
        swap = ptr[x + 1] - ptr[x] > ptr[y + 1] - ptr[y]
        x, y = np.where(swap, y, x), np.where(swap, x, y)
        for row, place, _ in self.meet(x, y, ptr[x], ptr[x + 1] - ptr[x], b):
            yield known[row], b[place]


def _loaded(p: int, what):
    """Runs what(cell, pairs, degrees) on each cell; a partition holds its cells one after another."""
    every = _cells(p)[0]

    def of(at: int, got: dict) -> Iterator[pd.DataFrame]:
        full = {k: tuple(np.concatenate(x) for x in zip(*got[k], strict=True)) if got[k] else (np.zeros(0, np.int64),) * 2 for k in got}
        if len(full[EDGE][0]) or len(full[PAIR][0]):
            yield from what(_Cell(p, every[at], *full[EDGE]), full[PAIR], full[DEGREE])

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, got = None, {}
        for part in parts:
            for cell, kind, n, data in part.itertuples(index=False):
                if cell != now:
                    if now is not None:
                        yield from of(now, got)
                    now, got = cell, {EDGE: [], PAIR: [], DEGREE: []}
                got[kind].append(unpack(data, n))
        if now is not None:
            yield from of(now, got)

    return run


def _in_cells(edges: DataFrame, rows: DataFrame, made, columns: str, at_once: bool = False, last: bool = False) -> DataFrame | list[DataFrame]:
    """What made(p, passes) makes of each cell of p colours: at once, or a list of what each pass staged, its shuffles dropped.

    Passes read packed edges; the staged edges are deleted before, if this is the `last` step that reads them.
    """
    p = colours(edges.count())
    passes = 1 if at_once else passes_of(p)
    packed = rows.mapInPandas(_packed(p), "kind int, colours int, n int, data binary")
    if passes > 1:
        packed = staged(packed, "packed")
        if last:
            discard(edges)
    out = []
    for now in range(passes):
        blocks = packed.mapInPandas(_dealt(p, passes, now), "cell int, kind int, n int, data binary")
        tasks = len(_cells(p)[0]) if passes == 1 else 2 * int((_passes(p, passes) == now).sum())
        found = blocks.repartition(tasks, "cell").sortWithinPartitions("cell").mapInPandas(_loaded(p, made(p, passes)), columns)
        out.append(staged(found, "counts") if passes > 1 else found)
    if passes == 1:
        return out[0]
    discard(packed)
    return out


def _rows(edges: DataFrame) -> DataFrame:
    return edges.select(F.lit(EDGE).alias("kind"), F.col("u").cast("long").alias("a"), F.col("v").cast("long").alias("b"))


def _listed(cell: _Cell, pairs: tuple, degrees: tuple) -> Iterator[pd.DataFrame]:
    for a, b, c, *_ in cell.triangles():
        yield pd.DataFrame({"x": cell.nodes[a], "y": cell.nodes[b], "z": cell.nodes[c]})


def _node_counts(parts: int):
    """Of each cell blocks (part, n, data) of its nodes that are in a triangle, ascending, and in how many."""

    def run(cell: _Cell, pairs: tuple, degrees: tuple) -> Iterator[pd.DataFrame]:
        count = np.zeros(cell.n, np.int64)
        for a, b, c, *_ in cell.triangles():
            for x in (a, b, c):
                count += np.bincount(x, minlength=cell.n)
        hit = np.flatnonzero(count)
        part = colour(cell.nodes[hit], parts)
        order = np.argsort(part, kind="stable")
        out = []
        for rows in np.split(order, np.flatnonzero(np.diff(part[order])) + 1) if len(order) else ():
            out.append((int(part[rows[0]]), len(rows), squeeze(np.diff(cell.nodes[hit[rows]], prepend=np.int64(0)), count[hit[rows]])))
        if out:
            yield pd.DataFrame(out, columns=["part", "n", "data"])

    return run


def _node_sums(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """(n, t): the nodes of each part with the sum of their counts; a part's blocks come one after another."""

    def summed(blocks: list[np.ndarray]) -> pd.DataFrame:
        nodes, counts = (np.concatenate(x) for x in zip(*blocks, strict=True))
        order = np.argsort(nodes, kind="stable")
        first = np.flatnonzero(np.r_[True, np.diff(nodes[order]) != 0])
        return pd.DataFrame({"n": nodes[order][first], "t": np.add.reduceat(counts[order], first)})

    now, held = None, []
    for some in parts:
        for part, n, data in some.itertuples(index=False):
            if part != now and held:
                yield summed(held)
                held = []
            now = part
            gaps, counts = expand(data, 2, n)
            held.append((np.cumsum(gaps), counts))
    if held:
        yield summed(held)


def _degrees(cell: _Cell, nodes: np.ndarray, degrees: tuple) -> np.ndarray:
    """The degrees of nodes, 0 where none is told."""
    if not len(degrees[0]):
        return np.zeros(len(nodes), np.int64)
    order = np.argsort(degrees[0])
    at = order[np.minimum(np.searchsorted(degrees[0], nodes, sorter=order), len(order) - 1)]
    return np.where(degrees[0][at] == nodes, degrees[1][at], 0)


def _sent(p: int, passes: int, cell: _Cell, a: np.ndarray, b: np.ndarray, common: np.ndarray, sums: np.ndarray, degrees: tuple) -> Iterator[pd.DataFrame]:
    """Of rows (a, b), in the order that every cell of their colours has them: blocks (part, n, data, told) of each two
    colours, with the rows and their degrees from the first cell of these in the last pass, else with counts, and sums by
    number of `told`."""
    i, j = colour(a, p), colour(b, p)
    group, at, when = np.minimum(i, j) * p + np.maximum(i, j), _cells(p)[1], _passes(p, passes)
    for g in np.unique(group).tolist():
        rows, out = np.flatnonzero(group == g), []
        every = at[g // p, g % p]
        first = every[when[every] == passes - 1].min() == at[tuple(cell.cell)]
        for k, some in enumerate(np.split(rows, range(PART, len(rows), PART))):
            x, y = a[some], b[some]
            if first:
                out.append((g + p * p * k, len(some), pack(x, y), squeeze(_degrees(cell, x, degrees), _degrees(cell, y, degrees)), True))
            if common[some].any():
                names, number = np.unique(sums[some], return_inverse=True)
                out.append((g + p * p * k, len(some), squeeze(common[some], number.astype(np.int64)), squeeze(names), False))
        if out:
            yield pd.DataFrame(out, columns=["part", "n", "data", "told", "rows"])


def _weights(cell: _Cell, degrees: tuple) -> np.ndarray:
    deg = _degrees(cell, cell.nodes, degrees)
    return np.where(deg > 1, 1 / np.log(np.maximum(deg, 2)), 0.0)


def _edge_sums(p: int, passes: int):
    def run(cell: _Cell, pairs: tuple, degrees: tuple) -> Iterator[pd.DataFrame]:
        common, sums, w = np.zeros(len(cell.keys), np.int64), np.zeros(len(cell.keys)), _weights(cell, degrees)
        for a, b, c, ab, ac, bc in cell.triangles():
            for side, third in ((ab, c), (ac, b), (bc, a)):
                np.add.at(common, side, 1)
                np.add.at(sums, side, w[third])
        s, t = np.divmod(cell.keys, max(cell.n, 1))
        yield from _sent(p, passes, cell, cell.nodes[s], cell.nodes[t], common, sums, degrees)

    return run


def _pair_sums(p: int, passes: int):
    def run(cell: _Cell, pairs: tuple, degrees: tuple) -> Iterator[pd.DataFrame]:
        order = np.lexsort(pairs[::-1])
        x, y = (z[order] for z in pairs)
        new = np.r_[True, (np.diff(x) != 0) | (np.diff(y) != 0)][: len(x)]
        x, y = x[new], y[new]
        common, sums, w = np.zeros(len(x), np.int64), np.zeros(len(x)), _weights(cell, degrees)
        for row, third in cell.common(x, y) if cell.n else ():
            np.add.at(common, row, 1)
            np.add.at(sums, row, w[third])
        yield from _sent(p, passes, cell, x, y, common, sums, degrees)

    return run


def _added(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The rows of each part with what all cells counted for them; a part's blocks come one after another."""
    now, out = None, {}
    for some in parts:
        for part, n, data, told, rows in some.itertuples(index=False):
            if part != now:
                if now is not None:
                    yield pd.DataFrame(out)
                now, out = part, {"common": np.zeros(n, np.int64), "adamic_adar": np.zeros(n)}
            if rows:
                out |= dict(zip("uv", unpack(data, n), strict=True)) | dict(zip(("du", "dv"), expand(told, 2, n), strict=True))
            else:
                common, number = expand(data, 2, n)
                out["common"] += common
                out["adamic_adar"] += expand(told, 1, number.max() + 1)[0].view(np.float64)[number]
    if now is not None:
        yield pd.DataFrame(out)


def triangles(edges: DataFrame) -> DataFrame:
    """(x, y, z): each triangle once."""
    return _in_cells(edges, _rows(edges), lambda *_: _listed, "x long, y long, z long", at_once=True)


def node_triangles(edges: DataFrame) -> DataFrame:
    """(n, t): nodes in a triangle and in how many; cells count them and send blocks of nodes, never triangles."""
    n = max(int(edges.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-edges.count() // ROWS))
    blocks = _in_cells(edges, _rows(edges), lambda *_: _node_counts(n), "part long, n int, data binary")
    if isinstance(blocks, list):
        blocks = functools.reduce(DataFrame.unionByName, blocks)
    return blocks.repartition(n, "part").sortWithinPartitions("part").mapInPandas(_node_sums, "n long, t long")


#: What common_sums() tells of each pair.
SUMS = ("u", "v", "common", "adamic_adar", "du", "dv")


def common_sums(edges: DataFrame, pairs: DataFrame | None = None, degrees: bool = True, columns: tuple[str, ...] = SUMS, last: bool = False) -> DataFrame:
    """(u, v, common, adamic_adar, du, dv) of each pair (u, v), or of each edge: its common neighbours and its ends' degrees.

    Degrees go to the cells of their node's colour; without them adamic_adar, du and dv are 0. Where cells are filled in
    passes, what they counted is added up some parts at a time, only `columns` of the sums are kept, and the staged edges may
    go if nothing reads them after this `last` step.
    """
    rows, size = _rows(edges), (edges if pairs is None else pairs).count()
    if pairs is not None:
        rows = rows.unionByName(_rows(pairs).withColumn("kind", F.lit(PAIR)))
    if degrees:
        rows = rows.unionByName(both_ways(edges).groupBy("n").agg(F.count(F.lit(1)).alias("b")).select(F.lit(DEGREE).alias("kind"), F.col("n").cast("long").alias("a"), "b"))
    what = _edge_sums if pairs is None else _pair_sums
    counts = _in_cells(edges, rows, what, "part long, n int, data binary, told binary, rows boolean", last=last)
    n = max(int(edges.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-size // ROWS))
    added = lambda of: of.repartition(n, "part").sortWithinPartitions("part").mapInPandas(_added, "u long, v long, common long, adamic_adar double, du long, dv long").select(*columns)
    if not isinstance(counts, list):
        return added(counts)
    every = functools.reduce(DataFrame.unionByName, counts)
    slices = min(4, len(counts))
    out = [staged(added(every.where(F.pmod(F.xxhash64("part"), F.lit(slices)) == i)), "sums") for i in range(slices)]
    for x in counts:
        discard(x)
    return functools.reduce(DataFrame.unionByName, out)
