"""Core numbers by blocks of nodes that tell each other only what has changed.

A block holds the arcs of its nodes, packed once, and the last value that each of their neighbours told. A round hands
blocks what others changed, settles each of them, and sends the values that fell to the blocks with a neighbour of theirs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilgraph.operators.cells import colour, expand, gathered, pack, squeeze, unpack
from veilgraph.plans.staging import discard, staged

GRAPH, STATE, TOLD = 0, 1, 2
_ROW = "block int, kind int, n long, m long, data binary, more binary, links binary"
_COLUMNS = [c.split()[0] for c in _ROW.split(", ")]
#: Above the value of any node: what a neighbour has that told nothing yet.
_UNTOLD = np.int64(1) << 40


def _ordered(values: np.ndarray) -> np.ndarray:
    return np.diff(values, prepend=np.int64(0))


def _packed(blocks: int):
    """Of edges (u, v): their arcs as pieces (block, n, data) of the blocks of their first nodes."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in gathered(parts):
            u, v = (part[c].to_numpy(np.int64) for c in "uv")
            n, m = np.concatenate([u, v]), np.concatenate([v, u])
            block = colour(n, blocks)
            order = np.argsort(block, kind="stable")
            pieces = np.split(order, np.flatnonzero(np.diff(block[order])) + 1)
            yield pd.DataFrame([(int(block[p[0]]), len(p), pack(n[p], m[p])) for p in pieces], columns=["block", "n", "data"])

    return run


def _of_each_block(parts: Iterator[pd.DataFrame]) -> Iterator[tuple[int, list]]:
    """The rows of each block, which come one after another."""
    now, rows = None, []
    for part in parts:
        for row in part.itertuples(index=False):
            if rows and row.block != now:
                yield now, rows
                rows = []
            now = row.block
            rows.append(row)
    if rows:
        yield now, rows


def _adjacent(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """A row a block: its nodes, ascending, with how many arcs each has, all their neighbours, and the arcs by place among these."""
    for block, rows in _of_each_block(parts):
        a, b = (np.concatenate(x) for x in zip(*[unpack(r.data, r.n) for r in rows], strict=True))
        order = np.lexsort((b, a))
        nodes, size = np.unique(a, return_counts=True)
        near, at = np.unique(b[order], return_inverse=True)
        yield pd.DataFrame([(block, GRAPH, len(nodes), len(near), squeeze(_ordered(nodes), size), squeeze(_ordered(near)), squeeze(_ordered(at)))], columns=_COLUMNS)


def _arcs_of(some: np.ndarray, size: np.ndarray, first: np.ndarray) -> np.ndarray:
    """The places of the arcs of some nodes."""
    return np.repeat(first[some] - np.cumsum(size[some]) + size[some], size[some]) + np.arange(size[some].sum())


def _settle(core: np.ndarray, value: np.ndarray, size: np.ndarray, at: np.ndarray, nodes: np.ndarray, near: np.ndarray) -> None:
    """Lowers core and value until no node of the block has less than core neighbours whose value is core or more."""
    first, i = np.cumsum(size) - size, np.repeat(np.arange(len(nodes)), size)
    own = np.minimum(np.searchsorted(nodes, near), len(nodes) - 1)
    inner = np.flatnonzero(nodes[own] == near)
    while True:
        value[inner] = core[own[inner]]
        low = np.flatnonzero(np.bincount(i[value[at] >= core[i]], minlength=len(nodes)) < core)
        if not len(low):
            return
        arcs = _arcs_of(low, size, first)
        of, top = np.repeat(np.arange(len(low)), size[low]), core[low].max() + 1
        key = np.sort(of * top + (top - 1 - np.minimum(value[at[arcs]], core[low][of])))  # a node's values, the largest first
        start = np.cumsum(size[low]) - size[low]
        place = np.arange(len(key)) - np.repeat(start, size[low]) + 1
        core[low] = np.maximum.reduceat(np.minimum(top - 1 - key % top, place), start)


def _round(blocks: int):
    """Of each block's arcs, state and what it was told: its new state, and what it tells others."""

    def of(block: int, rows: list) -> Iterator[tuple]:
        graph = next(r for r in rows if r.kind == GRAPH)
        (gaps, size), near = expand(graph.data, 2, graph.n), np.cumsum(expand(graph.more, 1, graph.m)[0])
        nodes, at = np.cumsum(gaps), np.cumsum(expand(graph.links, 1, size.sum())[0])
        state = next((r for r in rows if r.kind == STATE), None)
        if state is None:
            core, value, changed = size, np.full(graph.m, _UNTOLD), np.arange(graph.n)
        else:
            core, value = expand(state.data, 2, graph.n)[1], expand(state.more, 1, graph.m)[0]
            before = core.copy()
            for told in rows:
                if told.kind == TOLD:
                    gaps, new = expand(told.data, 2, told.n)
                    value[np.searchsorted(near, np.cumsum(gaps))] = new
            _settle(core, value, size, at, nodes, near)
            changed = np.flatnonzero(core < before)
        yield block, STATE, graph.n, graph.m, squeeze(_ordered(nodes), core), squeeze(value), b""
        arcs = _arcs_of(changed, size, np.cumsum(size) - size)
        pairs = np.unique(colour(near, blocks)[at[arcs]] * graph.n + np.repeat(changed, size[changed]))
        to, who = np.divmod(pairs[pairs // graph.n != block], graph.n)
        for some in np.split(np.arange(len(to)), np.flatnonzero(np.diff(to)) + 1) if len(to) else ():
            w = who[some]
            yield int(to[some[0]]), TOLD, len(w), 0, squeeze(_ordered(nodes[w]), core[w]), b"", b""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for block, rows in _of_each_block(parts):
            yield pd.DataFrame(of(block, rows), columns=_COLUMNS)

    return run


def _listed(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """(n, core) of the states of blocks."""
    for part in parts:
        for row in part.itertuples(index=False):
            gaps, core = expand(row.data, 2, row.n)
            nodes = np.cumsum(gaps)
            for k in range(0, len(nodes), 1 << 16):
                yield pd.DataFrame({"n": nodes[k : k + (1 << 16)], "core": core[k : k + (1 << 16)]})


def settled(edges: DataFrame, arcs: int, rounds: int) -> DataFrame:
    """(n, core): a node's h-index over its neighbours' values, from degrees on, until nothing changes; nodes are integers.

    Blocks of nodes have some `arcs` arcs each. Values only fall, so that the order in which blocks settle does not matter.
    """
    kind, blocks = edges.schema["u"].dataType, max(1, -(-2 * edges.count() // arcs))
    by_block = lambda df: df.repartition(blocks, "block").sortWithinPartitions("block")
    pieces = edges.select(*[F.col(c).cast("long").alias(c) for c in "uv"]).mapInPandas(_packed(blocks), "block int, n long, data binary")
    graph = staged(by_block(pieces).mapInPandas(_adjacent, _ROW), "blocks")
    now = staged(by_block(graph).mapInPandas(_round(blocks), _ROW), "core")
    for _ in range(rounds):
        new = staged(by_block(graph.unionByName(now)).mapInPandas(_round(blocks), _ROW), "core")
        discard(now)
        now = new
        if not now.where(F.col("kind") == TOLD).limit(1).count():
            out = staged(now.where(F.col("kind") == STATE).mapInPandas(_listed, "n long, core long"), "core")
            discard(now)
            discard(graph)
            return out.select(F.col("n").cast(kind).alias("n"), "core")
    raise RuntimeError(f"core numbers still change after {rounds} rounds")
