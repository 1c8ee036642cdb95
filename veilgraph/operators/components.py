"""Connected components by alternating large-star and small-star steps."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilgraph.operators import cells
from veilgraph.plans.staging import discard, staged

#: Staged edges from which on those of each two colours are replaced by what they join.
MANY = 4_000_000


def _stars(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """(u, v): every node that the edges of two colours join to a lesser one, and the least that they join it to."""

    def joined(blocks: list) -> pd.DataFrame:
        a, b = (np.concatenate(x) for x in zip(*[cells.unpack(data, n) for n, data in blocks], strict=True))
        nodes = np.unique(np.concatenate([a, b]))
        a, b, label = np.searchsorted(nodes, a), np.searchsorted(nodes, b), np.arange(len(nodes))
        while len(a):
            np.minimum.at(label, np.maximum(a, b), np.minimum(a, b))
            while (label[label] != label).any():
                label = label[label]
            a, b = label[a], label[b]
            apart = a != b
            a, b = a[apart], b[apart]
        more = np.flatnonzero(label < np.arange(len(nodes)))
        return pd.DataFrame({"u": nodes[more], "v": nodes[label[more]]})

    now, held = None, []
    for part in parts:
        for group, n, data in part.itertuples(index=False):
            if held and group != now:
                yield joined(held)
                held = []
            now = group
            held.append((n, data))
    if held:
        yield joined(held)


def _thinned(links: DataFrame, rows: int) -> DataFrame:
    """Links (u, v) of integers that join the same nodes: edges of each two of p colours are met in a task, packed."""
    p = max(4, math.ceil(math.sqrt(2 * rows / cells.CELL)))
    kind = links.schema["u"].dataType
    edges = links.select(F.lit(cells.EDGE).alias("kind"), F.col("u").cast("long").alias("a"), F.col("v").cast("long").alias("b"))
    packed = edges.mapInPandas(cells._packed(p), "kind int, colours int, n int, data binary").select("colours", "n", "data")
    stars = packed.repartition(p * (p + 1), "colours").sortWithinPartitions("colours").mapInPandas(_stars, "u long, v long")
    return stars.select(*[F.col(c).cast(kind).alias(c) for c in "uv"])


def connected_components(edges: DataFrame, u: str = "u", v: str = "v", rounds: int = 100) -> DataFrame:
    """(node, component): the smallest node that each node of an edge can reach.

    Every step keeps one row an edge at most and aggregates before it joins, so a hub is a skewed join key
    that adaptive execution splits, never one group in a task. Null ends and self-loops link nothing; a node
    whose only edge is a self-loop is not returned. An empty table gives an empty result. Large staged tables of integers
    are thinned first, so that steps hold a few rows a node and not one an edge.
    """
    a, b = F.col(u), F.col(v)
    links = edges.where(a.isNotNull() & b.isNotNull() & (a != b)).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v"))
    rows = edges.count() if hasattr(edges, "_veilgraph_path") else 0
    if rows >= MANY and links.dtypes[0][1] in ("int", "bigint"):
        links = _thinned(links, rows)
    links = staged(links.distinct(), "links")
    for left in range(rounds, -1, -1):
        if not left:
            raise RuntimeError(f"components still change after {rounds} rounds")
        both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        floor = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(floor, "u").where("v > m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        new = staged(small.unionByName(floor.select("u", F.col("m").alias("v"))).distinct(), "links")
        moved = new.join(links, ["u", "v"], "left_anti").limit(1).count() or links.join(new, ["u", "v"], "left_anti").limit(1).count()
        discard(links)
        links = new
        if not moved:
            break
    return links.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(links.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
