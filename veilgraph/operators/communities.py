"""Communities by modularity: rounds of moves of all nodes at once, then the same on the graph of communities."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilgraph.plans.staging import discard, staged
from veilgraph.sources.graphs import both_ways

#: Least rise of modularity that keeps a round, and rounds without one, each with other nodes, that end a level.
RISE, IDLE = 1e-4, 3


def modularity(edges: DataFrame, communities: DataFrame) -> DataFrame:
    """One row (communities, modularity) of communities (n, c): over them, the share of edges inside less the square of
    the share of edge ends; 0 without edges."""
    at = lambda side: communities.select(F.col("n").alias(side), F.col("c").alias(f"c{side}"))
    met = edges.select("u", "v").join(at("u"), "u").join(at("v"), "v")
    ends = met.select(F.explode(F.array(*[F.struct(F.col(f"c{s}").alias("c"), (F.col("cu") == F.col("cv")).cast("long").alias("x")) for s in "uv"])).alias("e"))
    parts = ends.groupBy(F.col("e.c").alias("c")).agg(F.sum("e.x").alias("inside"), F.count(F.lit(1)).alias("ends"))
    total = parts.agg(F.sum("ends").cast("double").alias("total"))
    share = F.sum(F.col("inside") / F.col("total") - (F.col("ends") / F.col("total")) * (F.col("ends") / F.col("total")))
    return parts.crossJoin(F.broadcast(total)).agg(F.count(F.lit(1)).alias("communities"), F.coalesce(share, F.lit(0.0)).alias("modularity"))  # total is one row


def _level(adj: DataFrame) -> tuple[DataFrame, float]:
    """((n, c), modularity) of a graph (n, m, w), both ways, a node's inner weight as (n, n).

    In a round, half of the nodes, by hash, may move to the neighbouring community where modularity gains most; the
    other half stays, so that two nodes seldom swap for ever. A round that lowers modularity is undone.
    """
    strength = staged(adj.groupBy("n").agg(F.sum("w").alias("k"), F.sum(F.when(F.col("n") == F.col("m"), F.col("w")).otherwise(0.0)).alias("self")), "strength")
    total = float(strength.agg(F.sum("k")).first()[0] or 0.0)
    links = staged(adj.where("n <> m"), "links")
    now = staged(strength.select("n", F.col("n").alias("c")), "communities")
    kept, best, idle, turn, moves = now, -2.0, 0, 0, None
    while total:
        tot = strength.join(now, "n").groupBy("c").agg(F.sum("k").alias("t"))
        to = links.join(now.select(F.col("n").alias("m"), "c"), "m").select("n", "c", "w").unionByName(now.select("n", "c", F.lit(0.0).alias("w")))
        near = to.groupBy("n", "c").agg(F.sum("w").alias("x")).join(tot, "c").join(strength, "n").join(now.select("n", F.col("c").alias("own")), "n")
        gain = F.col("x") - F.col("k") * (F.col("t") - F.when(F.col("c") == F.col("own"), F.col("k")).otherwise(0.0)) / total
        stay = F.max(F.when(F.col("c") == F.col("own"), F.struct(gain.alias("gain"), (F.col("x") + F.col("self")).alias("inside"), F.col("t").alias("t"), F.col("k").alias("k")))).alias("stay")
        picked = staged(near.groupBy("n", "own").agg(F.max(F.struct(gain.alias("gain"), (-F.col("c")).alias("c"))).alias("best"), stay), "moves")
        inside, squares = picked.agg(F.sum("stay.inside"), F.sum(F.col("stay.k") * F.col("stay.t"))).first()  # the sum over a community of k * t is t * t
        quality = inside / total - squares / total**2
        if quality > best + RISE:
            kept, best, idle, moves = now, quality, 0, picked
        else:
            idle += 1  # what is kept moves once more, by another half
        if idle > IDLE:
            break
        turn += 1
        free = (F.pmod(F.xxhash64(F.lit(turn), F.col("n")), F.lit(2)) == 0) & (F.col("best.gain") > F.col("stay.gain") + 1e-12)
        now = staged(moves.select("n", F.when(free, -F.col("best.c")).otherwise(F.col("own")).alias("c")), "communities")
    discard(links)
    return kept, best


def louvain(edges: DataFrame, levels: int = 20) -> DataFrame:
    """(n, c) of nodes with an edge: their community, known by its least node.

    Levels end when the graph of communities gains no modularity by merging any more.
    """
    adj = staged(both_ways(edges).select("n", "m", F.lit(1.0).alias("w")), "graph")
    of, best = None, -2.0
    for _ in range(levels):
        part, quality = _level(adj)
        if quality <= best + RISE:
            break
        best = quality
        of = part if of is None else staged(of.select(F.col("n").alias("node"), F.col("c").alias("n")).join(part, "n").select(F.col("node").alias("n"), "c"), "communities")
        at = lambda side, name: part.select(F.col("n").alias(side), F.col("c").alias(name))  # noqa: B023, E731
        adj = staged(adj.join(at("n", "a"), "n").join(at("m", "b"), "m").groupBy(F.col("a").alias("n"), F.col("b").alias("m")).agg(F.sum("w").alias("w")), "graph")
    if of is None:
        return edges.select(F.col("u").alias("n"), F.col("u").alias("c")).limit(0)
    return of.join(of.groupBy("c").agg(F.min("n").alias("least")), "c").select("n", F.col("least").alias("c"))
