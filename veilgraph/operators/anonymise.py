"""Set-at-a-time anonymisation: degree groups, templates that only add edges, and what they cost."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from veilgraph.operators.compare import ranked
from veilgraph.operators.structure import common_neighbours, degrees, edge_ends, ncc_distance, short_codes
from veilgraph.plans.staging import staged
from veilgraph.sources.graphs import both_ways

SEED = 42


def fixed_groups(edges: DataFrame, k: int) -> DataFrame:
    """(n, deg, pos, g): nodes by degree descending, short neighbourhood code and n, in groups of k; pos from 0 by n.

    A tail shorter than k joins the last whole group.
    """
    coded = degrees(edges).join(short_codes(edges), "n", "left")
    rows = ranked(coded, [F.col("deg").desc(), F.col("code"), F.col("n")])
    n = rows.agg(F.max("rank").alias("total"))
    g = F.least(F.floor((F.col("rank") - 1) / k), F.greatest(F.floor(F.col("total") / k) - 1, F.lit(0)))
    grouped = rows.crossJoin(F.broadcast(n)).select("n", "deg", g.cast("long").alias("g"))  # n is one row
    pos = F.row_number().over(Window.partitionBy("g").orderBy("n")) - 1  # groups have under 2k nodes
    return staged(grouped.select("n", "deg", pos.cast("long").alias("pos"), "g"), "groups")


def group_costs(groups: DataFrame) -> DataFrame:
    """(g, size, mean, median, cost_mean, cost_median, target): half-even centres and absolute deviations."""
    centre = groups.groupBy("g").agg(F.count(F.lit(1)).alias("size"), F.bround(F.avg("deg"), 0).cast("long").alias("mean"), F.bround(F.median("deg"), 0).cast("long").alias("median"))
    costs = groups.join(centre, "g").groupBy("g", "size", "mean", "median").agg(F.sum(F.abs(F.col("deg") - F.col("mean"))).alias("cost_mean"), F.sum(F.abs(F.col("deg") - F.col("median"))).alias("cost_median"))
    return costs.withColumn("target", F.when(F.col("cost_mean") < F.col("cost_median"), F.col("mean")).otherwise(F.col("median")))


def ring_template(edges: DataFrame, groups: DataFrame) -> DataFrame:
    """(u, v): new edges that join each group's nodes in a ring, to the next one (under six nodes) or two."""
    size = groups.groupBy("g").agg(F.count(F.lit(1)).alias("size"))
    steps = F.explode(F.sequence(F.lit(1), F.when(F.col("size") < 6, 1).otherwise(2))).alias("step")
    start = groups.join(size, "g").select("g", "n", "pos", "size", steps)
    goal = groups.select("g", F.col("pos").alias("to"), F.col("n").alias("m"))
    ring = start.withColumn("to", (F.col("pos") + F.col("step")) % F.col("size")).join(goal, ["g", "to"]).where("n <> m")
    return ring.select(F.least("n", "m").alias("u"), F.greatest("n", "m").alias("v")).distinct().join(edges, ["u", "v"], "left_anti")


def external_template(edges: DataFrame, groups: DataFrame) -> DataFrame:
    """(u, v): new edges from every node of a group to its commonest outside neighbours.

    As many as the half-even median of its nodes' outside neighbours, by (links descending, degree, id). All
    groups see the graph as it was, so the result does not depend on their order.
    """
    at = groups.select("n", "deg", "g")
    links = both_ways(edges).join(at.select("n", "g"), "n").join(at.select(F.col("n").alias("m"), F.col("deg").alias("m_deg"), F.col("g").alias("h")), "m").where("g <> h")
    counts = at.join(links.groupBy("n").agg(F.count(F.lit(1)).alias("outside")), "n", "left").select("g", F.coalesce("outside", F.lit(0)).alias("outside"))
    wanted = counts.groupBy("g").agg(F.bround(F.median("outside"), 0).cast("long").alias("wanted"))
    common = links.groupBy("g", "m", "m_deg").agg(F.count(F.lit(1)).alias("c"))
    order = Window.partitionBy("g").orderBy(F.col("c").desc(), "m_deg", "m")
    chosen = common.withColumn("r", F.row_number().over(order)).join(wanted, "g").where("r <= wanted").select("g", "m")
    pairs = chosen.join(at.select("g", "n"), "g").select(F.least("n", "m").alias("u"), F.greatest("n", "m").alias("v")).distinct()
    return pairs.join(edges, ["u", "v"], "left_anti")


def anchor_template(edges: DataFrame, groups: DataFrame, most: int = 3) -> DataFrame:
    """(u, v): new edges from every node of a group to its anchors, the `most` nodes of largest degree in it."""
    size = groups.groupBy("g").agg(F.count(F.lit(1)).alias("size"))
    order = Window.partitionBy("g").orderBy(F.col("deg").desc(), "n")
    anchors = groups.withColumn("r", F.row_number().over(order)).join(size, "g").where(F.col("r") <= F.least(F.lit(most), F.col("size") - 1)).select("g", F.col("n").alias("m"))
    pairs = groups.select("g", "n").join(anchors, "g").where("n <> m")
    return pairs.select(F.least("n", "m").alias("u"), F.greatest("n", "m").alias("v")).distinct().join(edges, ["u", "v"], "left_anti")


def clique_template(edges: DataFrame, groups: DataFrame) -> DataFrame:
    """(u, v): new edges that make each group a clique; groups have under 2k nodes, so pairs stay few."""
    a, b = groups.select("g", F.col("n").alias("u")), groups.select("g", F.col("n").alias("v"))
    return a.join(b, "g").where("u < v").select("u", "v").join(edges, ["u", "v"], "left_anti")


def group_profile(groups: DataFrame) -> DataFrame:
    """(g, size, low, high, median_degree): half-even median."""
    return groups.groupBy("g").agg(F.count(F.lit(1)).alias("size"), F.min("deg").alias("low"), F.max("deg").alias("high"), F.bround(F.median("deg"), 0).cast("long").alias("median_degree"))


def publish(edges: DataFrame, k: int) -> DataFrame:
    """(u, v) of the graph with both templates of groups of k added."""
    groups = fixed_groups(edges, k)
    return edges.select("u", "v").unionByName(ring_template(edges, groups)).unionByName(external_template(edges, groups)).distinct()


def edge_weights(edges: DataFrame, seed: int = SEED) -> DataFrame:
    """(u, v, w): a weight of 1 to 99 from the md5 of seed and ends, the same on every run."""
    h = F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(str(seed)), F.col("u").cast("string"), F.col("v").cast("string"))), 1, 8), 16, 10).cast("long")
    return edges.select("u", "v", (1 + h % 99).alias("w"))


def edge_significance(edges: DataFrame, last: bool = False) -> DataFrame:
    """(u, v, nc, common): the share of ends' neighbours that only one of them has, over twice the largest degree."""
    top = staged(degrees(edges).agg(F.max("deg").alias("top")), "top")
    c = F.col("common")
    met = edge_ends(edges, last).crossJoin(F.broadcast(top))  # top is one row
    return met.select("u", "v", ((F.col("du") + F.col("dv") - 2 * c) / (2.0 * F.col("top"))).alias("nc"), c)


def influence(edges: DataFrame) -> DataFrame:
    """(u, v, lci): collective influence in the line graph over the ball of two steps, an edge's own term left out.

    An edge's degree there is du + dv - 2; the ball of two steps holds the edges with an end next to u or v.
    """
    d = degrees(edges)
    e = edges.join(d.select(F.col("n").alias("u"), F.col("deg").alias("du")), "u").join(d.select(F.col("n").alias("v"), F.col("deg").alias("dv")), "v").withColumn("x", F.col("du") + F.col("dv") - 3)
    near = both_ways(edges).select("n", F.col("m").alias("c")).unionByName(d.select("n", F.col("n").alias("c"))).distinct()
    ends = edges.select("u", "v", F.explode(F.array("u", "v")).alias("n")).join(near, "n").select("u", "v", "c").distinct()
    inc = e.select(F.col("u").alias("p"), F.col("v").alias("q"), "x", F.explode(F.array("u", "v")).alias("c"))
    ball = ends.join(inc, "c").where("NOT (u = p AND v = q)").select("u", "v", "p", "q", "x").distinct().groupBy("u", "v").agg(F.sum("x").alias("s"))
    return e.join(ball, ["u", "v"], "left").select("u", "v", (F.col("x") * F.coalesce("s", F.lit(0))).cast("long").alias("lci"))


#: Edges that are brought in order at once.
ORDERED = 16_000_000


def by_significance(scored: DataFrame, score: str, size: int = 0) -> DataFrame:
    """(rank, u, v, score): edges from 1 by ascending score, ties by their ends; numbered over ranges of that order, which
    grow in number with `size`, the edges.

    More than ORDERED edges are numbered in up to eight slices of the order, one after another, so that only one of them
    is shuffled at once; give staged edges then, for each slice reads them.
    """
    rows, order = scored.select("u", "v", F.col(score).alias("score")), [F.col(c) for c in ("score", "u", "v")]
    slices = min(8, -(-size // ORDERED))
    if slices <= 1:
        return ranked(rows, order, size=size).select("rank", "u", "v", "score")
    cuts = sorted(set(rows.approxQuantile("score", [i / slices for i in range(1, slices)], 0.01)))
    slice_of = F.when(F.col("score").isNull(), 0).otherwise(sum((F.col("score") >= c).cast("int") for c in cuts) if cuts else F.lit(0))
    out, before = [], 0
    for i in range(len(cuts) + 1):
        part = ranked(rows.where(slice_of == i), order, size=-(-size // slices))
        out.append(part.select((F.col("rank") + before).alias("rank"), "u", "v", "score"))
        before += part.count()
    return reduce(DataFrame.unionByName, out)


def medoids(groups: DataFrame, vectors: DataFrame) -> DataFrame:
    """(g, medoid): of each group the node with the least mean code distance to the others, ties to larger degree, then n.

    Groups have under 2k nodes, so pairs stay few; vectors are (n, code, weight) as ncc_codes() gives them.
    """
    a, b = groups.select("g", F.col("n").alias("u"), "deg"), groups.select("g", F.col("n").alias("v"))
    pairs = a.join(b, "g").where("u <> v")
    apart = ncc_distance(vectors, pairs.select("u", "v"))
    means = a.join(apart.groupBy("u").agg(F.round(F.avg("distance"), 9).alias("d")), "u", "left")
    order = F.struct(F.coalesce("d", F.lit(0.0)).alias("d"), (-F.col("deg")).alias("k"), F.col("u").alias("n"))
    return means.groupBy("g").agg(F.min(order)["n"].alias("medoid"))


def profile_scores(groups: DataFrame, vectors: DataFrame, alpha: float = 0.5, beta: float = 0.5) -> DataFrame:
    """(g, n, score): a node's gap to its group's median degree, over the largest degree, and its code distance to the
    group's medoid, weighted."""
    top = groups.agg(F.greatest(F.max("deg").cast("double"), F.lit(1.0)).alias("top"))
    rows = groups.join(group_profile(groups).select("g", "median_degree"), "g").join(medoids(groups, vectors), "g").crossJoin(F.broadcast(top))  # top is one row
    apart = ncc_distance(vectors, rows.where("n <> medoid").select(F.col("n").alias("u"), F.col("medoid").alias("v"))).select(F.col("u").alias("n"), "distance")
    gap = F.abs(F.col("deg") - F.col("median_degree")) / F.col("top")
    return rows.join(apart, "n", "left").select("g", "n", (alpha * gap + beta * F.coalesce("distance", F.lit(0.0))).alias("score"))


def neighbour_scores(edges: DataFrame, groups: DataFrame) -> DataFrame:
    """(g, n, distance): 1 less the mean number of common neighbours with the group's other nodes, over the largest degree
    of the graph (1 at least) and at most 1; 0 for a node alone."""
    a, b = groups.select("g", F.col("n").alias("x")), groups.select("g", F.col("n").alias("y"))
    pairs = a.join(b, "g").where("x < y").select("g", F.col("x").alias("u"), F.col("y").alias("v"))
    met = pairs.join(common_neighbours(edges, pairs.select("u", "v")).select("u", "v", "common"), ["u", "v"], "left").withColumn("common", F.coalesce("common", F.lit(0)))
    top = degrees(edges).agg(F.greatest(F.coalesce(F.max("deg"), F.lit(1)).cast("double"), F.lit(1.0)).alias("top"))
    means = met.select(F.explode(F.array("u", "v")).alias("n"), "common").groupBy("n").agg(F.avg("common").alias("mean"))
    rows = groups.join(means, "n", "left").crossJoin(F.broadcast(top))  # top is one row
    return rows.select("g", "n", F.when(F.col("mean").isNull(), 0.0).otherwise(1.0 - F.least(F.col("mean") / F.col("top"), F.lit(1.0))).alias("distance"))


def community_scores(groups: DataFrame, communities: DataFrame) -> DataFrame:
    """(g, n, distance): 0 where a node is in the commonest community of its group's other nodes (ties to the smaller) or
    has none beside it, else the share of them that is in another one than the node; communities are (n, c)."""
    at = groups.select("g", "n").join(communities, "n", "left").withColumn("c", F.coalesce("c", F.lit(-1)))
    counts = at.groupBy("g", "c").agg(F.count(F.lit(1)).alias("k")).select("g", F.col("c").alias("other"), "k")
    met = at.join(counts, "g").withColumn("k", F.col("k") - (F.col("other") == F.col("c")).cast("long"))  # groups have under 2k nodes
    own = F.coalesce(F.max(F.when(F.col("other") == F.col("c"), F.col("k"))), F.lit(0))
    major = F.min(F.when(F.col("k") > 0, F.struct((-F.col("k")).alias("k"), "other")))["other"]
    each = met.groupBy("g", "n", "c").agg(own.alias("own"), F.sum("k").alias("others"), major.alias("major"))
    return each.select("g", "n", F.when((F.col("others") == 0) | (F.col("c") == F.col("major")), 0.0).otherwise((F.col("others") - F.col("own")) / F.col("others")).alias("distance"))


def cluster_costs(edges: DataFrame, groups: DataFrame, codes: DataFrame, communities: DataFrame, alpha: float = 1.0, beta: float = 0.2, gamma: float = 0.2, delta: float = 0.1) -> DataFrame:
    """(g, n, degree, code, neighbours, community, cost): how ill a node fits its group, and the weighted sum.

    degree: the mean gap to the others' degrees over the largest degree; code: the mean code distance to them; the other
    two as neighbour_scores() and community_scores() tell. A node alone has cost 0 but for its community.
    """
    top = groups.agg(F.greatest(F.max("deg").cast("double"), F.lit(1.0)).alias("top"))
    a, b = groups.select("g", F.col("n").alias("u"), F.col("deg").alias("du")), groups.select("g", F.col("n").alias("v"), F.col("deg").alias("dv"))
    pairs = a.join(b, "g").where("u <> v")  # groups have under 2k nodes
    apart = pairs.join(ncc_distance(codes, pairs.select("u", "v")), ["u", "v"])
    means = apart.groupBy(F.col("u").alias("n")).agg(F.avg(F.abs(F.col("du") - F.col("dv"))).alias("gap"), F.avg("distance").alias("code"))
    near = neighbour_scores(edges, groups).select("n", F.col("distance").alias("neighbours"))
    parts = community_scores(groups, communities).select("n", F.col("distance").alias("community"))
    rows = groups.join(means, "n", "left").join(near, "n").join(parts, "n").crossJoin(F.broadcast(top))  # top is one row
    some = rows.select("g", "n", (F.coalesce("gap", F.lit(0.0)) / F.col("top")).alias("degree"), F.coalesce("code", F.lit(0.0)).alias("code"), "neighbours", "community")
    return some.withColumn("cost", alpha * F.col("degree") + beta * F.col("code") + gamma * F.col("neighbours") + delta * F.col("community"))
