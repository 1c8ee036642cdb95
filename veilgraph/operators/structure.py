"""Structural measures of nodes and graphs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilgraph.operators import cells, cores
from veilgraph.plans.staging import discard, staged
from veilgraph.sources.graphs import both_ways, nodes_of


def degrees(edges: DataFrame, nodes: DataFrame | None = None) -> DataFrame:
    """(n, deg); with nodes, those without an edge have 0."""
    found = both_ways(edges).groupBy("n").agg(F.count(F.lit(1)).alias("deg"))
    return found if nodes is None else nodes.join(found, "n", "left").select("n", F.coalesce("deg", F.lit(0)).cast("long").alias("deg"))


def graph_stats(edges: DataFrame, nodes: DataFrame | None = None) -> DataFrame:
    """One row (nodes, edges, density, mean_degree, max_degree)."""
    d = degrees(edges, nodes if nodes is not None else nodes_of(edges))
    row = d.agg(F.count(F.lit(1)).alias("nodes"), (F.coalesce(F.sum("deg"), F.lit(0)) / 2).cast("long").alias("edges"), F.coalesce(F.max("deg"), F.lit(0)).alias("max_degree"))
    n, m = F.col("nodes").cast("double"), F.col("edges").cast("double")
    return row.select("nodes", "edges", F.when(n > 1, 2 * m / (n * (n - 1))).otherwise(0.0).alias("density"), F.when(n > 0, 2 * m / n).otherwise(0.0).alias("mean_degree"), "max_degree")


def triangles(edges: DataFrame) -> DataFrame:
    """(x, y, z): each triangle once, found in cells that keep its wedges to themselves; nodes are integers."""
    return cells.triangles(edges)


def clustering(edges: DataFrame, nodes: DataFrame | None = None) -> DataFrame:
    """(n, deg, triangles, clustering); 0 below degree 2."""
    d = degrees(edges, nodes).join(cells.node_triangles(edges), "n", "left").select("n", "deg", F.coalesce("t", F.lit(0)).cast("long").alias("triangles"))
    return d.withColumn("clustering", F.when(F.col("deg") > 1, 2.0 * F.col("triangles") / (F.col("deg") * (F.col("deg") - 1))).otherwise(0.0))


def neighbour_degree(edges: DataFrame) -> DataFrame:
    """(n, avg_neighbour_degree) of nodes with an edge."""
    d = degrees(edges).select(F.col("n").alias("m"), "deg")
    return both_ways(edges).join(d, "m").groupBy("n").agg(F.avg("deg").alias("avg_neighbour_degree"))


def common_neighbours(edges: DataFrame, pairs: DataFrame | None = None, last: bool = False) -> DataFrame:
    """(u, v, common, adamic_adar) of pairs with a common neighbour: the given ones, or all.

    Given pairs are met with the neighbours of the end with fewer of them, in cells, so that no wedge is shuffled.
    """
    if pairs is not None:
        return _met(cells.common_sums(edges, pairs, columns=_SCORED, last=last))
    deg = degrees(edges)
    weight = deg.select(F.col("n").alias("w"), F.when(F.col("deg") > 1, 1 / F.log("deg")).otherwise(0.0).alias("weight"))
    s = both_ways(edges)
    met = s.select(F.col("m").alias("u"), F.col("n").alias("w")).join(s.select(F.col("m").alias("v"), F.col("n").alias("w")), "w").where("u < v")
    return met.join(weight, "w").groupBy("u", "v").agg(F.count(F.lit(1)).alias("common"), F.sum("weight").alias("adamic_adar"))


_SCORED = ("u", "v", "common", "adamic_adar")


def _met(sums: DataFrame) -> DataFrame:
    return sums.where("common > 0").select(*_SCORED)


def edge_triangles(edges: DataFrame) -> DataFrame:
    """(u, v, common) of edges in a triangle: how many of them."""
    return cells.common_sums(edges, degrees=False, columns=("u", "v", "common")).where("common > 0")


def edge_ends(edges: DataFrame, last: bool = False) -> DataFrame:
    """(u, v, common, du, dv): every edge with its triangles and the degrees of its ends, told where the triangles are found."""
    kind = edges.schema["u"].dataType
    return cells.common_sums(edges, columns=("u", "v", "common", "du", "dv"), last=last).select(F.col("u").cast(kind).alias("u"), F.col("v").cast(kind).alias("v"), "common", "du", "dv")


def edge_common_neighbours(edges: DataFrame, last: bool = False) -> DataFrame:
    """As common_neighbours() for the edges themselves: their common neighbours are their triangles' third nodes."""
    return _met(cells.common_sums(edges, columns=_SCORED, last=last))


#: Arcs of a block of nodes that core numbers settle at once, some 100 bytes each.
BLOCK = 4_000_000


def core_numbers(edges: DataFrame, rounds: int = 500) -> DataFrame:
    """(n, core) of every node, settled a block of nodes at a time; nodes are integers."""
    return cores.settled(edges, BLOCK, rounds)


def ego_graphs(edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """((ego, p, c), (ego, p, q)): each node's neighbours with their component, known by its least node, and, both ways,
    the edges among them.

    The edges among a node's neighbours are its triangles; labels spread along them for all egos at once.
    """
    t = triangles(edges)
    rows = [("x", "y", "z"), ("y", "x", "z"), ("z", "x", "y")]
    inner = staged(t.select(F.explode(F.array(*[F.struct(F.col(e).alias("ego"), F.col(a).alias("p"), F.col(b).alias("q")) for e, a, b in rows])).alias("r")).select("r.*"), "ego")
    ways = inner.unionByName(inner.select("ego", F.col("q").alias("p"), F.col("p").alias("q")))
    members = both_ways(edges).select(F.col("n").alias("ego"), F.col("m").alias("p"))
    label = staged(members.select("ego", "p", F.col("p").alias("c")), "label")
    while True:
        near = ways.join(label.select("ego", F.col("p").alias("q"), "c"), ["ego", "q"]).groupBy("ego", "p").agg(F.min("c").alias("m"))
        least = label.join(near, ["ego", "p"], "left").select("ego", "p", F.least("c", F.coalesce("m", "c")).alias("c"))
        jump = label.select("ego", F.col("p").alias("c"), F.col("c").alias("c2"))
        new = staged(least.join(jump, ["ego", "c"], "left").select("ego", "p", F.least("c", F.coalesce("c2", "c")).alias("c")), "label")
        changed = new.join(label.withColumnRenamed("c", "c0"), ["ego", "p"]).where("c <> c0").limit(1).count()
        discard(label)
        label = new
        if not changed:
            return label, ways


def ego_components(edges: DataFrame) -> DataFrame:
    """(ego, size, edges, degrees): components of the graph among each node's neighbours, degrees descending."""
    label, ways = ego_graphs(edges)
    local = ways.groupBy("ego", "p").agg(F.count(F.lit(1)).alias("d"))
    full = label.join(local, ["ego", "p"], "left").select("ego", "c", F.coalesce("d", F.lit(0)).cast("long").alias("d"))
    return full.groupBy("ego", "c").agg(F.count(F.lit(1)).alias("size"), (F.sum("d") / 2).cast("long").alias("edges"), F.reverse(F.array_sort(F.collect_list("d"))).alias("degrees")).drop("c")


#: Degrees of a component that a neighbourhood code holds, the largest first.
MOST_DEGREES = 6


def ncc(edges: DataFrame, most: int | None = MOST_DEGREES) -> DataFrame:
    """(ego, code): a node's components in descending order as size:edges:degrees, joined by |; `most` degrees of each,
    or all."""
    one = F.struct("size", "edges", _first(most))
    text = F.transform(F.reverse(F.array_sort(F.collect_list(one))), lambda c: F.concat_ws(":", c["size"].cast("string"), c["edges"].cast("string"), F.array_join(c["degrees"].cast("array<string>"), ",")))
    return ego_components(edges).groupBy("ego").agg(F.array_join(text, "|").alias("code"))


def _first(most: int | None) -> Column:
    return (F.col("degrees") if most is None else F.slice("degrees", 1, most)).alias("degrees")


def short_codes(edges: DataFrame, most: int = 4) -> DataFrame:
    """(n, code): size and edges of a node's components, descending, the first `most` of them."""
    one = F.struct("size", "edges")
    return ego_components(edges).groupBy(F.col("ego").alias("n")).agg(F.slice(F.reverse(F.array_sort(F.collect_list(one))), 1, most).alias("code"))


def ncc_codes(edges: DataFrame, most: int | None = MOST_DEGREES) -> DataFrame:
    """(n, code, weight): of each of a node's components, in descending order, size, edges and its `most` largest degrees,
    or all.

    The weight is the sum of the numbers, and what distances between codes are divided by.
    """
    one = F.struct("size", "edges", _first(most))
    whole = ego_components(edges).groupBy("ego").agg(F.reverse(F.array_sort(F.collect_list(one))).alias("cs"))
    codes = whole.select(F.col("ego").alias("n"), F.transform("cs", lambda c: F.concat(F.array(c["size"], c["edges"]), c["degrees"])).alias("code"))
    return codes.withColumn("weight", F.aggregate(F.flatten("code"), F.lit(0).cast("long"), lambda a, x: a + x))


def ncc_vectors(edges: DataFrame, most: int | None = MOST_DEGREES) -> DataFrame:
    """(n, vec, weight): codes as flat arrays, each component's degrees filled up with 0 to the most that any node has."""
    codes = staged(ncc_codes(edges, most), "codes")
    width = codes.agg(F.coalesce(F.max(F.array_max(F.transform("code", F.size))), F.lit(0))).first()[0]
    padded = F.transform("code", lambda c: F.concat(c, F.array_repeat(F.lit(0).cast("long"), F.lit(width) - F.size(c))))
    return codes.select("n", F.flatten(padded).alias("vec"), "weight")


def ncc_distance(vectors: DataFrame, pairs: DataFrame) -> DataFrame:
    """(u, v, distance) of pairs: the L1 distance of padded codes, or of vectors, over the larger of both weights and 1."""
    nested = "code" in vectors.columns
    what = "code" if nested else "vec"
    a = vectors.select(F.col("n").alias("u"), F.col(what).alias("p"), F.col("weight").alias("wp"))
    b = vectors.select(F.col("n").alias("v"), F.col(what).alias("q"), F.col("weight").alias("wq"))
    total = lambda x: F.aggregate(x, F.lit(0).cast("long"), lambda s, y: s + y)
    l1 = lambda p, q: total(F.zip_with(p, q, lambda x, y: F.abs(F.coalesce(x, F.lit(0)) - F.coalesce(y, F.lit(0)))))
    none = F.array().cast("array<long>")
    gap = total(F.zip_with("p", "q", lambda x, y: l1(F.coalesce(x, none), F.coalesce(y, none)))) if nested else l1("p", "q")
    return pairs.join(a, "u").join(b, "v").select("u", "v", (gap / F.greatest(F.col("wp"), F.col("wq"), F.lit(1))).alias("distance"))


def path_lengths(dist: DataFrame, nodes: int) -> DataFrame:
    """One row (pairs, reachable_mean, all_pairs_mean, longest) of (src, dst, dist) from every node.

    Unreachable pairs are left out of the first mean and count as 0 in the second.
    """
    far = dist.where("dist > 0").agg(F.count(F.lit(1)).alias("c"), F.sum("dist").alias("s"), F.max("dist").alias("longest"))
    every = float(max(nodes * (nodes - 1), 1))
    return far.select((F.col("c") / 2).cast("long").alias("pairs"), (F.col("s") / F.col("c")).alias("reachable_mean"), (F.col("s") / every).alias("all_pairs_mean"), "longest")


def sampled_paths(edges: DataFrame, share: float = 0.0625, seed: int = 42) -> DataFrame:
    """One row (sources, pairs, mean, error): path lengths from a share of the nodes, chosen by md5, to all that they reach.

    The error is the standard error of the sources' own means. For graphs whose pairs of nodes are too many to list.
    """
    h = F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(str(seed)), F.col("n").cast("string"))), 1, 8), 16, 10).cast("double") / float(1 << 32)
    far = distances(edges, nodes_of(edges).where(h < share)).where("dist > 0")
    each = far.groupBy("src").agg(F.count(F.lit(1)).alias("c"), F.sum("dist").alias("s"))
    return each.agg(F.count(F.lit(1)).alias("sources"), F.sum("c").alias("pairs"), (F.sum("s") / F.sum("c")).alias("mean"), (F.stddev_samp(F.col("s") / F.col("c")) / F.sqrt(F.count(F.lit(1)).cast("double"))).alias("error"))


def signatures(edges: DataFrame) -> DataFrame:
    """(n, deg, triangles, clustering, avg_neighbour_degree, ego_edges, largest, second): seven numbers a node."""
    comps = ego_components(edges).groupBy("ego").agg(F.reverse(F.array_sort(F.collect_list("size"))).alias("s"))
    sized = comps.select(F.col("ego").alias("n"), F.col("s")[0].alias("largest"), F.coalesce(F.get("s", F.lit(1)), F.lit(0)).cast("long").alias("second"))
    base = clustering(edges).join(neighbour_degree(edges), "n").join(sized, "n")
    return base.select("n", "deg", "triangles", "clustering", "avg_neighbour_degree", F.col("triangles").alias("ego_edges"), "largest", "second")


def distances(edges: DataFrame, sources: DataFrame, limit: int | None = None) -> DataFrame:
    """(src, dst, dist) of nodes that breadth-first search reaches from the sources (n) in `limit` steps, themselves at 0.

    Without a limit every node is reached; graphs over 10,000 steps across are an error.
    """
    whole, limit = limit is None, limit or 10_000
    s = staged(both_ways(edges), "edges")
    front = staged(sources.select(F.col("n").alias("src"), F.col("n").alias("dst"), F.lit(0).cast("long").alias("dist")), "front")
    seen, levels = front, [front]
    for d in range(1, limit + 1):
        reach = front.join(s, front["dst"] == s["n"]).select("src", F.col("m").alias("dst")).distinct()
        front = staged(reach.join(seen.select("src", "dst"), ["src", "dst"], "left_anti").select("src", "dst", F.lit(d).cast("long").alias("dist")), "front")
        if not front.limit(1).count():
            break
        if d == limit and whole:
            raise RuntimeError(f"nodes further than {limit} steps")
        levels.append(front)
        seen = levels[-1].unionByName(levels[-2])  # a new node is only met again from the last two levels
    out = levels[0]
    for x in levels[1:]:
        out = out.unionByName(x)
    return out


def network_stats(weights: DataFrame) -> DataFrame:
    """One row (least_weight, mean_degree) of weighted edges (u, v, w): the least weight over 0, 1 if there is none."""
    d = weights.where("w > 0").select(F.explode(F.array("u", "v")).alias("n")).groupBy("n").agg(F.count(F.lit(1)).alias("deg")).agg(F.avg("deg").alias("mean_degree"))
    return weights.where("w > 0").agg(F.coalesce(F.min("w"), F.lit(1)).alias("least_weight")).crossJoin(d)  # a row each


def induced(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(u, v): the edges with both ends among nodes (n)."""
    keep = nodes.select("n").distinct()
    return edges.join(keep.withColumnRenamed("n", "u"), "u", "left_semi").join(keep.withColumnRenamed("n", "v"), "v", "left_semi").select("u", "v")


def toggled(edges: DataFrame, other: DataFrame) -> DataFrame:
    """(u, v): the edges of one table or the other, but not of both."""
    both = edges.select("u", "v", F.lit(1).alias("a")).distinct().unionByName(other.select("u", "v", F.lit(2).alias("a")).distinct())
    return both.groupBy("u", "v").agg(F.sum("a").alias("a")).where("a < 3").select("u", "v")


def display_nodes(edges: DataFrame, most: int) -> DataFrame:
    """(n): the `most` nodes of largest degree, ties to the smaller one."""
    return degrees(edges).orderBy(F.col("deg").desc(), "n").limit(most).select("n")


def longest_component_paths(edges: DataFrame, components: DataFrame) -> DataFrame:
    """As path_lengths() within the component of the most nodes, ties to the smaller."""
    size = components.groupBy("component").agg(F.count(F.lit(1)).alias("c"))
    top = size.agg(F.min(F.struct((-F.col("c")).alias("c"), "component"))["component"].alias("component"))
    nodes = staged(components.join(top, "component", "left_semi").select(F.col("node").alias("n")), "nodes")
    return path_lengths(distances(induced(edges, nodes), nodes), nodes.count())
