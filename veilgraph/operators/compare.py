"""What an anonymised graph changed: edge sets, degrees and their distributions."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from veilgraph.operators.components import connected_components
from veilgraph.operators.structure import clustering, degrees, distances, graph_stats, path_lengths
from veilgraph.plans.staging import ROWS, staged
from veilgraph.sources.graphs import nodes_of


def edge_changes(original: DataFrame, published: DataFrame) -> DataFrame:
    """One row (preserved, added, removed, changes) from one grouping of both edge sets."""
    tagged = original.select("u", "v", F.lit(1).alias("a"), F.lit(0).alias("b")).unionByName(published.select("u", "v", F.lit(0).alias("a"), F.lit(1).alias("b")))
    both = tagged.groupBy("u", "v").agg(F.max("a").alias("a"), F.max("b").alias("b"))
    count = lambda c: F.coalesce(F.sum(c.cast("long")), F.lit(0))
    a, b = F.col("a") == 1, F.col("b") == 1
    return both.agg(count(a & b).alias("preserved"), count(~a & b).alias("added"), count(a & ~b).alias("removed")).withColumn("changes", F.col("added") + F.col("removed"))


def degree_pairs(original: DataFrame, published: DataFrame) -> DataFrame:
    """(n, before, after) of the original nodes; a node that is gone has degree 0 after."""
    after = degrees(published).select("n", F.col("deg").alias("after"))
    return degrees(original).join(after, "n", "left").select("n", F.col("deg").alias("before"), F.coalesce("after", F.lit(0)).cast("long").alias("after"))


def degree_loss(original: DataFrame, published: DataFrame) -> DataFrame:
    """One row (mae, rmse) of the degrees of the original nodes."""
    gap = F.col("before") - F.col("after")
    return degree_pairs(original, published).agg(F.avg(F.abs(gap)).alias("mae"), F.sqrt(F.avg(gap * gap)).alias("rmse"))


def structural_delta(original: DataFrame, published: DataFrame) -> DataFrame:
    """One row with nodes, edges and density of both graphs and their differences."""
    a, b = graph_stats(original), graph_stats(published)
    keep = ("nodes", "edges", "density")
    joined = a.select(*[F.col(c).alias(f"original_{c}") for c in keep]).crossJoin(b.select(*[F.col(c).alias(f"published_{c}") for c in keep]))  # a row each
    return joined.select("*", *[(F.col(f"published_{c}") - F.col(f"original_{c}")).alias(f"{c}_variation") for c in keep])


def k_degree(edges: DataFrame, ks: tuple[int, ...]) -> DataFrame:
    """(k, anonymous, smallest_class): whether each degree that occurs is shared by k nodes or more."""
    least = degrees(edges).groupBy("deg").agg(F.count(F.lit(1)).alias("c")).agg(F.min("c").alias("smallest_class"))
    return least.select(F.explode(F.array(*[F.lit(k) for k in ks])).alias("k"), "smallest_class").select("k", F.coalesce(F.col("smallest_class") >= F.col("k"), F.lit(True)).alias("anonymous"), "smallest_class")


def k_neighbourhood(codes: DataFrame, ks: tuple[int, ...]) -> DataFrame:
    """(k, anonymous, smallest_class) of (ego, code): whether each neighbourhood code is shared by k nodes or more."""
    least = codes.groupBy("code").agg(F.count(F.lit(1)).alias("c")).agg(F.min("c").alias("smallest_class"))
    return least.select(F.explode(F.array(*[F.lit(k) for k in ks])).alias("k"), "smallest_class").select("k", F.coalesce(F.col("smallest_class") >= F.col("k"), F.lit(True)).alias("anonymous"), "smallest_class")


def wasserstein(original: DataFrame, published: DataFrame) -> DataFrame:
    """One row (distance): sum over the degrees that occur of the gap between the two cumulative shares."""
    hist = lambda e, c: degrees(e).groupBy("deg").agg(F.count(F.lit(1)).alias(c))
    both = hist(original, "a").join(hist(published, "b"), "deg", "full").select("deg", *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in "ab"])
    upto = Window.orderBy("deg").rowsBetween(Window.unboundedPreceding, Window.currentRow)  # a row a distinct degree
    whole = Window.partitionBy()
    gap = F.abs(F.sum("a").over(upto) / F.sum("a").over(whole) - F.sum("b").over(upto) / F.sum("b").over(whole))
    return both.select(gap.alias("g")).agg(F.coalesce(F.sum("g"), F.lit(0.0)).alias("distance"))


def running(df: DataFrame, order: list, value: str | None = None, name: str = "sum", rank: str = "rank") -> DataFrame:
    """df with its rows' numbers from 1 in a total order of columns and, if a value is named, its sum up to each row.

    Rows go to ranges of the order, which no single value can fill, and each range counts from where those before it
    end; only a row a range is summed in one place.
    """
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = staged(df.repartitionByRange(n, *order).withColumn("_part", F.spark_partition_id()).withColumn("_v", F.col(value).cast("long") if value else F.lit(0).cast("long")), "ranges")
    sizes = placed.groupBy("_part").agg(F.count(F.lit(1)).alias("_c"), F.sum("_v").alias("_s"))
    upto = Window.orderBy("_part")
    before = sizes.select("_part", (F.sum("_c").over(upto) - F.col("_c")).alias("_before"), (F.sum("_s").over(upto) - F.col("_s")).alias("_left"))  # a row a range
    inner = Window.partitionBy("_part").orderBy(*order)
    met = placed.withColumn("_i", F.row_number().over(inner)).withColumn("_j", F.sum("_v").over(inner.rowsBetween(Window.unboundedPreceding, Window.currentRow))).join(F.broadcast(before), "_part")
    out = met.withColumn(rank, (F.col("_before") + F.col("_i")).cast("long"))
    return (out.withColumn(name, F.col("_left") + F.col("_j")) if value else out).drop("_part", "_i", "_j", "_v", "_before", "_left")


def ranked(df: DataFrame, order: list, name: str = "rank", size: int = 0) -> DataFrame:
    """df with its rows' numbers from 1 in a total order of columns.

    As in running(), but rows are numbered where their range is sorted, so that they are shuffled once. With their number
    `size` a range holds ROWS of them or so. discard() of the result deletes the ranges that it reads.
    """
    n = max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-size // ROWS))
    ranges = df.repartitionByRange(n, *order).sortWithinPartitions(*order)
    placed = staged(ranges.withColumn("_at", F.monotonically_increasing_id()), "ranges")  # range * 2 ** 33 + place from 0
    part, place = F.shiftright("_at", 33), F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))
    sizes = placed.groupBy(part.alias("_part")).agg(F.count(F.lit(1)).alias("_c"))
    before = sizes.select("_part", (F.sum("_c").over(Window.orderBy("_part")) - F.col("_c")).alias("_before"))  # a row a range
    met = placed.withColumn("_part", part).join(F.broadcast(before), "_part")
    out = met.withColumn(name, (F.col("_before") + place + 1).cast("long")).drop("_part", "_before", "_at")
    out._veilgraph_path = placed._veilgraph_path
    return out


def ordered_by_degree(edges: DataFrame) -> DataFrame:
    """(n, deg, rank): ranks from 1 by (degree descending, n)."""
    return by_degree(degrees(edges))


def by_degree(deg: DataFrame) -> DataFrame:
    """As ordered_by_degree() of degrees (n, deg) that are counted already."""
    return ranked(deg, [F.col("deg").desc(), F.col("n")])


def full_delta(original: DataFrame, published: DataFrame) -> DataFrame:
    """One row: nodes, edges, density, average clustering and mean path length of both graphs, what they changed by and
    the mean change of a degree. Paths are all of them: for graphs whose pairs of nodes are few enough; without any their
    mean is infinite."""
    keep = ("nodes", "edges", "density", "clustering", "apl")

    def stats(edges: DataFrame, prefix: str) -> DataFrame:
        nodes = staged(nodes_of(edges), "nodes")
        paths = path_lengths(distances(edges, nodes), nodes.count()).select(F.coalesce("reachable_mean", F.lit(float("inf"))).alias("apl"))
        some = clustering(edges).agg(F.coalesce(F.avg("clustering"), F.lit(0.0)).alias("clustering"))
        return graph_stats(edges).select("nodes", "edges", "density").crossJoin(some).crossJoin(paths).select(*[F.col(c).alias(f"{prefix}_{c}") for c in keep])  # a row each

    both = stats(original, "original").crossJoin(stats(published, "anonymized")).crossJoin(degree_loss(original, published).select("mae"))  # a row each
    return both.select("*", *[(F.col(f"anonymized_{c}") - F.col(f"original_{c}")).alias(f"{c.removesuffix('s')}_variation") for c in keep])


def diagnosis(original: DataFrame, published: DataFrame) -> DataFrame:
    """One row: sizes, components and average clustering of both graphs, edges kept, added and removed, and the share kept."""
    def stats(edges: DataFrame, suffix: str) -> DataFrame:
        parts = connected_components(edges).agg(F.countDistinct("component").alias("components"))
        some = clustering(edges).agg(F.coalesce(F.avg("clustering"), F.lit(0.0)).alias("clustering"))
        row = graph_stats(edges).select("nodes", "edges").crossJoin(parts).crossJoin(some)  # a row each
        return row.select(*[F.col(c).alias(f"{c}_{suffix}") for c in row.columns])

    row = stats(original, "original").crossJoin(stats(published, "anonymized")).crossJoin(edge_changes(original, published).drop("changes"))  # a row each
    return row.withColumn("intersection", F.when(F.col("edges_original") > 0, F.col("preserved") / F.col("edges_original")).otherwise(0.0))


def wr_cost(original: DataFrame, published: DataFrame, weight: float = 1.0) -> DataFrame:
    """One row (cost): the distance of the degree distributions plus half `weight` times the sum of changes of degrees."""
    gap = degree_pairs(original, published).agg(F.coalesce(F.sum(F.abs(F.col("before") - F.col("after"))), F.lit(0)).alias("g"))
    return wasserstein(original, published).crossJoin(gap).select((F.col("distance") + 0.5 * weight * F.col("g")).alias("cost"))  # a row each


__all__ = ["degree_loss", "degree_pairs", "diagnosis", "edge_changes", "full_delta", "k_degree", "nodes_of", "ordered_by_degree", "ranked", "structural_delta", "wasserstein", "wr_cost"]
