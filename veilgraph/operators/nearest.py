"""Exact nearest neighbours over a few numbers a row: cells of a k-d tree, and of those only the ones in reach."""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veilgraph.plans.staging import discard, staged

#: Distances are rounded to 9 places, so that the order of a sum decides no tie; bounds are wider by this.
SLACK = 1e-6
DEEPEST = 60  # children of cell i are 2 i and 2 i + 1 in a long


def _apart(x: str, y: str) -> Column:
    """The distance of two arrays."""
    return F.sqrt(F.aggregate(F.zip_with(x, y, lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, d: s + d))


def _to_box(far: bool) -> Column:
    """The distance of array x to the box from lo to hi: to its farthest corner, or to its nearest point."""
    if far:
        gap = lambda p: F.greatest(F.abs(p["a"] - p["b"]["lo"]), F.abs(p["a"] - p["b"]["hi"]))
    else:
        gap = lambda p: F.greatest(p["b"]["lo"] - p["a"], p["a"] - p["b"]["hi"], F.lit(0.0))
    sides = F.zip_with("x", F.zip_with("lo", "hi", lambda lo, hi: F.struct(lo.alias("lo"), hi.alias("hi"))), lambda a, b: F.struct(a.alias("a"), b.alias("b")))
    return F.sqrt(F.aggregate(sides, F.lit(0.0), lambda s, p: s + gap(p) * gap(p)))


def cells(points: DataFrame, size: int, most: int) -> tuple[DataFrame, DataFrame]:
    """(tree, places) of points (x, c): distinct arrays of `size` numbers and what each counts for.

    tree: (cell, nodes, lo, hi, leaf), nodes the sum of c and lo to hi the box of a cell's points. places: (x, c, cell)
    with the leaf of each point. A cell with more than `most` points is cut at the median of its widest side, all cells
    of a depth at once; only a cell 60 levels down stays as it is.
    """
    left, levels, leaves, depth = staged(points.select("x", "c", F.lit(1).cast("long").alias("cell")), "cells"), [], [], 0
    while True:
        side = [F.col("x")[i] for i in range(size)]
        stats = left.groupBy("cell").agg(F.count(F.lit(1)).alias("points"), F.sum("c").alias("nodes"), F.array(*[F.min(s) for s in side]).alias("lo"), F.array(*[F.max(s) for s in side]).alias("hi"), F.array(*[F.percentile_approx(s, 0.5) for s in side]).alias("mid"))
        wide = F.zip_with("hi", "lo", lambda a, b: a - b)
        stats = stats.withColumn("side", F.array_position(wide, F.array_max(wide)).cast("int"))
        level = staged(stats.select("cell", "nodes", "lo", "hi", ((F.col("points") <= most) | F.lit(depth >= DEEPEST)).alias("leaf"), "side", F.element_at("mid", F.col("side")).alias("cut"), F.element_at("hi", F.col("side")).alias("top")), "level")
        levels.append(level.select("cell", "nodes", "lo", "hi", "leaf", F.lit(depth).alias("depth")))
        at = left.join(level.select("cell", "leaf", "side", "cut", "top"), "cell")
        leaves.append(staged(at.where("leaf").select("x", "c", "cell"), "leaves"))
        here = F.element_at("x", F.col("side"))
        right = F.when(F.col("cut") < F.col("top"), here > F.col("cut")).otherwise(here >= F.col("top"))
        left, old = staged(at.where("NOT leaf").select("x", "c", (2 * F.col("cell") + right.cast("long")).alias("cell")), "cells"), left
        discard(old)
        if not left.limit(1).count():
            break
        depth += 1
    return staged(functools.reduce(DataFrame.unionByName, levels), "tree"), staged(functools.reduce(DataFrame.unionByName, leaves), "places")


def in_reach(tree: DataFrame, queries: DataFrame) -> DataFrame:
    """(x, bound, cell): the leaves that lie no further than `bound` from x, found from the root down, a depth a round."""
    at, out, depth = queries.select("x", "bound", F.lit(1).cast("long").alias("cell")), [], 0
    deepest = tree.agg(F.max("depth")).first()[0] or 0
    while depth <= deepest:
        near = staged(at.join(tree.where(F.col("depth") == depth).drop("depth", "nodes"), "cell").where(_to_box(False) <= F.col("bound")).select("x", "bound", "cell", "leaf"), "reach")
        out.append(near.where("leaf").select("x", "bound", "cell"))
        at = near.where("NOT leaf").select("x", "bound", F.explode(F.array(2 * F.col("cell"), 2 * F.col("cell") + 1)).alias("cell"))
        depth += 1
    return functools.reduce(DataFrame.unionByName, out)


def bounds(tree: DataFrame, places: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """(x, bound): a distance that at least k nodes are no further away than, for points of the tree; infinite if there are fewer.

    The k-th of the own cell, or the farthest corner of the least cell above that holds k, whichever is nearer.
    """
    own = staged(queries.select("x").join(places.select("x", "cell"), "x"), "own")
    near = own.join(places.select(F.col("x").alias("y"), "c", "cell"), "cell").select("x", "c", _apart("x", "y").alias("d"))
    upto = Window.partitionBy("x").orderBy("d").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    kth = near.withColumn("upto", F.sum("c").over(upto)).where(F.col("upto") >= k).groupBy("x").agg(F.min("d").alias("kth"))
    above = own.select("x", F.explode(F.transform(F.sequence(F.lit(0), F.floor(F.log2(F.col("cell").cast("double"))).cast("int")), lambda i: F.call_function("shiftright", F.col("cell"), i))).alias("cell"))
    corner = above.join(tree.where(F.col("nodes") >= k).select("cell", "lo", "hi"), "cell").groupBy("x").agg(F.min(_to_box(True)).alias("corner"))
    met = own.select("x").join(kth, "x", "left").join(corner, "x", "left")
    return met.select("x", (F.coalesce(F.least("kth", "corner"), F.lit(float("inf"))) + SLACK).alias("bound"))


def nearest(points: DataFrame, seeds: DataFrame, features: list[str], k: int, ties: str = "n", most: int = 256) -> DataFrame:
    """(seed, rank, n, distance): for each of seeds (seed) the k nearest other rows of points (n, `ties` and features ...).

    Distances are Euclidean and rounded to 9 places; equal ones go by `ties`, then n, both ascending. Rows that lack a
    feature, or have one that is no finite number, take no part; seeds that are no such row give nothing. Rows with equal features are one point: of
    them only the first k + 1 can be among anyone's nearest, and seeds that share a point share their search.
    """
    x = F.array(*[F.col(f).cast("double") for f in features])
    fine = functools.reduce(lambda a, b: a & b, [F.col(f).isNotNull() & (F.abs(F.col(f).cast("double")) < float("inf")) for f in features])
    rows = staged(points.where(fine).select("n", F.col(ties).alias("t"), x.alias("x")), "points")
    first = F.row_number().over(Window.partitionBy("x").orderBy("t", "n"))
    kept = staged(rows.withColumn("r", first).where(F.col("r") <= k + 1).select("x", "n", "t"), "kept")  # rows beyond go before the shuffle
    tree, places = cells(kept.groupBy("x").agg(F.count(F.lit(1)).alias("c")), len(features), most)
    asked = staged(seeds.select("seed").distinct().join(rows.select(F.col("n").alias("seed"), "x"), "seed"), "seeds")
    queries = staged(bounds(tree, places, asked.select("x").distinct(), k + 1), "queries")
    met = in_reach(tree, queries).join(places.select(F.col("x").alias("y"), "cell"), "cell").withColumn("d", _apart("x", "y")).where("d <= bound")
    named = met.select("x", "y", F.round("d", 9).alias("d")).join(kept.select(F.col("x").alias("y"), "n", "t"), "y")
    best = F.row_number().over(Window.partitionBy("x").orderBy("d", "t", "n"))
    found = staged(named.withColumn("r", best).where(F.col("r") <= k + 1).select("x", "n", "d", "r"), "found")
    own = Window.partitionBy("seed").orderBy("r")  # k + 1 rows a seed
    others = asked.join(found, "x").where("seed <> n").withColumn("rank", F.row_number().over(own).cast("long"))
    return others.where(F.col("rank") <= k).select("seed", "rank", "n", F.col("d").alias("distance"))
