"""Seed-and-grow re-identification: mapped neighbours vote for pairs of nodes of two graphs."""

from __future__ import annotations

import itertools

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from veilgraph.operators.compare import ordered_by_degree
from veilgraph.operators.structure import degrees
from veilgraph.plans.staging import discard, staged
from veilgraph.sources.graphs import both_ways


def seeds(edges: DataFrame, share: float = 0.01, least: int = 5, most: int = 50) -> DataFrame:
    """(src, dst): the nodes of largest degree, known to the attacker; a share of all between two bounds."""
    n = degrees(edges).count()
    count = max(least, min(most, round(share * n)))
    return ordered_by_degree(edges).where(F.col("rank") <= count).select(F.col("n").alias("src"), F.col("n").alias("dst"))


def propagate(original: DataFrame, published: DataFrame, known: DataFrame, theta: float = 0.5, rounds: int | None = None) -> DataFrame:
    """(src, dst): known pairs and those that grow from them.

    A pair's score is the number of mapped neighbours that it shares over the roots of both degrees. A node takes
    its best pair if that stands out: by theta deviations of its scores from the second best, in both directions.
    All nodes of a round are judged on the mapping as the round began. Rounds go on until none adds a pair, or as many as
    asked for; differences are compared to 9 places.
    """
    a, b = staged(both_ways(original), "original"), staged(both_ways(published), "published")
    da, db = staged(degrees(original), "degrees"), staged(degrees(published), "degrees")
    found = staged(known, "mapping")
    for _ in itertools.count() if rounds is None else range(rounds):
        votes = found.join(a, found["src"] == a["n"]).select(F.col("m").alias("x"), "dst").join(b, F.col("dst") == b["n"]).groupBy("x", F.col("m").alias("y")).agg(F.count(F.lit(1)).alias("c"))
        free = votes.join(found.select(F.col("src").alias("x")), "x", "left_anti").join(found.select(F.col("dst").alias("y")), "y", "left_anti")
        scored = free.join(da.select(F.col("n").alias("x"), F.col("deg").alias("p")), "x").join(db.select(F.col("n").alias("y"), F.col("deg").alias("q")), "y").select("x", "y", (F.col("c") / F.sqrt(F.col("p") * F.col("q").cast("double"))).alias("s"))

        def best(side: str, other: str, table: DataFrame = scored) -> DataFrame:
            w = Window.partitionBy(side)
            order = w.orderBy(F.col("s").desc(), other)
            ranked = table.withColumn("r", F.row_number().over(order)).withColumn("next", F.lead("s", 1, 0.0).over(order)).withColumn("dev", F.coalesce(F.stddev_pop("s").over(w), F.lit(0.0)))
            return ranked.where((F.col("r") == 1) & ((F.round(F.col("s") - F.col("next"), 9) >= F.round(theta * F.col("dev"), 9)) & (F.col("s") > F.col("next")))).select("x", "y")

        new = best("x", "y").join(best("y", "x"), ["x", "y"]).select(F.col("x").alias("src"), F.col("y").alias("dst"))
        grown = staged(new, "mapping")
        if not grown.limit(1).count():
            discard(grown)
            break
        before, found = found, staged(found.unionByName(grown), "mapping")
        discard(before)
        discard(grown)
    return found


def success(mapping: DataFrame) -> DataFrame:
    """One row (mapped, correct, percent) where node ids are the same in both graphs."""
    return mapping.agg(F.count(F.lit(1)).alias("mapped"), F.sum((F.col("src") == F.col("dst")).cast("long")).alias("correct")).withColumn("percent", 100.0 * F.col("correct") / F.col("mapped"))
