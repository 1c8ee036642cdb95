"""Node classes from features averaged over neighbours, a linear stand-in for graph neural networks."""

from __future__ import annotations

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilgraph.operators.evaluate import stratified_split
from veilgraph.operators.structure import clustering, core_numbers, neighbour_degree
from veilgraph.plans.staging import staged
from veilgraph.sources.graphs import both_ways


def features(edges: DataFrame) -> DataFrame:
    """(n, x1 .. x5): degree, clustering, mean neighbour degree, triangles and core number, all but the second over their
    largest."""
    base = staged(clustering(edges).join(neighbour_degree(edges), "n").join(core_numbers(edges), "n"), "measures")
    scaled = ("deg", "avg_neighbour_degree", "triangles", "core")
    top = base.agg(*[F.greatest(F.max(c).cast("double"), F.lit(1.0)).alias(f"top_{c}") for c in scaled])
    x = base.crossJoin(F.broadcast(top))  # top is one row
    over = {c: F.col(c) / F.col(f"top_{c}") for c in scaled}
    return x.select("n", over["deg"].alias("x1"), F.col("clustering").alias("x2"), over["avg_neighbour_degree"].alias("x3"), over["triangles"].alias("x4"), over["core"].alias("x5"))


def propagated(edges: DataFrame, x: DataFrame, steps: int = 2) -> DataFrame:
    """x with every column averaged over a node and its neighbours, `steps` times."""
    ring = both_ways(edges).unionByName(x.select("n", F.col("n").alias("m")))
    columns = [c for c in x.columns if c != "n"]
    for _ in range(steps):
        x = staged(ring.join(x.withColumnRenamed("n", "m"), "m").groupBy("n").agg(*[F.avg(c).alias(c) for c in columns]), "step")
    return x


def predict(edges: DataFrame, labels: DataFrame, seed: int = 42) -> DataFrame:
    """(n, y, guess) of the test part of labels (n, y), by logistic regression on propagated features."""
    x = propagated(edges, features(edges))
    codes = labels.select("y").distinct().withColumn("label", F.col("y").cast("double"))
    parts = stratified_split(labels, "n", "y", seed=seed)
    taught = staged(x.join(parts, "n").join(codes, "y"), "taught")  # read again by every pass of the model
    rows = VectorAssembler(inputCols=[c for c in x.columns if c != "n"], outputCol="features").transform(taught)
    model = LogisticRegression(maxIter=30, regParam=1e-3).fit(rows.where("part = 'train'"))
    return model.transform(rows.where("part = 'test'")).select("n", "y", F.col("prediction").cast("long").alias("guess"))
