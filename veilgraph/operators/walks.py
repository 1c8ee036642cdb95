"""Second-order random walks by joins, and classes of nodes from vectors that walks teach."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilgraph.operators.compare import running
from veilgraph.plans.staging import discard, staged
from veilgraph.sources.graphs import both_ways

SEED, TRIES = 42, 4


def _draw(seed: int, walk: Column, step: Column, turn: Column, what: str) -> Column:
    """48 bits of md5, the same on every run."""
    text = F.concat_ws("|", F.lit(str(seed)), F.lit(what), walk, step.cast("string"), turn.cast("string"))
    return F.conv(F.substring(F.md5(text), 1, 12), 16, 10).cast("long")


def random_walks(edges: DataFrame, length: int = 80, walks: int = 10, p: float = 1.0, q: float = 1.0, seed: int = SEED) -> DataFrame:
    """(n, walk, path): from each node with an edge `walks` walks of `length` nodes, itself the first.

    A step goes to a neighbour with odds 1 / p for where the walk comes from, 1 for neighbours of that node and 1 / q for
    others. It is drawn from the neighbours alike, by its place among them, and kept with its odds over the largest;
    walks without one draw again, TRIES at first and twice as many each time after, of which the first that is kept
    counts, however many are drawn at once. So a step costs a row a try, not one a pair of neighbours, and a
    hub's neighbours are never brought together.
    """
    near = running(both_ways(edges).select("n", "m"), [F.col("n"), F.col("m")])
    first = near.groupBy("n").agg(F.min("rank").alias("first"), F.count(F.lit(1)).alias("deg"))
    first = staged(first, "degrees")
    near = staged(near.join(first, "n").select("n", "m", (F.col("rank") - F.col("first")).alias("i")), "neighbours")
    deg = first.select(F.col("n").alias("at"), "deg")
    starts = F.explode(F.sequence(F.lit(0), F.lit(walks - 1))).alias("walk")
    now = staged(first.select("n", starts).select("n", "walk", F.array("n").alias("path")), "walks")
    most = max(1 / p, 1.0, 1 / q)
    for step in range(1, length):
        left = now.select("n", "walk", F.element_at("path", -1).alias("at"), (F.element_at("path", -2) if step > 1 else F.col("n")).alias("last"))
        done, turn, tries = [], 0, TRIES
        while True:
            tried = left.join(deg, "at").select("*", F.explode(F.sequence(F.lit(turn), F.lit(turn + (tries - 1 if step > 1 and most > min(1 / p, 1.0, 1 / q) else 0)))).alias("turn"))
            key = F.concat_ws("/", F.col("n").cast("string"), F.col("walk").cast("string"))
            drawn = tried.withColumn("i", F.pmod(_draw(seed, key, F.lit(step), F.col("turn"), "to"), F.col("deg"))).join(near.withColumnRenamed("n", "at"), ["at", "i"])
            if step == 1 or p == q == 1.0:
                kept = drawn
            else:
                known = near.select(F.col("n").alias("last"), "m", F.lit(True).alias("near"))
                odds = F.when(F.col("m") == F.col("last"), 1 / p).when(F.col("near"), 1.0).otherwise(1 / q)
                chance = _draw(seed, key, F.lit(step), F.col("turn"), "keep") / float(1 << 48)
                kept = drawn.join(known, ["last", "m"], "left").where(chance < odds / most)
            next_to = staged(kept.groupBy("n", "walk").agg(F.min_by("m", "turn").alias("m")), "steps")
            done.append(next_to)
            if step == 1 or p == q == 1.0:
                break
            left = staged(left.join(next_to.select("n", "walk"), ["n", "walk"], "left_anti"), "left")
            if not left.limit(1).count():
                break
            turn, tries = turn + tries, 2 * tries
        steps = done[0]
        for more in done[1:]:
            steps = steps.unionByName(more)
        grown = staged(now.join(steps, ["n", "walk"]).select("n", "walk", F.concat("path", F.array("m")).alias("path")), "walks")
        for old in (now, *done):
            discard(old)
        now = grown
    return now


def walk_vectors(walks: DataFrame, size: int = 32, window: int = 5, seed: int = SEED) -> DataFrame:
    """(n, vec) of the nodes on walks (path), by Word2Vec with nodes as words."""
    from pyspark.ml.feature import Word2Vec

    texts = walks.select(F.transform("path", lambda x: x.cast("string")).alias("path"))
    model = Word2Vec(vectorSize=size, windowSize=window, minCount=0, seed=seed, numPartitions=4, inputCol="path", outputCol="v").fit(texts)
    return model.getVectors().select(F.col("word").cast("long").alias("n"), F.col("vector").alias("vec"))


def walk_classes(vectors: DataFrame, labels: DataFrame, parts: DataFrame) -> DataFrame:
    """(n, y, guess) of the test nodes: logistic regression of labels (n, y) on vectors, taught by parts (n, part) `train`."""
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import StringIndexer

    rows = staged(vectors.join(labels, "n").join(parts, "n"), "vectors-labels")
    train = rows.where("part = 'train'")
    index = StringIndexer(inputCol="y", outputCol="k", handleInvalid="skip", stringOrderType="alphabetAsc").fit(train)
    model = LogisticRegression(featuresCol="vec", labelCol="k", maxIter=100, regParam=0.0).fit(index.transform(train))
    names = F.array(*[F.lit(x) for x in index.labels])  # a label a class
    scored = model.transform(rows.where("part = 'test'"))
    return scored.select("n", "y", F.get(names, F.col("prediction").cast("int")).alias("guess"))


