"""Scores of predictions, and tables of results: means, ranks, trends."""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veilgraph.operators.compare import ranked
from veilgraph.plans.staging import staged


def ranking_scores(scored: DataFrame) -> DataFrame:
    """One row (positives, negatives, auc, average_precision) of (score, y); tied scores share a threshold.

    Everything follows from the counts at each distinct score, summed over ranges of scores; null where one class is
    missing.
    """
    n = int(scored.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    y = F.col("y").cast("long")
    by = staged(scored.groupBy("score").agg(F.sum(y).alias("p"), F.sum(1 - y).alias("q")).repartitionByRange(n, F.col("score").desc()).withColumn("part", F.spark_partition_id()), "scores")
    upto, whole = Window.orderBy("part"), Window.partitionBy()  # a row a range
    sums = by.groupBy("part").agg(F.sum("p").alias("sp"), F.sum("q").alias("sq"))
    base = sums.select("part", *[(F.sum(f"s{c}").over(upto) - F.col(f"s{c}")).alias(f"b{c}") for c in "pq"], *[F.sum(f"s{c}").over(whole).alias(f"n{c}") for c in "pq"])
    inner = Window.partitionBy("part").orderBy(F.col("score").desc()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    run = by.withColumn("ip", F.sum("p").over(inner)).withColumn("iq", F.sum("q").over(inner)).join(F.broadcast(base), "part").select("p", "q", (F.col("bp") + F.col("ip")).alias("tp"), (F.col("bq") + F.col("iq")).alias("fp"), "np", "nq")
    return run.agg(F.max("np").alias("positives"), F.max("nq").alias("negatives"), F.sum(F.col("q") * (F.col("tp") - F.col("p") / 2)).alias("a"), F.sum(F.col("p") * F.col("tp") / (F.col("tp") + F.col("fp"))).alias("b")).select(
        "positives", "negatives", F.when((F.col("positives") > 0) & (F.col("negatives") > 0), F.col("a") / (F.col("positives") * F.col("negatives"))).alias("auc"), F.when(F.col("positives") > 0, F.col("b") / F.col("positives")).alias("average_precision")
    )


def precision_at(scored: DataFrame, ks: tuple[int, ...], order: list[str]) -> DataFrame:
    """(k, precision) of the k best rows of (score, y); ties favour positives, then follow `order`."""
    top = scored.orderBy(F.col("score").desc(), F.col("y").desc(), *order).limit(max(ks)).withColumn("r", F.row_number().over(Window.orderBy(F.col("score").desc(), F.col("y").desc(), *order)))
    return top.select(F.explode(F.array(*[F.lit(k) for k in ks])).alias("k"), "r", "y").where("r <= k").groupBy("k").agg(F.avg(F.col("y").cast("double")).alias("precision"))


def classification(predicted: DataFrame) -> DataFrame:
    """One row (rows, accuracy, macro_f1, micro_f1) of (y, guess); a class without hits has F1 0."""
    cells = predicted.groupBy("y", "guess").agg(F.count(F.lit(1)).alias("c"))
    sides = cells.select(F.col("y").alias("k"), F.col("c").alias("truth"), F.lit(0).alias("said"), F.when(F.col("y") == F.col("guess"), F.col("c")).otherwise(0).alias("hit")).unionByName(
        cells.where("guess IS NOT NULL").select(F.col("guess").alias("k"), F.lit(0).alias("truth"), F.col("c").alias("said"), F.lit(0).alias("hit"))
    )
    per = sides.groupBy("k").agg(F.sum("truth").alias("t"), F.sum("said").alias("s"), F.sum("hit").alias("h"))
    out = per.agg(F.sum("t").alias("rows"), F.sum("h").alias("hits"), F.sum("s").alias("said"), F.avg(2.0 * F.col("h") / (F.col("t") + F.col("s"))).alias("macro_f1"))
    return out.select("rows", (F.col("hits") / F.col("rows")).alias("accuracy"), "macro_f1", (2.0 * F.col("hits") / (F.col("rows") + F.col("said"))).alias("micro_f1"))


def macro_recall(predicted: DataFrame) -> DataFrame:
    """One row (macro_recall) of (y, guess): the mean share of each true class that was guessed."""
    return predicted.groupBy("y").agg(F.avg((F.col("y").eqNullSafe(F.col("guess"))).cast("double")).alias("r")).agg(F.avg("r").alias("macro_recall"))


def _numbered(rows: DataFrame, key: str, label: str, seed: int) -> DataFrame:
    """(key, label, _r, _n): each row's number from 1 by md5 order within its label, and the label's rows.

    Rows are numbered over ranges of (label, md5, key), which the rows of one label do not fill.
    """
    h = F.md5(F.concat_ws("|", F.lit(str(seed)), F.col(key).cast("string")))
    placed = staged(ranked(rows.select(key, label, h.alias("_h")), [F.col(label), F.col("_h"), F.col(key)], "_place"), "places")
    sizes = placed.groupBy(F.col(label).alias("_label")).agg(F.min("_place").alias("_first"), F.count(F.lit(1)).alias("_n"))
    return placed.join(sizes, F.col(label).eqNullSafe(F.col("_label"))).withColumn("_r", F.col("_place") - F.col("_first") + 1)


def stratified_split(rows: DataFrame, key: str, label: str, shares: tuple[float, float] = (0.6, 0.2), seed: int = 42) -> DataFrame:
    """(key, label, part): train, val or test by md5 order within each label; the first of a label trains."""
    numbered = _numbered(rows, key, label, seed)
    first = F.greatest(F.lit(1), F.floor(F.col("_n") * shares[0]))
    part = F.when(F.col("_r") <= first, "train").when(F.col("_r") <= first + F.floor(F.col("_n") * shares[1]), "val").otherwise("test")
    return numbered.select(key, label, part.alias("part"))


def class_split(rows: DataFrame, key: str, label: str, shares: tuple[float, float] = (0.6, 0.2), seed: int = 42) -> DataFrame:
    """(key, label, part): as stratified_split(), but shares are rounded and small classes have rules of their own.

    From three rows on a label has each part, of two rows the second tests, and a single one trains.
    """
    numbered, n = _numbered(rows, key, label, seed), F.col("_n")
    train, val = (F.greatest(F.lit(1), F.bround(n * s).cast("long")) for s in shares)
    left = F.when(train + val < n, val).otherwise(F.greatest(F.lit(1), n - 1 - train))
    tight = train + left >= n
    train, val = F.when(n <= 2, 1).when(tight, n - 2).otherwise(train), F.when(n <= 2, 0).when(tight, 1).otherwise(left)
    part = F.when(F.col("_r") <= train, "train").when(F.col("_r") <= train + val, "val").otherwise("test")
    return numbered.select(key, label, part.alias("part"))


def finite(x: Column) -> Column:
    """x, null where it is not a finite number."""
    return F.when(~F.isnan(x) & (F.abs(x) != float("inf")), x)


def safe_ratio(a: Column, b: Column) -> Column:
    """a / b, null where either is not finite or b is next to 0."""
    return F.when(F.abs(finite(b)) >= 1e-15, finite(a) / b)


def mean_of(*columns: Column) -> Column:
    """The mean of the finite ones of the columns of a row; null if there are none."""
    kept = F.filter(F.array(*[finite(c) for c in columns]), lambda x: x.isNotNull())
    return F.when(F.size(kept) > 0, F.aggregate(kept, F.lit(0.0), lambda s, x: s + x) / F.size(kept))


def summary(results: DataFrame, keys: list[str], metrics: list[str]) -> DataFrame:
    """Means and sample deviations of the finite metrics by keys; a single value deviates by 0."""
    some = [f(finite(F.col(m))).alias(f"{m}_{n}") for m in metrics for n, f in (("mean", F.avg), ("std", lambda c: F.coalesce(F.stddev_samp(c), F.lit(0.0))))]
    return results.groupBy(*keys).agg(*some)


def synthesis(results: DataFrame, method: str, status: str, values: list[str], variations: list[str]) -> DataFrame:
    """(method, runs, a mean of each metric): over the runs whose status is ok, by canonical method name.

    Values are averaged as they are, variations by magnitude; values that are not finite are left out, and a metric
    without any is null.
    """
    good = results.where(F.lower(F.trim(F.col(status))) == "ok")
    means = [F.avg(finite(F.col(c))).alias(c) for c in values] + [F.avg(F.abs(finite(F.col(c)))).alias(f"abs_{c}") for c in variations]
    return good.groupBy(method_name(F.col(method)).alias("method")).agg(F.count(F.lit(1)).alias("runs"), *means)


def rank_within(results: DataFrame, within: str, score: str, name: str) -> DataFrame:
    """results with `rank`: by score descending within a group, ties by name."""
    return results.withColumn("rank", F.row_number().over(Window.partitionBy(within).orderBy(F.col(score).desc_nulls_last(), name)))


def best_worst(results: DataFrame, within: str, score: str, name: str) -> DataFrame:
    """(within, best, worst) by score; ties: the first name is best, the last worst."""
    pair = F.struct(F.col(score), F.col(name))
    return results.where(F.col(score).isNotNull()).groupBy(within).agg(F.min(F.struct(-F.col(score), F.col(name)))[name].alias("best"), F.max(F.struct(-F.col(score), F.col(name)))[name].alias("worst"), F.max(pair)[score].alias("best_score"))


def trend(results: DataFrame, by: str, along: str, score: str) -> DataFrame:
    """(by, change): mean score at the largest step less that at the smallest."""
    means = results.groupBy(by, along).agg(F.avg(finite(F.col(score))).alias("s"))
    return means.groupBy(by).agg((F.max_by("s", along) - F.min_by("s", along)).alias("change"))


def fill_grid(results: DataFrame, a: str, b: str, score: str) -> DataFrame:
    """(a, b, score, present): every pair of the values of a and b that occur; few, as they name methods and steps."""
    grid = results.select(a).distinct().crossJoin(results.select(b).distinct())
    return grid.join(results.select(a, b, score), [a, b], "left").withColumn("present", F.col(score).isNotNull())


def overlaid(tables: list[DataFrame], keys: list[str]) -> DataFrame:
    """The rows of all tables, missing columns null; of rows with equal keys the one of the last table that has them.

    Rows that share their keys within a table are all kept.
    """
    every = functools.reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), [t.withColumn("_table", F.lit(i)) for i, t in enumerate(tables)])
    last = F.max("_table").over(Window.partitionBy(*keys))
    return every.withColumn("_last", last).where("_table = _last").drop("_table", "_last")


def method_name(raw: Column) -> Column:
    """A method's name in lower case, its words joined by underscores."""
    return F.trim(F.regexp_replace(F.lower(F.trim(raw)), r"[\s\-]+", "_"))


def closest(values: DataFrame, value: str, goal: Column, name: str) -> DataFrame:
    """One row (name, value) whose value is the closest to the goal, ties to the smaller name."""
    return values.agg(F.min(F.struct(F.abs(F.col(value) - goal).alias("gap"), F.col(name), F.col(value))).alias("x")).select(f"x.{name}", f"x.{value}")
