"""Graphs from edge lists and from the order tables.

An edge table is (u, v) with u < v, distinct; a node table is (n). Nodes are kept apart from edges, for a node
may have none.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from veilgraph.plans.staging import spread

#: First cells that tell a header row of a comma-separated edge list.
HEADER_CELLS = ("source", "src", "from", "u")


def normalised(pairs: DataFrame, u: str = "u", v: str = "v") -> DataFrame:
    """Undirected simple edges: no nulls, self-loops or repeats, the smaller end first."""
    a, b = F.col(u), F.col(v)
    return pairs.where(a.isNotNull() & b.isNotNull() & (a != b)).select(F.least(a, b).alias("u"), F.greatest(a, b).alias("v")).distinct()


def read_tokens(spark: SparkSession, path: str, separators: str = r"[\s,;]+", comment: str = "#") -> DataFrame:
    """(u, v) as text from lines of two tokens or more; comments, shorter lines and headers of comma-separated lists are
    skipped."""
    parts = F.split(F.trim(F.col("value")), separators)
    lines = spark.read.text(path).where(~F.trim(F.col("value")).startswith(comment)).select(parts.alias("t"), F.contains("value", F.lit(",")).alias("commas")).where(F.size("t") >= 2)
    return lines.where(~(F.col("commas") & F.lower(F.col("t")[0]).isin(*HEADER_CELLS))).select(F.col("t")[0].alias("u"), F.col("t")[1].alias("v"))


def read_pairs(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of an edge list of integers; a node whose only edge is a self-loop stays as a node."""
    raw = read_tokens(spark, path).select(F.expr("try_cast(u AS bigint)").alias("u"), F.expr("try_cast(v AS bigint)").alias("v")).where("u IS NOT NULL AND v IS NOT NULL")
    nodes = raw.select(F.explode(F.array("u", "v")).alias("n")).distinct()
    return nodes, normalised(raw)


def read_labels(spark: SparkSession, path: str, nodes: DataFrame, default: str = "*") -> DataFrame:
    """(n, label) of every node; labels of unknown nodes are ignored, missing ones are the default."""
    parts = F.split(F.trim(F.col("value")), r"\s+")
    named = spark.read.text(path).select(parts.alias("t")).where(F.size("t") >= 2).groupBy(F.expr("try_cast(t[0] AS bigint)").alias("n")).agg(F.max(F.col("t")[1]).alias("label"))
    return nodes.join(named, "n", "left").select("n", F.coalesce("label", F.lit(default)).alias("label"))


def read_gml_edges(spark: SparkSession, path: str) -> DataFrame:
    """(u, v) of the edge blocks of GML files."""
    text = spark.read.text(path, wholetext=True)
    blocks = text.select(F.explode(F.regexp_extract_all("value", F.lit(r"(?s)edge\s*\[([^\]]*)\]"), 1)).alias("b"))
    return normalised(blocks.select(F.regexp_extract("b", r"source\s+(\d+)", 1).cast("long").alias("u"), F.regexp_extract("b", r"target\s+(\d+)", 1).cast("long").alias("v")))


def write_pairs(edges: DataFrame, path: str) -> None:
    """Lines `u v` in order; as many files as the sort makes, in order of their names."""
    edges.orderBy("u", "v").select(F.concat_ws(" ", "u", "v").alias("value")).write.text(path)


def nodes_of(edges: DataFrame) -> DataFrame:
    return edges.select(F.explode(F.array("u", "v")).alias("n")).distinct()


def both_ways(edges: DataFrame) -> DataFrame:
    """(n, m): every edge from either end."""
    return edges.select(F.col("u").alias("n"), F.col("v").alias("m")).unionByName(edges.select(F.col("v").alias("n"), F.col("u").alias("m")))


def co_purchase(lineitem: DataFrame, least: int = 1) -> DataFrame:
    """Parts that share `least` orders or more.

    An order has a handful of lines, so its pairs are made from its own sorted array of parts, without a join. Orders and
    pairs lie in partitions whose number grows with the lines, so that what a task counts at once does not.
    """
    lines = lineitem.count()
    orders = spread(lineitem, lines, "l_orderkey").groupBy("l_orderkey").agg(F.array_sort(F.collect_set("l_partkey")).alias("p"))
    pairs = orders.select(F.posexplode("p").alias("i", "u"), "p").select("u", F.explode(F.expr("slice(p, i + 2, size(p))")).alias("v"))
    pairs = spread(pairs, 2 * lines, "u", "v")
    if least <= 1:
        return pairs.distinct()
    return pairs.groupBy("u", "v").agg(F.count(F.lit(1)).alias("c")).where(F.col("c") >= least).select("u", "v")


def read_mapping(spark: SparkSession, path: str) -> DataFrame:
    """(src, dst) of lines of just two integers, other lines skipped; of lines with one src in a file the later wins."""
    parts = F.split(F.trim(F.col("value")), r"\s+")
    lines = spark.read.text(path).select(parts.alias("t"), F.monotonically_increasing_id().alias("at")).where(F.size("t") == 2)
    rows = lines.select(F.expr("try_cast(t[0] AS bigint)").alias("src"), F.expr("try_cast(t[1] AS bigint)").alias("dst"), "at").where("src IS NOT NULL AND dst IS NOT NULL")
    return rows.groupBy("src").agg(F.max_by("dst", "at").alias("dst"))


def k_of_name(name: Column) -> Column:
    """The number between `-k` and the next hyphen of a file name; null if there is none."""
    return F.when(name.rlike(r"-k(\d+)-"), F.regexp_extract(name, r"-k(\d+)-", 1).cast("int"))


def folder_characteristics(spark: SparkSession, path: str) -> DataFrame:
    """(file, k, nodes, edges, mean_degree) of every edge list of integers under a path, files read together."""
    parts = F.split(F.trim(F.col("value")), r"[\s,;]+")
    raw = spark.read.text(path).select(F.input_file_name().alias("file"), parts.alias("t")).where(F.size("t") >= 2)
    ends = raw.select("file", F.expr("try_cast(t[0] AS bigint)").alias("a"), F.expr("try_cast(t[1] AS bigint)").alias("b")).where("a IS NOT NULL AND b IS NOT NULL")
    nodes = ends.select("file", F.explode(F.array("a", "b")).alias("n")).distinct().groupBy("file").agg(F.count(F.lit(1)).alias("nodes"))
    edges = ends.where("a <> b").select("file", F.least("a", "b").alias("u"), F.greatest("a", "b").alias("v")).distinct().groupBy("file").agg(F.count(F.lit(1)).alias("edges"))
    both = nodes.join(edges, "file", "left").withColumn("edges", F.coalesce("edges", F.lit(0)).cast("long"))
    return both.select("file", k_of_name(F.col("file")).alias("k"), "nodes", "edges", (2.0 * F.col("edges") / F.col("nodes")).alias("mean_degree"))


def string_edges(edges: DataFrame) -> DataFrame:
    """(u, v): edges as text, the end that sorts first as text first."""
    a, b = F.col("u").cast("string"), F.col("v").cast("string")
    return edges.select(F.least(a, b).alias("u"), F.greatest(a, b).alias("v"))


def aligned(nodes: DataFrame, edges: DataFrame, wanted: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) over just the wanted nodes (n): missing ones are added without edges, others go with theirs."""
    keep = wanted.select("n").distinct()
    inner = edges.join(keep.withColumnRenamed("n", "u"), "u", "left_semi").join(keep.withColumnRenamed("n", "v"), "v", "left_semi")
    return keep, inner.select("u", "v")


def write_results(results: DataFrame, path: str, missing: str = "N/A") -> None:
    """Results as CSV with a header; nulls and numbers that are not finite are written as `missing`."""
    cell = lambda c, t: F.when(F.isnan(c) | (F.abs(F.col(c)) == float("inf")), None).otherwise(F.col(c)) if t in ("double", "float") else F.col(c)
    results.select(*[F.coalesce(cell(c, t).cast("string"), F.lit(missing)).alias(c) for c, t in results.dtypes]).write.option("header", True).csv(path)


def read_results(spark: SparkSession, path: str, metrics: list[str], missing: str = "N/A") -> DataFrame:
    """Results of CSV files; metrics are doubles, null where they hold `missing` or no number."""
    raw = spark.read.option("header", True).option("nullValue", missing).csv(path)
    return raw.withColumns({m: F.expr(f"try_cast(`{m}` AS double)") for m in metrics if m in raw.columns})
