"""Graphs from GraphML and npz files, and what a table of classes needs besides the edges: labels, masks, dense ids."""

from __future__ import annotations

import functools
import zipfile
from collections.abc import Iterator

import numpy as np
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import ArrayType, StringType, StructField, StructType

from veilgraph.operators.compare import ranked
from veilgraph.operators.evaluate import class_split
from veilgraph.plans.staging import staged
from veilgraph.sources.graphs import normalised, read_gml_edges, read_tokens

MASKS = ("train_mask", "val_mask", "test_mask")
#: The endings of files that are read as graphs.
ENDINGS = (".pairs", ".edgelist", ".txt", ".csv", ".gml", ".graphml", ".npz")


class Block(InputPartition):
    """Rows start to stop of the arrays of a file."""

    def __init__(self, path: str, start: int, stop: int):
        self.path, self.start, self.stop = path, start, stop


def _opened(path: str):
    system, at = fs.FileSystem.from_uri(path if "://" in path or path.startswith("/") else path.replace("file:/", "file:///", 1))
    return system.open_input_file(at)


class _Arrays:
    """The arrays of an npz file; only the rows that are asked for are read into memory. Pickled ones are refused."""

    def __init__(self, path: str):
        self.path, self.zip = path, zipfile.ZipFile(_opened(path))
        self.names = {n.removesuffix(".npy") for n in self.zip.namelist() if n.endswith(".npy")}

    def _head(self, f) -> tuple[tuple[int, ...], bool, np.dtype]:
        read = {(1, 0): np.lib.format.read_array_header_1_0, (2, 0): np.lib.format.read_array_header_2_0}
        shape, fortran, dtype = read[np.lib.format.read_magic(f)](f)
        if dtype.hasobject:
            raise ValueError(f"{self.path} holds pickled objects, which are not read")
        return shape, fortran, dtype

    def shape(self, name: str) -> tuple[int, ...]:
        with self.zip.open(f"{name}.npy") as f:
            return self._head(f)[0]

    def rows(self, name: str, start: int, stop: int, of: int | None = None) -> np.ndarray:
        """Rows start to stop of an array; with `of`, those of its row `of`."""
        with self.zip.open(f"{name}.npy") as f:
            shape, fortran, dtype = self._head(f)
            base = f.tell()
            if fortran and len(shape) == 2:  # columns lie one after another
                if of is None:
                    return np.stack([self._run(f, dtype, base, j * shape[0] + start, stop - start) for j in range(shape[1])], axis=1)
                return np.concatenate([self._run(f, dtype, base, j * shape[0] + of, 1) for j in range(start, stop)] or [np.empty(0, dtype)])
            width = int(np.prod(shape[1:], dtype=np.int64)) if of is None else 1
            got = self._run(f, dtype, base, start * width if of is None else of * shape[1] + start, (stop - start) * width)
            return got.reshape(-1, *shape[1:]) if of is None else got

    @staticmethod
    def _run(f, dtype: np.dtype, base: int, skip: int, count: int) -> np.ndarray:
        f.seek(base + skip * dtype.itemsize)
        raw = f.read(count * dtype.itemsize)
        if len(raw) != count * dtype.itemsize:
            raise ValueError("an array of the file is cut off")
        return np.frombuffer(raw, dtype)


class NpzReader(DataSourceReader):
    def __init__(self, paths: list[str], table: str, block: int):
        self.paths, self.table, self.block = paths, table, block

    def _length(self, arrays: _Arrays) -> int:
        if self.table == "nodes":
            lengths = {arrays.shape(n)[0] for n in {"x", "y", *MASKS} & arrays.names}
            if len(lengths) != 1:
                raise ValueError(f"{arrays.path} has no arrays of nodes, or of different lengths")
            return lengths.pop()
        if "edges" in arrays.names:
            shape = arrays.shape("edges")
            if len(shape) != 2 or shape[1] != 2:
                raise ValueError(f"edges of {arrays.path} are no pairs")
            return shape[0]
        if "edge_index" not in arrays.names:
            raise ValueError(f"{arrays.path} has neither edges nor edge_index")
        shape = arrays.shape("edge_index")
        if len(shape) != 2 or shape[0] != 2:
            raise ValueError(f"edge_index of {arrays.path} has not two rows")
        return shape[1]

    def partitions(self) -> list[Block]:
        sizes = [(p, self._length(_Arrays(p))) for p in self.paths]
        return [Block(p, s, min(s + self.block, n)) for p, n in sizes for s in range(0, n, self.block)] or [Block(self.paths[0], 0, 0)]

    def read(self, partition: Block) -> Iterator[tuple]:
        arrays, a, b = _Arrays(partition.path), partition.start, partition.stop
        if self.table == "edges":
            if "edges" in arrays.names:
                pairs = arrays.rows("edges", a, b)
            else:
                pairs = zip(arrays.rows("edge_index", a, b, 0), arrays.rows("edge_index", a, b, 1), strict=True)
            yield from ((str(u).strip(), str(v).strip()) for u, v in pairs)
            return
        x = arrays.rows("x", a, b).reshape(b - a, -1).astype(float).tolist() if "x" in arrays.names else [None] * (b - a)
        y = arrays.rows("y", a, b) if "y" in arrays.names else None
        y = [None] * (b - a) if y is None else [str(v) for v in (y.argmax(axis=1) if y.ndim == 2 else y).tolist()]
        masks = [arrays.rows(m, a, b).astype(bool).tolist() if m in arrays.names else [None] * (b - a) for m in MASKS]
        yield from zip(range(a, b), x, y, *masks, strict=True)


class NpzGraphs(DataSource):
    """`spark.read.format("graph_npz")`: graphs in npz files, a task for each `block` of rows.

    Option `path` names files, comma-separated. Option `table` is `edges` (u, v as text, of the array edges or edge_index)
    or `nodes` (n, x, y, train_mask, val_mask, test_mask; null where the file lacks an array; rows of y that are vectors
    give the place of their largest number). Files without such arrays, and pickled ones, raise.
    """

    @classmethod
    def name(cls) -> str:
        return "graph_npz"

    def schema(self) -> str:
        return "u string, v string" if self._table() == "edges" else "n long, x array<double>, y string, train_mask boolean, val_mask boolean, test_mask boolean"

    def _table(self) -> str:
        table = self.options.get("table", "edges")
        if table not in ("edges", "nodes"):
            raise ValueError(f"no table {table} in graphs")
        return table

    def reader(self, schema) -> NpzReader:
        return NpzReader([p.strip() for p in self.options["path"].split(",")], self._table(), int(self.options.get("block", 1 << 18)))


def read_npz(spark: SparkSession, path: str, table: str = "edges", block: int = 1 << 18) -> DataFrame:
    """A table of npz files, as NpzGraphs says."""
    spark.dataSource.register(NpzGraphs)
    return spark.read.format("graph_npz").option("table", table).option("block", block).load(path)


def _xml(spark: SparkSession, path: str, tag: str, fields: list[StructField]) -> DataFrame:
    return spark.read.format("xml").options(rowTag=tag, mode="FAILFAST").schema(StructType(fields)).load(path)


def read_graphml(spark: SparkSession, path: str) -> DataFrame:
    """(u, v) as text of the edges of GraphML files, which are split among tasks; a malformed edge raises."""
    found = _xml(spark, path, "edge", [StructField("_source", StringType()), StructField("_target", StringType())])
    end = lambda c: F.coalesce(c, F.raise_error(F.lit("an edge without an end")).cast("string"))
    return found.select(end(F.col("_source")).alias("u"), end(F.col("_target")).alias("v"))


def read_graphml_attributes(spark: SparkSession, path: str) -> DataFrame:
    """(n, name, value) as text of the nodes of GraphML files; nodes without data give a row of nulls, so that none is lost."""
    data = ArrayType(StructType([StructField("_key", StringType()), StructField("_VALUE", StringType())]))
    nodes = _xml(spark, path, "node", [StructField("_id", StringType()), StructField("data", data)]).select(F.col("_id").alias("n"), F.explode_outer("data").alias("d"))
    keys = _xml(spark, path, "key", [StructField("_id", StringType()), StructField("_attr.name", StringType())]).select(F.col("_id").alias("key"), F.col("`_attr.name`").alias("name")).distinct()
    return nodes.select("n", F.col("d._key").alias("key"), F.col("d._VALUE").alias("value")).join(keys, "key", "left").select("n", F.coalesce("name", "key").alias("name"), "value")


def read_graph(spark: SparkSession, path: str) -> DataFrame:
    """(u, v) as text, simple and undirected, of a file by its ending; another ending raises."""
    ending = next((e for e in ENDINGS if path.lower().endswith(e)), None)
    if ending is None:
        raise ValueError(f"no graph is read from {path}")
    read = {".gml": read_gml_edges, ".graphml": read_graphml, ".npz": read_npz}.get(ending, read_tokens)
    found = read(spark, path)
    return normalised(found.select(F.col("u").cast("string").alias("u"), F.col("v").cast("string").alias("v")))


def relabelled(edges: DataFrame, nodes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(edges, mapping): edges between the places of nodes (n) in ascending order, from 0, and mapping (n, place).

    Edges with an end that is no node go.
    """
    mapping = staged(ranked(nodes.select("n").where("n IS NOT NULL").distinct(), [F.col("n")], "place").select("n", (F.col("place") - 1).alias("place")), "mapping")
    return through(edges, mapping), mapping


def through(edges: DataFrame, mapping: DataFrame) -> DataFrame:
    """(u, v): edges between the places that mapping (n, place) gives their ends; those with an end that it lacks go."""
    for end in "uv":
        edges = edges.join(mapping.select(F.col("n").alias(end), "place"), end).withColumn(end, F.col("place")).drop("place")
    return normalised(edges)


def sanitised(edges: DataFrame, count: int) -> DataFrame:
    """(u, v): the edges between different whole numbers from 0 up to count, whatever the type of their ends."""
    whole = lambda c: F.expr(f"try_cast({c} AS bigint)")
    ends = edges.select(whole("u").alias("u"), whole("v").alias("v"))
    return normalised(ends.where(functools.reduce(lambda a, b: a & b, [F.col(c).between(0, count - 1) for c in "uv"])))


def class_numbers(rows: DataFrame, label: str = "label") -> DataFrame:
    """rows with `y`, the place of their label among all, from 0: in order of numbers if all labels are finite ones, else of text.

    Labels that are equal as numbers are one class, then. A null label is an error.
    """
    number = F.expr(f"try_cast(`{label}` AS double)")
    finite: Column = F.coalesce(F.abs(number) < float("inf"), F.lit(False))
    text = F.col(label).cast("string")
    kinds = rows.agg(F.coalesce(F.bool_and(finite), F.lit(False)).alias("numbers"), F.coalesce(F.bool_or(F.col(label).isNull()), F.lit(False)).alias("missing")).first()
    if kinds["missing"]:
        raise ValueError("a row has no label")
    key = number if kinds["numbers"] else text
    classes = ranked(rows.select(key.alias("_key")).distinct(), [F.col("_key")], "y").select("_key", (F.col("y") - 1).alias("y"))
    return rows.withColumn("_key", key).join(classes, "_key").drop("_key")


def masked(nodes: DataFrame, seed: int = 42) -> DataFrame:
    """nodes (n, y, train_mask, val_mask, test_mask) with masks: their own if each of the three is there, else a split by class.

    A mask is there if any of its rows is not null; null then means False. A split that has no part of a kind moves the
    first node of another part there.
    """
    there = nodes.agg(*[F.coalesce(F.bool_or(F.col(m).isNotNull()), F.lit(False)).alias(m) for m in MASKS]).first()
    if all(there):
        return nodes.withColumns({m: F.coalesce(m, F.lit(False)) for m in MASKS})
    split = staged(class_split(nodes, "n", "y", seed=seed).select("n", "part"), "split")
    first = {r["part"]: r["n"] for r in split.groupBy("part").agg(F.min("n").alias("n")).collect()}  # three rows at most
    part = F.col("part")
    if first and "val" not in first:
        part = F.when(F.col("n") == first["train"], "val").otherwise(part)
    if first and "test" not in first:
        part = F.when(F.col("n") == first.get("val", first["train"]), "test").otherwise(part)
    return nodes.drop(*MASKS).join(split.withColumn("part", part), "n").withColumns({m: F.col("part") == m.removesuffix("_mask") for m in MASKS}).drop("part")


def write_added(original: DataFrame, published: DataFrame, path: str) -> None:
    """Lines `u v`, in order, of the edges that only the published graph has."""
    new = published.select("u", "v").join(original, ["u", "v"], "left_anti")
    new.orderBy("u", "v").select(F.concat_ws(" ", "u", "v").alias("value")).write.text(path)


def int_list(text: str) -> tuple[int, ...]:
    """The whole numbers of a comma-separated list; empty places are skipped, anything else raises."""
    return tuple(int(t) for t in text.split(",") if t.strip())
