import numpy as np
import pytest
from pyspark.sql import functions as F
from test_graphs import frame, random_edges

from veilgraph.operators import evaluate
from veilgraph.sources import formats

GRAPHML = """<?xml version="1.0" encoding="UTF-8"?>
<graphml xmlns="http://graphml.graphdrawing.org/xmlns">
  <key id="d0" for="node" attr.name="label" attr.type="string"/>
  <graph edgedefault="undirected">
    <node id="a &amp; b"><data key="d0">red</data><data key="d9">7</data></node>
    <node id="c"/>
    <node id="lone"/>
    <edge source="c" target="a &amp; b"/>
    <edge id="e1" source="c" target="d"><data key="d1">3</data></edge>
    <edge source="d" target="d"/>
  </graph>
</graphml>
"""


def pairs(df):
    return sorted((r["u"], r["v"]) for r in df.collect())


@pytest.mark.parametrize("order", ["C", "F"])
@pytest.mark.parametrize("kind", ["edges", "edge_index"])
def test_npz_edges_come_back(spark, tmp_path, kind, order):
    edges = random_edges(50, 333, 1)
    array = np.array(edges, dtype=np.int32)
    path = str(tmp_path / "graph.npz")
    (np.savez if order == "C" else np.savez_compressed)(path, **{kind: np.asarray(array if kind == "edges" else array.T.copy(), order=order)})
    got = formats.read_npz(spark, path, block=100)
    assert got.rdd.getNumPartitions() == -(-len(edges) // 100)
    assert pairs(got) == sorted((str(u), str(v)) for u, v in edges)
    assert pairs(formats.sanitised(formats.read_graph(spark, path), 40)) == [(u, v) for u, v in edges if v < 40]


def test_npz_nodes(spark, tmp_path):
    path = str(tmp_path / "graph.npz")
    x, y, mask = np.arange(20.0).reshape(10, 2), np.eye(3)[[0, 1, 2, 0, 1, 2, 0, 1, 2, 2]], np.arange(10) < 4
    np.savez(path, edges=np.zeros((0, 2), int), x=x, y=y, train_mask=mask)
    rows = sorted(formats.read_npz(spark, path, "nodes", 3).collect())
    assert [(r["n"], r["x"], r["y"], r["train_mask"], r["test_mask"]) for r in rows] == [(i, x[i].tolist(), str(y[i].argmax()), bool(mask[i]), None) for i in range(10)]
    assert formats.read_npz(spark, path).count() == 0


def test_files_that_are_no_graphs_raise(spark, tmp_path):
    for name, arrays, message in (("a", {"other": np.zeros(3)}, "neither"), ("b", {"edges": np.zeros((3, 3))}, "no pairs"), ("c", {"edge_index": np.zeros((3, 2))}, "two rows"), ("d", {"edges": np.array([[None, 1]], dtype=object)}, "pickled")):
        path = str(tmp_path / f"{name}.npz")
        np.savez(path, **arrays)
        with pytest.raises(Exception, match=message):
            formats.read_npz(spark, path).collect()
    with pytest.raises(ValueError, match="no graph"):
        formats.read_graph(spark, str(tmp_path / "graph.pkl"))
    (tmp_path / "bad.graphml").write_text("<graphml><graph><edge source='a'/></graph></graphml>")
    with pytest.raises(Exception, match="without an end"):
        formats.read_graphml(spark, str(tmp_path / "bad.graphml")).collect()


def test_graphml(spark, tmp_path):
    path = tmp_path / "graph.graphml"
    path.write_text(GRAPHML)
    assert pairs(formats.read_graphml(spark, str(path))) == [("c", "a & b"), ("c", "d"), ("d", "d")]
    assert pairs(formats.read_graph(spark, str(path))) == [("a & b", "c"), ("c", "d")]
    found = {(r["n"], r["name"], r["value"]) for r in formats.read_graphml_attributes(spark, str(path)).collect()}
    assert found == {("a & b", "label", "red"), ("a & b", "d9", "7"), ("c", None, None), ("lone", None, None)}


def test_places_and_classes(spark):
    edges = spark.createDataFrame([("b", "a"), ("c", "b"), ("x", "a")], "u string, v string")
    got, mapping = formats.relabelled(edges, spark.createDataFrame([("c",), ("a",), ("b",), ("lone",), ("b",)], "n string"))
    assert pairs(got) == [(0, 1), (1, 2)] and {r["n"]: r["place"] for r in mapping.collect()} == {"a": 0, "b": 1, "c": 2, "lone": 3}
    ys = lambda labels: [r["y"] for r in formats.class_numbers(spark.createDataFrame(list(enumerate(labels)), "n long, label string")).orderBy("n").collect()]
    assert ys(["10", "9", "9.0", "-1"]) == [2, 1, 1, 0] and ys(["10", "9", "b"]) == [0, 1, 2] and ys(["nan", "9"]) == [1, 0] and ys([]) == []
    with pytest.raises(ValueError, match="no label"):
        ys(["a", None])
    assert pairs(formats.sanitised(spark.createDataFrame([("1", "2"), ("2", "1"), ("3", "3"), ("-1", "2"), ("x", "1"), ("1", "9"), (None, "1")], "u string, v string"), 9)) == [(1, 2)]
    assert formats.int_list("2, 5,,10") == (2, 5, 10)


def plain_sizes(n):
    if n <= 2:
        return (1, 0, n - 1)
    train, val = max(1, round(0.6 * n)), max(1, round(0.2 * n))
    if train + val >= n:
        val = max(1, val - (train + val - (n - 1)))
    if train + val >= n:
        train, val = max(1, n - 2), 1
    return (train, val, n - train - val)


def test_parts_of_small_classes(spark):
    rows = spark.createDataFrame([(1000 * n + i, n) for n in range(1, 24) for i in range(n)], "n long, y long")
    found = {r["y"]: (r["train"], r["val"], r["test"]) for r in evaluate.class_split(rows, "n", "y").groupBy("y").agg(*[F.sum((F.col("part") == p).cast("int")).alias(p) for p in ("train", "val", "test")]).collect()}
    assert found == {n: plain_sizes(n) for n in range(1, 24)}


def test_masks(spark):
    schema = "n long, y string, train_mask boolean, val_mask boolean, test_mask boolean"
    own = formats.masked(spark.createDataFrame([(1, "a", True, None, False), (2, "a", None, True, None), (3, "b", False, False, True)], schema))
    assert sorted(tuple(r)[2:] for r in own.select("n", "y", *formats.MASKS).collect()) == [(False, False, True), (False, True, False), (True, False, False)]
    part = lambda r: [m for m in formats.MASKS if r[m]]
    singles = formats.masked(spark.createDataFrame([(i, str(i), None, None, True) for i in range(4)], schema)).orderBy("n").collect()
    assert [part(r) for r in singles] == [["test_mask"], ["train_mask"], ["train_mask"], ["train_mask"]]  # the first goes on from val
    assert formats.masked(spark.createDataFrame([], schema)).collect() == []


def test_added_edges_are_written(spark, tmp_path):
    formats.write_added(frame(spark, [(1, 2)]), frame(spark, [(1, 2), (2, 10), (2, 9)]), str(tmp_path / "added"))
    assert [r["value"] for r in spark.read.text(str(tmp_path / "added")).collect()] == ["2 9", "2 10"]
