import random

import pytest

from veilgraph.operators import hierarchy


def plain_label(parent, labels):
    def up(x):
        out = [x]
        while out[-1] in parent:
            out.append(parent[out[-1]])
        return out if out[-1] == "*" else [*out, "*"]

    return next(x for x in up(labels[0]) if all(x in up(y) for y in labels))


def plain_leaves(parent, label):
    inner = set(parent.values())
    if label not in inner:
        return 1
    return sum(plain_leaves(parent, c) for c, p in parent.items() if p == label)


def rows(spark, parent):
    return spark.createDataFrame(list(parent.items()), "child string, parent string")


@pytest.mark.parametrize("kind", ["random", "deep", "star"])
def test_labels_of_groups(spark, kind):
    rng = random.Random(kind)
    names = [f"x{i}" for i in range(40 if kind == "random" else 150)]
    parent = {"deep": lambda i: names[i - 1] if i else "*", "star": lambda i: "*", "random": lambda i: names[rng.randrange(i)] if i > 2 else "*"}[kind]
    tree = {x: parent(i) for i, x in enumerate(names)}
    groups = {g: [rng.choice([*names, "*"]) for _ in range(rng.randrange(1, 5))] for g in range(30)} | {90: ["strange", "strange"], 91: ["strange", "x1"], 92: [None, "x1"], 93: ["x7"] * 3}
    members = spark.createDataFrame([(g, x) for g, labels in groups.items() for x in labels], "g long, label string")
    got = {r["g"]: r for r in hierarchy.common_labels(rows(spark, tree), members).collect()}
    assert set(got) == set(groups)
    total = plain_leaves(tree, "*")
    for g, labels in groups.items():
        label = plain_label(tree, [x or "*" for x in labels])
        leaves = plain_leaves(tree, label)
        assert (got[g]["label"], got[g]["leaves"], got[g]["size"]) == (label, leaves, len(labels)), g
        assert abs(got[g]["ncp"] - leaves / total) < 1e-12 and abs(got[g]["cost"] - len(labels) * leaves / total) < 1e-9


def test_tour_nests_nodes(spark):
    tree = {"a": "*", "b": "*", "c": "a", "d": "a", "e": "d", "lone": "top"}
    at = {r["node"]: r for r in hierarchy.tour(rows(spark, tree)).collect()}
    assert set(at) == {*tree, "*", "top"} and at["top"]["parent"] == "*" and at["*"]["leaves"] == 4
    below = {x: {y for y in at if at[x]["enter"] <= at[y]["enter"] and at[y]["leave"] <= at[x]["leave"]} for x in at}
    assert below["a"] == {"a", "c", "d", "e"} and below["d"] == {"d", "e"} and below["*"] == set(at) and below["b"] == {"b"}
    assert [r["node"] for r in hierarchy.tour(rows(spark, {"*": "*"})).collect()] == ["*"]


def test_trees_that_are_none(spark):
    with pytest.raises(ValueError, match="two parents"):
        hierarchy.tour(spark.createDataFrame([("a", "b"), ("a", "*")], "child string, parent string"))
    for loop in ({"a": "b", "b": "a"}, {"a": "b", "b": "c", "c": "a", "d": "*"}):
        with pytest.raises(ValueError, match="cycle"):
            hierarchy.tour(rows(spark, loop))
