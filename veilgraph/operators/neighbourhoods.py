"""Labelled neighbourhoods: canonical codes of their components, exact isomorphism classes and the cost of a pair.

A neighbourhood is the graph among a node's neighbours, whose nodes carry labels. Its components are (ego, c), c their
least node. Small ones get the least string of labels and adjacency that any order of their nodes gives; larger ones a
signature of fixed width, from sums of hashes, so that no component is ever gathered for it.
"""

from __future__ import annotations

import json
from collections import Counter
from collections.abc import Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veilgraph.operators.hierarchy import ancestors, leaf_costs
from veilgraph.operators.structure import ego_graphs
from veilgraph.plans.staging import discard, staged

#: Nodes of the largest component that is coded by orders of its nodes, and the label of nodes that have none.
LIMIT, NO_LABEL = 8, "*"
_KEY = ["ego", "c"]


def _digest(c: Column) -> Column:
    """Of a group: a sum of hashes, the same in any order of its rows and, but for odds of 2 ** -64, for no other rows."""
    return F.xxhash64(F.sum(F.xxhash64(c).cast("decimal(20,0)")))


def least_code(labels: list[str], edges: list[tuple[int, int]]) -> str:
    """The least of all orders' (labels, upper triangle of the adjacency matrix by rows), as JSON labels and bits.

    Labels come first, so nodes of a label stay together. A node put next makes its row least by having, in each set of
    nodes still alike, those that are no neighbours of it first; that splits the set, and only nodes whose rows are
    least go on.
    """
    near: list[set[int]] = [set() for _ in labels]
    for i, j in edges:
        near[i].add(j)
        near[j].add(i)
    states = [[[i for i, x in enumerate(labels) if x == label] for label in sorted(set(labels))]]
    bits = []
    for _ in labels:
        rows: dict[tuple, list] = {}
        for cells in states:
            for v in cells[0]:
                left = [c for c in ([x for x in cells[0] if x != v], *cells[1:]) if c]
                row = tuple(b for c in left for b in sorted(x in near[v] for x in c))
                split = [part for c in left for part in ([x for x in c if x not in near[v]], [x for x in c if x in near[v]]) if part]
                rows.setdefault(row, []).append(split)
        best = min(rows)
        bits += ["01"[b] for b in best]
        states = list({tuple(map(tuple, cells)): cells for cells in rows[best]}.values())
    return json.dumps(sorted(labels), ensure_ascii=False) + "".join(bits)


def _coded(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for part in parts:
        part["code"] = [least_code(list(x), [(int(i), int(j)) for i, j in zip(a, b, strict=True)]) for x, a, b in zip(part["labels"], part["a"], part["b"], strict=True)]
        yield part[["shape", "code"]]


def _nodes(edges: DataFrame, labels: DataFrame | None) -> tuple[DataFrame, DataFrame]:
    """((ego, c, p, label, d, around), (ego, p, q)): nodes of components with their degree and a digest of their
    neighbours' degrees within it, and the edges both ways."""
    part, ways = ego_graphs(edges)
    local = staged(ways.groupBy("ego", "p").agg(F.count(F.lit(1)).alias("d")), "local")
    around = ways.join(local.select("ego", F.col("p").alias("q"), F.col("d").alias("e")), ["ego", "q"]).groupBy("ego", "p").agg(_digest(F.col("e")).alias("around"))
    rows = part.join(local, ["ego", "p"], "left").join(around, ["ego", "p"], "left")
    named = rows.withColumn("label", F.lit(NO_LABEL)) if labels is None else rows.join(labels.select(F.col("n").alias("p"), F.col("label").cast("string").alias("label")), "p", "left")
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    return staged(named.select("ego", "c", "p", F.coalesce("label", F.lit(NO_LABEL)).alias("label"), zero("d"), zero("around")), "nodes"), ways


def _ordered(nodes: DataFrame, ways: DataFrame, by: list) -> DataFrame:
    """(ego, c, labels, ids, a, b): a row a component, its nodes in order of `by` and p, its edges as places in that order."""
    at = staged(nodes.withColumn("i", (F.row_number().over(Window.partitionBy(*_KEY).orderBy(*by, "p")) - 1).cast("long")), "places")
    ends = ways.where("p < q").join(at.select("ego", "c", "p", F.col("i").alias("x")), ["ego", "p"]).join(at.select("ego", F.col("p").alias("q"), F.col("i").alias("y")), ["ego", "q"])
    links = ends.groupBy(*_KEY).agg(F.array_sort(F.collect_list(F.struct(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")))).alias("e"))
    lists = at.groupBy(*_KEY).agg(F.array_sort(F.collect_list(F.struct("i", "p", "label"))).alias("v"))
    none = F.array().cast("array<long>")
    return lists.join(links, _KEY, "left").select(*_KEY, F.col("v.label").alias("labels"), F.col("v.p").alias("ids"), F.coalesce("e.a", none).alias("a"), F.coalesce("e.b", none).alias("b"))


def _sizes(nodes: DataFrame) -> DataFrame:
    """(ego, c, size, edges, large) of components; large is the signature: sizes and digests of labels, degrees and
    neighbours' degrees."""
    d = nodes.groupBy(*_KEY).agg(F.count(F.lit(1)).alias("size"), (F.sum("d") / 2).cast("long").alias("edges"), *[_digest(F.col(c)).alias(f"x_{c}") for c in ("label", "d", "around")])
    return d.select(*_KEY, "size", "edges", F.concat_ws(":", F.lit("LARGE"), *[F.col(c).cast("string") for c in ("size", "edges", "x_label", "x_d", "x_around")]).alias("large"))


def _component_codes(nodes: DataFrame, ways: DataFrame, limit: int) -> DataFrame:
    """(ego, c, size, edges, code). Components that look alike in order of label, degree and neighbours' degrees are one
    shape, and only different shapes are coded."""
    sizes = staged(_sizes(nodes), "sizes")
    small = sizes.where(F.col("size") <= limit).select(*_KEY)
    shaped = staged(_ordered(nodes.join(small, _KEY, "left_semi"), ways, ["label", "d", "around"]).select(*_KEY, "labels", "a", "b", F.md5(F.to_json(F.struct("labels", "a", "b"))).alias("shape")), "shapes")
    shapes = shaped.groupBy("shape").agg(*[F.first(c).alias(c) for c in ("labels", "a", "b")])
    codes = staged(shapes.mapInPandas(_coded, "shape string, code string"), "codes")
    exact = shaped.select(*_KEY, "shape").join(codes, "shape").select(*_KEY, "code")
    return sizes.join(exact, _KEY, "left").select(*_KEY, "size", "edges", F.coalesce("code", "large").alias("code"))


def _joined(components: DataFrame) -> DataFrame:
    """(n, code) of (ego, size, edges, code): different components ascending, each with how often it occurs."""
    counts = components.groupBy("ego", "size", "edges", "code").agg(F.count(F.lit(1)).alias("times"))
    rows = F.transform(F.array_sort(F.collect_list(F.struct("size", "edges", "code", "times"))), lambda c: F.concat(c["times"].cast("string"), F.lit("x"), c["code"]))
    return counts.groupBy(F.col("ego").alias("n")).agg(F.array_join(rows, "|").alias("code"))


def neighbourhood_codes(edges: DataFrame, labels: DataFrame | None = None, limit: int = LIMIT) -> DataFrame:
    """(n, code) of nodes with an edge: equal for nodes whose neighbourhoods are isomorphic with their labels (n, label).

    Up to `limit` nodes a component the converse holds too; beyond it the code is a signature.
    """
    nodes, ways = _nodes(edges, labels)
    return _joined(_component_codes(nodes, ways, limit))


def isomorphic(colours: tuple[list, list], edges: tuple[set, set]) -> bool:
    """Whether nodes 0..n-1 can be mapped so that colours and edges (pairs a < b) of one graph become the other's.

    Backtracking: nodes of rare colours first, then next to those mapped already.
    """
    (p, q), (e, f) = colours, edges
    if Counter(p) != Counter(q) or len(e) != len(f):
        return False
    n, rare = len(p), Counter(p)
    near = [{i: set() for i in range(n)} for _ in range(2)]
    for side, pairs in enumerate((e, f)):
        for a, b in pairs:
            near[side][a].add(b)
            near[side][b].add(a)
    order, left = [], set(range(n))
    while left:
        order.append(min(left, key=lambda i: (-sum(x in near[0][i] for x in order), rare[p[i]], -len(near[0][i]), i)) if n < 64 else min(left, key=lambda i: (rare[p[i]], -len(near[0][i]), i)))
        left.remove(order[-1])
    to: dict[int, int] = {}
    used: set[int] = set()
    tries = [iter(range(n))]
    while tries:
        i = order[len(tries) - 1]
        for j in tries[-1]:
            if j not in used and q[j] == p[i] and len(near[0][i]) == len(near[1][j]) and {to[x] for x in near[0][i] if x in to} == near[1][j] & used:
                to[i] = j
                used.add(j)
                break
        else:
            tries.pop()
            if tries:
                used.remove(to.pop(order[len(tries) - 1]))
            continue
        if len(to) == n:
            return True
        tries.append(iter(range(n)))
    return n == 0


def _matched(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for part in parts:
        ok = [k == r or isomorphic((list(p), list(q)), (set(zip(a, b, strict=True)), set(zip(c, d, strict=True)))) for k, r, p, a, b, q, c, d in part[["key", "rep", "colours", "a", "b", "colours2", "a2", "b2"]].itertuples(index=False)]
        yield part[["key", "rep"]].assign(ok=ok)


def _refined(nodes: DataFrame, ways: DataFrame) -> DataFrame:
    """(ego, c, p, label, colour): colours from label and degree, split by the neighbours' colours until no more come."""
    now = staged(nodes.select("ego", "c", "p", "label", F.xxhash64("label", "d", "around").alias("colour")), "colours")
    before = 0
    while True:
        found = now.select("ego", "c", "colour").distinct().count()
        if found == before:
            return now
        before = found
        near = ways.join(now.select("ego", F.col("p").alias("q"), F.col("colour").alias("x")), ["ego", "q"]).groupBy("ego", "p").agg(_digest(F.col("x")).alias("x"))
        new = staged(now.join(near, ["ego", "p"], "left").select("ego", "c", "p", "label", F.xxhash64("colour", F.coalesce("x", F.lit(0))).alias("colour")), "colours")
        discard(now)
        now = new


def _component_classes(nodes: DataFrame, ways: DataFrame, components: DataFrame, limit: int) -> DataFrame:
    """(ego, c, class) of components over `limit` nodes: equal for isomorphic ones and no others.

    Colours are refined within all of them at once. Those alone in a bucket of sizes and colours are a class; the others
    are gathered, a row each, those of one text are one, and each round matches what is left of a bucket with its least.
    """
    large = nodes.join(components.where(F.col("size") > limit).select(*_KEY), _KEY, "left_semi")
    colours = _refined(staged(large, "large"), ways)
    buckets = staged(colours.groupBy(*_KEY).agg(F.count(F.lit(1)).alias("size"), _digest(F.col("colour")).alias("x")).select(*_KEY, F.concat_ws(":", "size", "x").alias("bucket")), "buckets")
    shared = buckets.groupBy("bucket").agg(F.count(F.lit(1)).alias("k")).where("k > 1").select("bucket")
    some = buckets.join(shared, "bucket", "left_semi")
    coloured = colours.join(some.select(*_KEY), _KEY, "left_semi").select("ego", "c", "p", F.col("colour").cast("string").alias("label"))
    lists = _ordered(coloured, ways, ["label"]).select(*_KEY, F.col("labels").alias("colours"), "a", "b")
    held = staged(lists.join(some, _KEY).withColumn("key", F.md5(F.to_json(F.struct("bucket", "colours", "a", "b")))), "members")
    left = staged(held.groupBy("key").agg(*[F.first(c).alias(c) for c in ("bucket", "colours", "a", "b")]), "unplaced")
    placed = []
    while left.limit(1).count():
        first = left.groupBy("bucket").agg(F.min("key").alias("key"))
        reps = left.join(first, ["bucket", "key"]).select("bucket", F.col("key").alias("rep"), F.col("colours").alias("colours2"), F.col("a").alias("a2"), F.col("b").alias("b2"))
        tried = staged(left.join(reps, "bucket").repartition("key").mapInPandas(_matched, "key string, rep string, ok boolean"), "tried")
        placed.append(tried.where("ok").select("key", "rep"))
        left = staged(left.join(tried.where("NOT ok").select("key"), "key", "left_semi"), "unplaced")
    alone = buckets.join(shared, "bucket", "left_anti").select(*_KEY, F.col("bucket").alias("class"))
    if not placed:
        return alone
    return alone.unionByName(held.select(*_KEY, "key").join(reduce(DataFrame.unionByName, placed), "key").select(*_KEY, F.col("rep").alias("class")))


def isomorphism_classes(edges: DataFrame, labels: DataFrame | None = None, limit: int = LIMIT) -> DataFrame:
    """(n, class) of nodes with an edge: the least node whose neighbourhood is isomorphic to n's, labels and all.

    Neighbourhoods are isomorphic if their components are, one by one; components of up to `limit` nodes are told by
    their codes, larger ones by matching.
    """
    nodes, ways = _nodes(edges, labels)
    components = staged(_component_codes(nodes, ways, limit), "components")
    exact = _component_classes(nodes, ways, components, limit)
    known = components.join(exact, _KEY, "left").select("ego", "size", "edges", F.coalesce("class", "code").alias("code"))
    codes = staged(_joined(known).select("n", F.md5("code").alias("code")), "classes")
    return codes.join(codes.groupBy("code").agg(F.min("n").alias("class")), "code").select("n", "class")


def _mapping_cost(a: dict, b: dict, apart, alpha: float, beta: float, limit: int) -> float:
    """Of components with as many nodes: alpha times the labels' cost and beta times the edges that only one has, by the
    cheapest mapping up to `limit` nodes, else by that of nodes in order of degree (descending), label and id."""
    n = a["size"]
    e, f = ({tuple(x) for x in zip(c["a"], c["b"], strict=True)} for c in (a, b))
    cost = [[alpha * apart(x, y) for y in b["labels"]] for x in a["labels"]]
    if n > limit:
        by = lambda c, d: sorted(range(n), key=lambda i: (-d[i], c["labels"][i]))
        to = dict(zip(by(a, _degrees(e)), by(b, _degrees(f)), strict=True))
        return sum(cost[i][j] for i, j in to.items()) + beta * len({tuple(sorted((to[i], to[j]))) for i, j in e} ^ f)
    least = [min(row) for row in cost]
    rest = [sum(least[i:]) for i in range(n + 1)]
    best, todo = float("inf"), [(0.0, ())]
    while todo:
        spent, to = todo.pop()
        i = len(to)
        if i == n:
            best = min(best, spent)
            continue
        steps = []
        for j in range(n):
            if j not in to:
                edges = sum(((x, i) in e) != ((min(y, j), max(y, j)) in f) for x, y in enumerate(to))
                steps.append((spent + cost[i][j] + beta * edges, (*to, j)))
        todo += [s for s in sorted(steps, reverse=True) if s[0] + rest[i + 1] < best]
    return best


def _degrees(edges: set) -> Counter:
    return Counter(x for e in edges for x in e)


def _component_key(c: dict) -> tuple:
    """What a node's components are ordered by: size, edges and code, larger ones' by all that the signature counts."""
    edges = list(zip(c["a"], c["b"], strict=True))
    if c["code"].startswith("["):
        at = c["code"].rindex("]") + 1
        return c["size"], c["edges"], tuple(json.loads(c["code"][:at])), c["code"][at:]
    near: list[list[int]] = [[] for _ in c["labels"]]
    for i, j in edges:
        near[i].append(j)
        near[j].append(i)
    return c["size"], c["edges"], ("LARGE",), sorted(c["labels"]), sorted(map(len, near)), sorted(sorted(len(near[x]) for x in y) for y in near)


def pair_cost(left: dict, right: dict, total: int, alpha: float, beta: float, gamma: float, limit: int) -> float:
    """What it costs to make two neighbourhoods alike: components of the one, largest first, each take the cheapest that
    the other has left; those without one cost gamma a node and beta an edge, and so do differences in size."""
    paths = {x["label"]: [(p["ancestor"], p["ncp"]) for p in x["path"]] for side in (left, right) for x in side["paths"]}

    def apart(x: str, y: str) -> float:
        up, other = (paths.get(z) or [(z, 1 / total)] for z in (x, y))
        names = {name for name, _ in other}
        return next((ncp for name, ncp in up if name in names), 1.0)

    a, b = (sorted(side["components"], key=_component_key) for side in (left, right))
    alone = lambda c: gamma * c["size"] + beta * c["edges"]
    spent, free = 0.0, list(range(len(b)))
    for c in sorted(a, key=lambda c: (-c["size"], -c["edges"])):
        costs = [(_mapping_cost(c, b[j], apart, alpha, beta, limit) if c["size"] == b[j]["size"] else gamma * abs(c["size"] - b[j]["size"]) + beta * abs(c["edges"] - b[j]["edges"]), j) for j in free]
        cost, j = min(costs, default=(alone(c), None))
        spent += cost
        free = [x for x in free if x != j]
    return spent + sum(alone(b[j]) for j in free)


def pair_costs(edges: DataFrame, pairs: DataFrame, labels: DataFrame | None = None, tree: DataFrame | None = None, alpha: float = 1.0, beta: float = 1.0, gamma: float = 1.0, limit: int = LIMIT) -> DataFrame:
    """(u, v, cost) of pairs of nodes, as pair_cost() of their neighbourhoods; a node without an edge has none to match.

    Two labels cost the share of all leaves of the tree (child, parent) that are below their first common ancestor: 1
    where that is the root, or without a tree. Each node's neighbourhood is a row, and each pair is met on its own.
    """
    nodes, ways = _nodes(edges, labels)
    codes = _component_codes(nodes, ways, limit)
    lists = _ordered(nodes, ways, []).select(*_KEY, "labels", "a", "b")
    parts = codes.join(lists, _KEY).groupBy("ego").agg(F.collect_list(F.struct("size", "edges", "code", "labels", "a", "b")).alias("components"))
    total, names = 1, nodes.select("ego", "label").distinct()
    if tree is None:
        paths = names.select("ego", "label", F.array().cast("array<struct<up:int,ancestor:string,ncp:double>>").alias("path"))
    else:
        costs = leaf_costs(tree)
        up = ancestors(tree).join(costs.select(F.col("node").alias("ancestor"), "ncp"), "ancestor")
        path = up.groupBy(F.col("node").alias("label")).agg(F.array_sort(F.collect_list(F.struct("up", "ancestor", "ncp"))).alias("path"))
        total = max(costs.where("ncp = 1").agg(F.max("leaves")).first()[0] or 1, 1)
        paths = names.join(path, "label", "left").select("ego", "label", F.coalesce("path", F.array().cast("array<struct<up:int,ancestor:string,ncp:double>>")).alias("path"))
    known = parts.join(paths.groupBy("ego").agg(F.collect_list(F.struct("label", "path")).alias("paths")), "ego")
    records = staged(known.select(F.col("ego").alias("n"), F.to_json(F.struct("components", "paths")).alias("record")), "records")
    none = F.lit('{"components":[],"paths":[]}')
    met = pairs.select("u", "v").join(records.select(F.col("n").alias("u"), F.col("record").alias("x")), "u", "left").join(records.select(F.col("n").alias("v"), F.col("record").alias("y")), "v", "left")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            cost = [pair_cost(json.loads(x), json.loads(y), total, alpha, beta, gamma, limit) for x, y in zip(frame["x"], frame["y"], strict=True)]
            yield frame[["u", "v"]].assign(cost=cost)

    kinds = {c: pairs.schema[c].dataType.simpleString() for c in "uv"}
    return met.select("u", "v", F.coalesce("x", none).alias("x"), F.coalesce("y", none).alias("y")).mapInPandas(run, f"u {kinds['u']}, v {kinds['v']}, cost double")
