"""Label hierarchies: ancestors, leaves, common ancestors and the cost of generalising."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilgraph.operators.compare import ranked
from veilgraph.plans.staging import discard, staged


def ancestors(tree: DataFrame) -> DataFrame:
    """(node, ancestor, up) of (child, parent) rows: every node with itself at 0 and those above it.

    Each round joins the pairs with themselves, so that ways up to twice as long are known, until there are no more:
    trees of any depth and cycles come to an end.
    """
    ends = tree.select(F.explode(F.array("child", "parent")).alias("node")).select("node", F.col("node").alias("ancestor"), F.lit(0).alias("up"))
    steps = ends.unionByName(tree.select(F.col("child").alias("node"), F.col("parent").alias("ancestor"), F.lit(1).alias("up")))
    found, known = staged(steps.groupBy("node", "ancestor").agg(F.min("up").alias("up")), "tree"), -1
    while (pairs := found.count()) > known:
        known = pairs
        above = found.select(F.col("node").alias("ancestor"), F.col("ancestor").alias("top"), F.col("up").alias("more"))
        twice = found.join(above, "ancestor").groupBy("node", F.col("top").alias("ancestor")).agg(F.min(F.col("up") + F.col("more")).alias("up"))
        found = staged(twice, "tree")
    return found


def leaf_costs(tree: DataFrame) -> DataFrame:
    """(node, leaves, ncp): leaves below a node, itself if it is one, and their share of all."""
    leaf = tree.select(F.col("child").alias("node")).distinct().join(tree.select(F.col("parent").alias("node")).distinct(), "node", "left_anti")
    total = leaf.agg(F.count(F.lit(1)).alias("total"))
    below = ancestors(tree).join(leaf, "node").groupBy(F.col("ancestor").alias("node")).agg(F.count(F.lit(1)).alias("leaves"))
    return below.crossJoin(F.broadcast(total)).select("node", "leaves", (F.col("leaves") / F.col("total")).alias("ncp"))  # total is one row


def common_ancestor(tree: DataFrame, pairs: DataFrame) -> DataFrame:
    """(u, v, lca): the deepest node above both ends of each pair."""
    up = ancestors(tree)
    a = pairs.join(up.select(F.col("node").alias("u"), "ancestor", "up"), "u")
    both = a.join(up.select(F.col("node").alias("v"), "ancestor"), ["v", "ancestor"])
    return both.groupBy("u", "v").agg(F.min_by("ancestor", "up").alias("lca"))


def tour(tree: DataFrame, root: str = "*") -> DataFrame:
    """(node, parent, enter, leave, leaves) of (child, parent) rows: the places at which a walk around the tree enters and leaves
    a node. A node lies below another if its places are within the other's.

    Nodes without a parent hang from the root. The walk is a list of arcs, two a node, and its places come from pointer
    doubling, so the depth of the tree costs rounds by its logarithm only. Two parents of a node or a cycle are errors.
    """
    given = tree.where("child IS NOT NULL").select("child", F.coalesce("parent", F.lit(root)).alias("parent")).where(F.col("child") != root).distinct()
    tops = given.select(F.col("parent").alias("child")).where(F.col("child") != root).distinct().join(given, "child", "left_anti").withColumn("parent", F.lit(root))
    below = staged(ranked(given.unionByName(tops), [F.col("parent"), F.col("child")], "place"), "tree")
    count = below.count()
    if count != below.select("child").distinct().count():
        raise ValueError("a node of the tree has two parents")
    first = below.groupBy(F.col("parent").alias("child")).agg(F.min("child").alias("first"))
    after = below.select((F.col("place") - 1).alias("place"), F.col("child").alias("sibling"), F.col("parent").alias("of"))
    known = below.join(first, "child", "left").join(after, "place", "left").select("child", "parent", "first", F.when(F.col("of") == F.col("parent"), F.col("sibling")).alias("sibling"))
    arc = lambda node, out: F.struct(node.alias("node"), F.lit(out).alias("out"))
    inward = F.when(F.col("first").isNotNull(), arc(F.col("first"), False)).otherwise(arc(F.col("child"), True))
    outward = F.when(F.col("sibling").isNotNull(), arc(F.col("sibling"), False)).when(F.col("parent") != root, arc(F.col("parent"), True))
    ways = known.select("parent", F.explode(F.array(
        F.struct(arc(F.col("child"), False).alias("arc"), inward.alias("next"), F.col("first").isNull().cast("long").alias("leaf")),
        F.struct(arc(F.col("child"), True).alias("arc"), outward.alias("next"), F.lit(0).cast("long").alias("leaf")),
    )).alias("x"))
    walk = staged(ways.select("x.arc", "x.next", F.lit(1).cast("long").alias("steps"), F.col("x.leaf").alias("leaf")), "walk")
    for _ in range(2 + math.ceil(math.log2(2 * count + 1))):
        if not walk.where("next IS NOT NULL").limit(1).count():
            break
        then = walk.select(F.col("arc").alias("next"), F.col("next").alias("then"), F.col("steps").alias("s"), F.col("leaf").alias("l"))
        longer = walk.join(then, "next", "left").select("arc", F.col("then").alias("next"), *[(F.col(a) + F.coalesce(b, F.lit(0))).alias(a) for a, b in (("steps", "s"), ("leaf", "l"))])
        walk, old = staged(longer, "walk"), walk
        discard(old)
    else:
        raise ValueError("the tree has a cycle")
    ends = walk.groupBy(F.col("arc.node").alias("child")).agg(*[F.max(F.when(F.col("arc.out") == out, F.col(c))).alias(name) for out, c, name in ((False, "steps", "a"), (True, "steps", "b"), (False, "leaf", "p"), (True, "leaf", "q"))])
    if ends.where("a IS NULL OR b IS NULL").limit(1).count() or ends.count() != count:
        raise ValueError("the tree has a cycle")
    nodes = below.join(ends, "child").select(F.col("child").alias("node"), "parent", (2 * count - F.col("a")).alias("enter"), (2 * count - F.col("b")).alias("leave"), (F.col("p") - F.col("q")).alias("leaves"))
    leaves = walk.agg(F.greatest(F.coalesce(F.max("leaf"), F.lit(1)), F.lit(1)).cast("long").alias("leaves"))
    top = leaves.select(F.lit(root).alias("node"), F.lit(None).cast("string").alias("parent"), F.lit(-1).cast("long").alias("enter"), F.lit(2 * count).cast("long").alias("leave"), "leaves")
    return staged(nodes.unionByName(top), "tour")


def common_labels(tree: DataFrame, members: DataFrame, root: str = "*") -> DataFrame:
    """(g, size, label, leaves, ncp, cost) of members (g, label): the deepest label above all of a group's, its leaves, their share
    of all leaves, and that share times the group's members.

    A label that is null is the root; one that the tree lacks is above itself only and counts as a leaf. The deepest label
    is looked for from the member that the walk around the tree enters first: it climbs 2 ** i nodes at a time as long as
    it is left before the last member is. All joins are on single nodes.
    """
    walk = tour(tree, root)
    counted = members.select("g", F.coalesce("label", F.lit(root)).alias("label")).groupBy("g", "label").agg(F.count(F.lit(1)).alias("c"))
    placed = counted.join(walk.select(F.col("node").alias("label"), "enter", "leave"), "label", "left")
    groups = placed.groupBy("g").agg(
        F.sum("c").alias("size"), F.count(F.lit(1)).alias("labels"), F.max(F.col("enter").isNull()).alias("strange"), F.min("label").alias("any"), F.min_by("label", "enter").alias("low"), F.max("leave").alias("high")
    )
    start = F.when(F.col("labels") == 1, F.col("any")).when(F.col("strange"), F.lit(root)).otherwise(F.col("low"))
    at = staged(groups.select("g", "size", start.alias("label"), F.when((F.col("labels") > 1) & ~F.col("strange"), F.col("high")).alias("high")), "groups")
    leave = walk.select(F.col("node").alias("top"), F.col("leave").alias("top_leave"))
    jumps = [staged(walk.where("parent IS NOT NULL").select(F.col("node").alias("label"), F.col("parent").alias("top")).join(leave, "top"), "jumps")]
    while True:
        again = jumps[-1].select(F.col("label").alias("top"), F.col("top").alias("then"), F.col("top_leave").alias("then_leave"))
        further = staged(jumps[-1].select("label", "top").join(again, "top").select("label", F.col("then").alias("top"), F.col("then_leave").alias("top_leave")), "jumps")
        if not further.limit(1).count():
            break
        jumps.append(further)
    own = walk.select(F.col("node").alias("label"), "leave")
    short = at.join(own, "label", "left").where("leave < high").select("g", "label", "high")
    for jump in reversed(jumps):
        climbed = F.when(F.col("top_leave") < F.col("high"), F.col("top")).otherwise(F.col("label"))
        short = short.join(jump, "label", "left").select("g", climbed.alias("label"), "high")
    found = short.join(jumps[0], "label").select("g", F.col("top").alias("above"))
    named = at.join(found, "g", "left").select("g", "size", F.coalesce("above", "label").alias("label"))
    leaves = walk.select(F.col("node").alias("label"), "leaves")
    total = walk.where("parent IS NULL").select(F.col("leaves").alias("total"))
    out = named.join(leaves, "label", "left").crossJoin(F.broadcast(total))  # total is one row
    out = out.select("g", "size", "label", F.coalesce("leaves", F.lit(1)).cast("long").alias("leaves"), (F.coalesce("leaves", F.lit(1)) / F.col("total")).alias("ncp"))
    return out.withColumn("cost", F.col("size") * F.col("ncp"))
