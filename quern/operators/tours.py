"""Walks of trees of any size, as joins over an Euler tour.

Every edge is two arcs, and the arc after u -> v leaves v to the neighbour that follows u in the
list of v's neighbours, so the arcs of a tree form one circle.  Places in the circle come from
pointer doubling: in each round every arc looks twice as far ahead, so a circle of n arcs takes
log n rounds.  All else is arithmetic on places: to root a tree elsewhere turns the circle; an
edge leads down where its arc away from the root comes first; a subtree is a stretch of the
circle, half as many rows as arcs; and sums along the path from the root are sums of a stretch
in which each edge counts on its way down and is taken back on its way up.

A tree may hold any share of all rows.  Only the neighbours of one node meet in one task; in a
mutual k-nearest-neighbour graph these are k at most.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from quern.operators.ranks import FEW
from quern.stages import stored

#: Places in a block when sums along a circle are taken.
BLOCK = 65_536


def _by_part(rows: DataFrame, table: DataFrame) -> DataFrame:
    """Joins a table with one row a tree, which may be a few large trees or very many."""
    return rows.join(F.broadcast(table) if table.count() <= FEW else table, "part")


def euler_tour(edges: DataFrame) -> DataFrame:
    """(part, a, b, w, len, ab, ba) from edges (part, u, v, w): the places, from 0, of both arcs
    of every edge in the circle of its tree, and the length of the circle."""
    arcs = edges.select("part", F.col("u").alias("s"), F.col("v").alias("t"), "w").unionByName(edges.select("part", F.col("v").alias("s"), F.col("u").alias("t"), "w"))
    around = W.partitionBy("part", "s").orderBy("t")
    whole = around.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    after = F.coalesce(F.lead("t").over(around), F.first("t").over(whole))
    # the row (s, t) tells what comes after the arc t -> s
    step = arcs.select("part", F.col("t").alias("u"), F.col("s").alias("v"), "w", F.col("s").alias("x"), after.alias("y"))
    start = stored(arcs.groupBy("part").agg(F.min(F.struct("s", "t")).alias("start"), F.count(F.lit(1)).alias("len")), "starts")
    last = F.struct(F.col("x").alias("s"), F.col("y").alias("t")) == F.col("start")
    open_end = lambda c: F.when(~last, F.col(c))
    now = stored(_by_part(step, start).select("part", "u", "v", "w", "len", open_end("x").alias("x"), open_end("y").alias("y"), F.when(last, 0).otherwise(1).cast("long").alias("ahead")), "circle")
    while not now.where("x is not null").isEmpty():
        on = now.select(F.col("u").alias("x"), F.col("v").alias("y"), F.col("x").alias("x2"), F.col("y").alias("y2"), F.col("ahead").alias("more"))
        far = now.join(on, ["x", "y"], "left")  # ids are unique over trees
        now = stored(far.select("part", "u", "v", "w", "len", F.col("x2").alias("x"), F.col("y2").alias("y"), (F.col("ahead") + F.coalesce("more", F.lit(0))).alias("ahead")), "circle")
    place = F.col("len") - 1 - F.col("ahead")
    low = F.col("u") < F.col("v")
    both = now.groupBy("part", F.least("u", "v").alias("a"), F.greatest("u", "v").alias("b"))
    return stored(both.agg(F.first("w").alias("w"), F.first("len").alias("len"), F.max(F.when(low, place)).alias("ab"), F.max(F.when(~low, place)).alias("ba")), "tour")


def rooted(tour: DataFrame, roots: DataFrame) -> DataFrame:
    """(part, parent, node, w, down, up) of every node but the roots (part, root): the edge to
    its parent, and the places of its arcs when the circle starts at the root."""
    out = tour.select("part", F.col("a").alias("node"), F.col("ab").alias("at")).unionByName(tour.select("part", F.col("b").alias("node"), F.col("ba").alias("at")))
    own = out.join(roots.select("part", F.col("root").alias("node")), ["part", "node"])
    start = stored(own.groupBy("part").agg(F.min("at").alias("start")), "starts")
    turned = _by_part(tour, start)
    ab, ba = F.pmod(F.col("ab") - F.col("start"), F.col("len")), F.pmod(F.col("ba") - F.col("start"), F.col("len"))
    pick = lambda yes, no: F.when(ab < ba, yes).otherwise(no)
    return turned.select("part", pick(F.col("a"), F.col("b")).alias("parent"), pick(F.col("b"), F.col("a")).alias("node"), "w", F.least(ab, ba).alias("down"), F.greatest(ab, ba).alias("up"))


def path_sums(nodes: DataFrame, value: Column, name: str) -> DataFrame:
    """Adds the sum of a value over the nodes from the root (not counted) to each node.

    Sums are taken inside blocks of places and shifted by those of the blocks before."""
    events = nodes.select("part", F.col("down").alias("at"), value.alias("x")).unionByName(nodes.select("part", F.col("up").alias("at"), (-value).alias("x")))
    events = events.withColumn("block", F.floor(F.col("at") / BLOCK))
    blocks = events.groupBy("part", "block").agg(F.sum("x").alias("whole"))
    before = F.coalesce(F.sum("whole").over(W.partitionBy("part").orderBy("block").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    shift = stored(blocks.select("part", "block", before.alias("before")), "blocks")
    inside = events.withColumn("inside", F.sum("x").over(W.partitionBy("part", "block").orderBy("at")))
    upto = inside.join(F.broadcast(shift) if shift.count() <= FEW else shift, ["part", "block"]).select("part", F.col("at").alias("down"), (F.col("before") + F.col("inside")).alias(name))
    return nodes.join(upto, ["part", "down"])


def _farthest(nodes: DataFrame) -> DataFrame:
    """(part, root): the node farthest from the root, ties to the smaller id."""
    best = nodes.groupBy("part").agg(F.max(F.struct("depth", (-F.col("node")).alias("less"))).alias("best"))
    return best.select("part", (-F.col("best.less")).alias("root"))


def centres(tour: DataFrame) -> DataFrame:
    """(part, root): the middle of a longest path of each tree, by weight.

    The path goes from the node farthest from the smallest one to the node farthest from that;
    its middle is its last node, seen from the second end, at half the length or more from the
    first."""
    first = tour.groupBy("part").agg(F.min(F.least("a", "b")).alias("root"))
    one_end = stored(_farthest(path_sums(rooted(tour, first), F.col("w"), "depth")), "ends")
    nodes = stored(path_sums(rooted(tour, one_end), F.col("w"), "depth"), "depths")
    other = _farthest(nodes)
    last = stored(nodes.join(other.select("part", F.col("root").alias("node")), ["part", "node"]).select("part", F.col("down").alias("d"), F.col("up").alias("u"), (F.col("depth") / 2).alias("half")), "ends")
    above = _by_part(nodes, last).where("down <= d and up >= u and depth >= half")
    return stored(above.groupBy("part").agg(F.min(F.struct("depth", "node")).alias("best")).select("part", F.col("best.node").alias("root")), "centres")


def preorder(edges: DataFrame, beta: float = 0.3, gamma: float = 1e-4, roots: DataFrame | None = None) -> DataFrame:
    """(part, place, vec_id): depth-first order of every tree (part, u, v, w) from its centre, or
    from its row of ``roots`` (part, root).

    Children come in order of the weight of their edge, plus ``beta`` times the lightest edge
    onward, less ``gamma`` for each row below; ties to the smaller id.  A node's place is that of
    its parent and one, plus the rows below the children before it.
    """
    tour = euler_tour(edges)
    roots = centres(tour) if roots is None else roots
    nodes = stored(rooted(tour, roots).withColumn("size", ((F.col("up") - F.col("down") + 1) / 2).cast("long")), "rooted")
    onward = nodes.groupBy("part", F.col("parent").alias("node")).agg(F.min("w").alias("onward"))
    keyed = nodes.join(onward, ["part", "node"], "left").withColumn("key", F.col("w") + beta * F.coalesce("onward", F.lit(0.0)) - gamma * F.col("size"))
    before = F.coalesce(F.sum("size").over(W.partitionBy("part", "parent").orderBy("key", "node").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    ranked = stored(keyed.withColumn("ahead", before + 1).select("part", "node", "down", "up", "ahead"), "children")
    placed = path_sums(ranked, F.col("ahead"), "place").select("part", "place", F.col("node").alias("vec_id"))
    return placed.unionByName(roots.select("part", F.lit(0).cast("long").alias("place"), F.col("root").alias("vec_id")))
