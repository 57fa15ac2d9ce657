"""Refining clusters of any size: cutting their spanning trees, pruning, and rescue.

A tree is cut at its longest edge while that is over ``ratio`` times the mean of its edges, and
so are the parts.  Edges that are not over that bound in the whole tree are contracted first,
with their sum and number kept for each contracted node, so one task can make thousands of cuts
of a tree exactly; a tree whose parts may be cut further goes through another round.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from quern.functions import vectors as V
from quern.operators.density import spanning_tree
from quern.operators.graph import connected_components
from quern.operators.neighbors import eps_join
from quern.stages import stored

#: Longest edges of a tree that one task looks at in a round.
CUTS = 4096
#: Edges of up to this length are never cut.
SHORT = 1e-4


def cuts_of(edges: list[tuple[float, int, int, int, int]], inside: dict[int, tuple[float, int]], ratio: float) -> list[tuple[int, int]]:
    """The cut edges (u, v) of a tree of contracted nodes, from its edges (w, u, v, a, b) between
    nodes a, b and each node's sum and number of edges inside."""
    near: dict[int, list[int]] = {}
    for k, (_, _, _, a, b) in enumerate(edges):
        near.setdefault(a, []).append(k)
        near.setdefault(b, []).append(k)
    alive, out, work = [True] * len(edges), [], [next(iter(near))] if near else []
    while work:
        seen, stack, own, total, count = {work[-1]}, [work.pop()], set(), 0.0, 0
        while stack:
            node = stack.pop()
            s, n = inside.get(node, (0.0, 0))
            total, count = total + s, count + n
            for k in near[node]:
                if alive[k] and k not in own:
                    own.add(k)
                    total, count = total + edges[k][0], count + 1
                    for x in edges[k][3:]:
                        if x not in seen:
                            seen.add(x)
                            stack.append(x)
        if own:
            best = max(own, key=lambda k: (edges[k][0], [-x for x in edges[k][1:3]]))
            w, u, v, a, b = edges[best]
            if w > ratio * total / count and w > SHORT:
                alive[best] = False
                out.append((u, v))
                work += [a, b]
    return out


def split_trees(edges: DataFrame, ratio: float = 2.4, most: int = CUTS) -> DataFrame:
    """The edges (tree, u, v, w) that are left when no tree has one to be cut.

    Each round makes at least the first cut of every tree that has one."""
    final = []
    left = stored(edges.select("tree", "u", "v", "w"), "trees")
    while True:
        mean = left.groupBy("tree").agg(F.avg("w").alias("mean"))
        long = left.join(mean, "tree").where((F.col("w") > ratio * F.col("mean")) & (F.col("w") > SHORT))
        place = F.row_number().over(W.partitionBy("tree").orderBy(F.desc("w"), "u", "v"))
        long = stored(long.withColumn("place", place).where(F.col("place") <= most).select("tree", "u", "v", "w"), "long")
        if long.isEmpty():
            final.append(left)
            break
        trees = stored(long.select("tree").distinct(), "cut")
        final.append(stored(left.join(trees, "tree", "left_anti"), "done"))
        left = stored(left.join(trees, "tree", "left_semi"), "trees")
        short = stored(left.join(long.select("u", "v"), ["u", "v"], "left_anti"), "short")
        comp = stored(connected_components(short, "u", "v"), "contracted")
        of = lambda end, name: comp.select(F.col("node").alias(end), F.col("component").alias(name))
        sums = short.join(of("u", "a"), "u").groupBy("tree", "a").agg(F.sum("w").alias("total"), F.count(F.lit(1)).alias("n"))
        between = long.join(of("u", "a"), "u", "left").join(of("v", "b"), "v", "left").select("tree", "u", "v", "w", F.coalesce("a", "u").alias("a"), F.coalesce("b", "v").alias("b"))

        def run(rows: pa.Table, inner: pa.Table) -> pa.Table:
            own = dict(zip(inner.column("a").to_pylist(), zip(inner.column("total").to_pylist(), inner.column("n").to_pylist(), strict=True), strict=True))
            cut = cuts_of(list(zip(*(rows.column(c).to_pylist() for c in ("w", "u", "v", "a", "b")), strict=True)), own, ratio)
            return pa.table({"u": pa.array([u for u, _ in cut], pa.int64()), "v": pa.array([v for _, v in cut], pa.int64())})

        cut = stored(between.groupBy("tree").cogroup(sums.groupBy("tree")).applyInArrow(run, "u long, v long"), "cuts")
        rest = stored(left.join(cut, ["u", "v"], "left_anti").select("u", "v", "w"), "rest")
        comp = connected_components(rest, "u", "v")
        left = stored(rest.join(comp.select(F.col("node").alias("u"), F.col("component").alias("tree")), "u").select("tree", "u", "v", "w"), "trees")
    out = final[0]
    for f in final[1:]:
        out = out.unionByName(f)
    return out


def refined(rows: DataFrame, eps: float, min_size: int, sigma: float = 2.0, density: float = 0.6, rescue: float = 0.75) -> DataFrame:
    """(vec_id, label) of the rows kept of clusters (vec_id, embedding, cluster_id).

    Each cluster is cut in parts by its tree; rows of a part beyond ``sigma`` deviations of the
    mean distance to its mean go; a part that is then too wide for ``eps`` keeps its components
    at a shorter range.  What has fewer than ``min_size`` rows at any step goes.
    """
    rows = stored(rows.select("vec_id", "embedding", "cluster_id"), "rows")
    sized = lambda df, key: df.groupBy(key).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= min_size)
    rows = stored(rows.join(sized(rows, "cluster_id").select("cluster_id"), "cluster_id", "left_semi"), "rows")
    numbers = stored(rows.groupBy("cluster_id").agg(F.min("vec_id").alias("tree")), "numbers")
    tree = spanning_tree(rows.join(numbers, "cluster_id"), group="tree")
    placed = rows.join(numbers, "cluster_id").select(F.col("vec_id").alias("u"), "tree")
    comp = connected_components(split_trees(tree.join(placed, "u")), "u", "v").select(F.col("node").alias("vec_id"), F.col("component").alias("part"))
    parts = stored(rows.join(comp, "vec_id", "left").select("vec_id", "embedding", F.coalesce("part", "vec_id").alias("part")), "parts")

    def around(df: DataFrame) -> DataFrame:
        return df.join(V.centroids(df, ["part"]), "part").select("part", "vec_id", "embedding", V.l2("embedding", "centroid").alias("r"))

    parts = stored(parts.join(sized(parts, "part").select("part"), "part", "left_semi"), "parts")
    far = stored(around(parts), "far")
    spread = far.groupBy("part").agg(F.avg("r").alias("m"), F.stddev_pop("r").alias("s"))
    near = far.join(spread, "part").where((F.col("s") < 1e-6) | (F.col("r") <= F.col("m") + sigma * F.col("s"))).select("part", "vec_id", "embedding")
    near = stored(near, "near")
    near = stored(near.join(sized(near, "part"), "part"), "near")
    factor = F.when(F.max("n") >= max(5, min_size + 1), 1.0).otherwise(1.5)
    wide = around(near).join(sized(near, "part"), "part").groupBy("part").agg((F.avg("r") > eps * density * factor).alias("wide"))
    near = stored(near.join(wide.withColumn("wide", F.col("wide") & F.lit(eps > 0)), "part"), "near")
    narrow = near.where("not wide").select("vec_id", F.col("part").alias("label"))
    loose = stored(near.where("wide").select("vec_id", "embedding", "part"), "loose")
    edges = eps_join(loose, eps * rescue, inclusive=True)
    end = lambda name, part: loose.select(F.col("vec_id").alias(name), F.col("part").alias(part))
    same = edges.join(end("src", "p"), "src").join(end("dst", "q"), "dst").where("p = q")
    cores = connected_components(same).select(F.col("node").alias("vec_id"), F.col("component").alias("label"))
    cores = loose.select("vec_id").join(cores, "vec_id", "left").select("vec_id", F.coalesce("label", "vec_id").alias("label"))
    cores = stored(cores, "cores")
    return narrow.unionByName(cores.join(sized(cores, "label").select("label"), "label", "left_semi").select("vec_id", "label"))
