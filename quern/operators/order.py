"""Orders that keep similar rows next to each other: (pos, vec_id), pos from 0.

Neighbour graphs and spanning forests are distributed; the path heuristics themselves are
sequential and run per k-means cell, per component or per block of positions, never over
all rows.  Cells are put in a row by the spanning tree of their centroids and chained block by
block; nothing of a cell meets on the driver.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.functions import vectors as V
from quern.operators import kernels
from quern.operators.cluster import MAX_ROWS, _refuse, _vectors, kmeans, ranked
from quern.operators.density import spanning_tree
from quern.operators.graph import connected_components
from quern.operators.neighbors import knn_join
from quern.operators.pivots import matrix
from quern.operators.tours import preorder
from quern.stages import stored

#: Cells that one task chains.
CHAIN_BLOCK = 1024
#: Ranks in a block when parts of an order are put in a row.
RANK_BLOCK = 65_536


def neighbor_graph(df: DataFrame, k: int, mutual: bool = True) -> DataFrame:
    """(u, v, w), u < v: k-NN edges with squared distances.  Mutual by default; zero
    distances (duplicates) carry no edge."""
    knn = stored(knn_join(df, k).select("src", "dst", "dist"), "knn")
    both = knn.select(F.least("src", "dst").alias("u"), F.greatest("src", "dst").alias("v"), (F.col("dist") * F.col("dist")).alias("w"))
    need = 2 if mutual else 1
    return both.groupBy("u", "v").agg(F.min("w").alias("w"), F.count(F.lit(1)).alias("n")).where((F.col("n") >= need) & (F.col("w") > 0)).select("u", "v", "w")


def minimum_spanning_forest(graph: DataFrame) -> DataFrame:
    """(u, v, w) of the minimum spanning forest by Boruvka; unique, as ties go by (w, u, v).

    Each round every component takes its lightest edge out, found with partial minima;
    components at least halve.
    """
    rest = stored(graph.select("u", "v", "w", F.col("u").alias("a"), F.col("v").alias("b")), "graph")
    chosen = None
    while not rest.isEmpty():
        both = rest.select(F.col("a").alias("c"), F.struct("w", "u", "v").alias("e")).union(rest.select("b", F.struct("w", "u", "v")))
        light = both.groupBy("c").agg(F.min("e").alias("e")).select("e.u", "e.v", "e.w").distinct()
        chosen = stored(light if chosen is None else chosen.unionByName(light).distinct(), "tree")
        comp = stored(connected_components(chosen, "u", "v"), "parts")
        rest = rest.join(comp.select(F.col("node").alias("u"), F.col("component").alias("x")), "u", "left").join(comp.select(F.col("node").alias("v"), F.col("component").alias("y")), "v", "left")
        rest = stored(rest.select("u", "v", "w", F.coalesce("x", "u").alias("a"), F.coalesce("y", "v").alias("b")).where("a <> b"), "graph")
    return graph.select("u", "v", "w").limit(0) if chosen is None else chosen


def component_sizes(edges: DataFrame, nodes: DataFrame, src: str = "u", dst: str = "v") -> DataFrame:
    """(component, size) by size, then smallest id; single rows included."""
    comp = connected_components(edges, src, dst)
    every = nodes.select("vec_id").join(comp, F.col("vec_id") == F.col("node"), "left").select(F.coalesce("component", "vec_id").alias("component"))
    return every.groupBy("component").agg(F.count(F.lit(1)).alias("size"))


def _concatenate(parts: DataFrame, order: DataFrame, block: int = RANK_BLOCK) -> DataFrame:
    """(pos, vec_id) from (part, place, vec_id) and the rank of each part with its size.

    Sizes are summed up inside blocks of ranks; only one row a block meets in one task."""
    from pyspark.sql import Window as W

    order = order.select("part", "size", "rank", F.floor(F.col("rank") / block).alias("block"))
    blocks = order.groupBy("block").agg(F.sum("size").alias("total")).select("block", (F.sum("total").over(W.orderBy("block")) - F.col("total")).alias("before"))
    inside = F.sum("size").over(W.partitionBy("block").orderBy("rank")) - F.col("size")
    shift = order.withColumn("inside", inside).join(blocks, "block").select("part", (F.col("inside") + F.col("before")).alias("shift"))
    return parts.join(shift, "part").select((F.col("shift") + F.col("place")).cast("long").alias("pos"), "vec_id")


def dfs_order(df: DataFrame, k: int = 10, in_task: int = MAX_ROWS) -> DataFrame:
    """Depth-first order of the spanning forest of the neighbour graph: the largest
    component first, the others by smallest id.

    Trees of up to ``in_task`` rows are walked each in one task, larger ones by an Euler tour,
    with the same order."""
    tree = stored(minimum_spanning_forest(neighbor_graph(df, k)), "forest")
    comp = connected_components(tree, "u", "v").select(F.col("node").alias("vec_id"), F.col("component").alias("part"))
    nodes = stored(df.select(F.col("vec_id").cast("long").alias("vec_id")).join(comp, "vec_id", "left").select("vec_id", F.coalesce("part", "vec_id").alias("part")), "nodes")
    sizes = stored(nodes.groupBy("part").agg(F.count(F.lit(1)).alias("size")), "sizes")
    placed = tree.join(nodes.withColumnRenamed("vec_id", "u"), "u").select("part", "u", "v", "w")
    large = stored(sizes.where(F.col("size") > max(in_task, 1)).select("part"), "large")

    def walk(pdf: pd.DataFrame) -> pd.DataFrame:
        ids = np.unique(np.concatenate((pdf["u"], pdf["v"])))
        u, v = np.searchsorted(ids, pdf["u"]), np.searchsorted(ids, pdf["v"])
        path = kernels.tree_order(len(ids), sorted(zip(pdf["w"].tolist(), u.tolist(), v.tolist(), strict=True)))
        return pd.DataFrame({"part": pdf["part"].iloc[0], "place": np.arange(len(ids)), "vec_id": ids[path]})

    walked = placed.join(large, "part", "left_anti").groupBy("part").applyInPandas(walk, "part long, place long, vec_id long")
    if not large.isEmpty():
        walked = walked.unionByName(preorder(stored(placed.join(large, "part", "left_semi"), "trees")))
    alone = nodes.join(sizes.where("size = 1").select("part"), "part", "left_semi").select("part", F.lit(0).cast("long").alias("place"), "vec_id")
    largest = sizes.orderBy(F.desc("size"), "part").limit(1).select(F.col("part").alias("main"))
    keyed = sizes.join(F.broadcast(largest), sizes["part"] == F.col("main"), "left").select("part", "size", F.when(F.col("main").isNotNull(), F.lit(-(1 << 62)).cast("long")).otherwise(F.col("part")).alias("key"))
    return _concatenate(walked.unionByName(alone), ranked(keyed, "key", "rank"))


def cell_order(cells: DataFrame, in_task: int = MAX_ROWS) -> DataFrame:
    """(part, rank) of cells (part, size, centroid): depth first over the spanning tree of the
    centroids, from the largest cell, nearer cells first.  Trees of up to ``in_task`` cells are
    walked in one task."""
    largest = cells.orderBy(F.desc("size"), "part").limit(1).select(F.lit(0).cast("long").alias("part"), F.col("part").alias("root"))
    tree = stored(spanning_tree(cells, "part", "centroid"), "tree")
    if tree.isEmpty():
        return largest.select(F.col("root").alias("part"), F.lit(0).cast("long").alias("rank"))
    if tree.count() < in_task:

        def run(edges: pa.Table) -> pa.Table:
            u, v, w = (edges.column(c).to_numpy() for c in ("u", "v", "w"))
            ids, start = np.unique(np.concatenate((u, v))), edges.column("root")[0].as_py()
            near = sorted(zip(w.tolist(), np.searchsorted(ids, u).tolist(), np.searchsorted(ids, v).tolist(), strict=True))
            path = kernels.tree_order(len(ids), near, 0.0, 0.0, int(np.searchsorted(ids, start)))
            return pa.table({"part": ids[path], "rank": np.arange(len(ids))})

        rooted = tree.withColumn("part", F.lit(0).cast("long")).join(F.broadcast(largest), "part")
        return rooted.groupBy("part").applyInArrow(run, "part long, rank long")
    walk = preorder(tree.withColumn("part", F.lit(0).cast("long")), 0.0, 0.0, stored(largest, "root"))
    return walk.select(F.col("vec_id").alias("part"), F.col("place").alias("rank"))


def _variants(paths: DataFrame, most: int) -> DataFrame:
    """(part, n, cut, turned, extra, head, tail): ways to run through each path (part, place,
    embedding): as it is or closed to a ring and cut where that costs least, both ways around."""

    def run(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("place")
        x, part = matrix(rows.column("embedding")), rows.column("part")[0].as_py()
        extra = np.concatenate(([0.0], np.linalg.norm(x[-1] - x[0]) - np.linalg.norm(np.diff(x, axis=0), axis=1)))
        cuts = [0, *(1 + np.argsort(extra[1:], kind="stable")[: max(most // 2 - 1, 0)]).tolist()]
        out = [(part, i * 2 + turned, cut, bool(turned), float(extra[cut]), x[cut - turned].tolist(), x[cut - 1 + turned].tolist()) for i, cut in enumerate(cuts) for turned in (0, 1)]
        return pa.Table.from_arrays([pa.array(c) for c in zip(*out, strict=True)], names=["part", "n", "cut", "turned", "extra", "head", "tail"])

    return paths.groupBy("part").applyInArrow(run, "part long, n long, cut long, turned boolean, extra double, head array<double>, tail array<double>")


def _costs(rows: pa.Table) -> tuple[np.ndarray, list[np.ndarray], list[np.ndarray]]:
    """For variants of cells sorted by rank: the ranks, the extra of each cell's variants, and
    the steps from those to the next cell's."""
    rank = rows.column("rank").to_numpy()
    ranks, starts = np.unique(rank, return_index=True)
    head, tail = (np.split(matrix(rows.column(c)), starts[1:]) for c in ("head", "tail"))
    extra = np.split(rows.column("extra").to_numpy(), starts[1:])
    return ranks, extra, [np.linalg.norm(t[:, None] - h[None], axis=2) for t, h in zip(tail, head[1:], strict=False)]


def chain(variants: DataFrame, block: int = CHAIN_BLOCK) -> DataFrame:
    """(part, n): the variants (part, rank, n, extra, head, tail) of all cells that together make
    the shortest chain in the order of ranks.

    The best way through a block of cells, from each variant of its first cell to each of the
    next block's first, is found in one task a block; one task links the blocks by these costs
    alone, and each block then takes the way it was given.
    """
    at = F.floor(F.col("rank") / block)
    first = (F.col("rank") % block == 0) & (F.col("rank") > 0)
    rows = variants.withColumn("block", F.explode(F.when(first, F.array(at, at - 1)).otherwise(F.array(at))))
    rows = stored(rows.select("block", "part", "rank", "n", "extra", "head", "tail"), "variants")

    def ways(key: tuple, rows: pa.Table) -> pa.Table:
        ranks, extra, steps = _costs(rows.sort_by([("rank", "ascending"), ("n", "ascending")]))
        best = np.where(np.eye(len(extra[0])) > 0, extra[0][:, None], np.inf)
        for own, step in zip(extra[1:], steps, strict=True):
            best = (best[:, :, None] + step[None]).min(axis=1) + own
        if ranks[-1] // block > key[0].as_py():
            best = best - extra[-1]  # that cell is the next block's
        x, y = np.indices(best.shape)
        return pa.table({"block": pa.array(np.full(best.size, key[0].as_py())), "x": x.ravel(), "y": y.ravel(), "cost": best.ravel()})

    costs = stored(rows.groupBy("block").applyInArrow(ways, "block long, x long, y long, cost double"), "ways")

    def link(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by([("block", "ascending"), ("x", "ascending"), ("y", "ascending")])
        of, width = rows.column("block").to_numpy(), rows.column("x").to_numpy()
        blocks, starts = np.unique(of, return_index=True)
        mats = [c.reshape(w.max() + 1, -1) for c, w in zip(np.split(rows.column("cost").to_numpy(), starts[1:]), np.split(width, starts[1:]), strict=True)]
        cost, back = np.zeros(mats[0].shape[0]), []
        for m in mats:
            whole = cost[:, None] + m
            back.append(whole.argmin(axis=0))
            cost = whole.min(axis=0)
        y, out = int(cost.argmin()), []
        for b, prev in zip(blocks[::-1].tolist(), back[::-1], strict=True):
            x = int(prev[y])
            out.append((b, x, y))
            y = x
        return pa.Table.from_arrays([pa.array(c) for c in zip(*out, strict=True)], names=["block", "enter", "leave"])

    linked = costs.withColumn("all", F.lit(0)).groupBy("all").applyInArrow(link, "block long, enter long, leave long")

    def take(key: tuple, rows: pa.Table, way: pa.Table) -> pa.Table:
        rows = rows.sort_by([("rank", "ascending"), ("n", "ascending")])
        ranks, extra, steps = _costs(rows)
        enter, leave = way.column("enter")[0].as_py(), way.column("leave")[0].as_py()
        cost, back = np.full(len(extra[0]), np.inf), []
        cost[enter] = 0.0
        for own, step in zip(extra, steps, strict=False):
            whole = (cost + own)[:, None] + step
            back.append(whole.argmin(axis=0))
            cost = whole.min(axis=0)
        chosen = [leave]
        for prev in reversed(back):
            chosen.append(int(prev[chosen[-1]]))
        chosen = dict(zip(ranks.tolist(), reversed(chosen), strict=True))
        own = {r: p for r, p in zip(rows.column("rank").to_pylist(), rows.column("part").to_pylist(), strict=True) if r // block == key[0].as_py()}
        return pa.table({"part": pa.array(list(own.values()), pa.int64()), "n": pa.array([chosen[r] for r in own], pa.int64())})

    return rows.groupBy("block").cogroup(linked.groupBy("block")).applyInArrow(take, "part long, n long")


def refine_joints(df: DataFrame, order: DataFrame, starts: DataFrame, reach: int = 12) -> DataFrame:
    """2-opt with fixed ends around the joints between cells, all at once.

    ``starts`` (start, size, before): first position and size of each cell but the first, and
    size of the cell before it.  A window takes up to ``reach`` positions, and no more than half
    the cell, on either side, so windows never overlap and the path never gets longer.
    """
    half = lambda c: F.least(F.lit(reach), F.floor(F.col(c) / 2)).cast("long")
    spread = starts.select("start", F.explode(F.sequence(F.col("start") - half("before"), F.col("start") + F.greatest(half("size"), F.lit(1)) - 1)).alias("pos"))
    placed = order.join(spread, "pos", "left")

    def improve(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("pos")
        best = kernels.two_opt(np.stack(rows["embedding"].to_list()), np.arange(len(rows)))
        return pd.DataFrame({"pos": rows["pos"].to_numpy(), "vec_id": rows["vec_id"].to_numpy()[best]})

    placed = stored(placed, "joints")
    better = placed.where("start is not null").join(_vectors(df), "vec_id").groupBy("start").applyInPandas(improve, "pos long, vec_id long")
    return better.unionByName(placed.where("start is null").select("pos", "vec_id"))


def insertion_order(df: DataFrame, cells: int | None = None, refine: bool = True, max_rows: int = MAX_ROWS, variants: int = 8, joint: int = 12, seed: int = 42) -> DataFrame:
    """Clustered farthest insertion: a path in each k-means cell, and a chain of cells.

    Cells follow each other depth first over the spanning tree of their centroids.  Each is run
    through in one of ``variants`` ways (turned around, or cut open elsewhere), chosen together
    for the shortest chain, and ``joint`` positions on either side of a joint are improved by
    2-opt.
    """
    rows = _vectors(df)
    cell = kmeans(df, cells, seed).select("vec_id", F.col("cluster_id").alias("part"))
    rows = stored(rows.join(cell, "vec_id"), "cells")
    _refuse(rows.groupBy("part").agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0], max_rows)

    def path(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("vec_id")
        x, ids = np.stack(pdf["embedding"].to_list()), pdf["vec_id"].to_numpy()
        p = kernels.insertion_path(x, int(min(max(0.06 * len(x), 48), 128)))
        if refine and 4 <= len(p) <= 1200:
            p = kernels.two_opt(x, p)
        return pd.DataFrame({"part": pdf["part"].iloc[0], "place": np.arange(len(p)), "vec_id": ids[p], "embedding": list(x[p])})

    paths = stored(rows.groupBy("part").applyInPandas(path, "part long, place long, vec_id long, embedding array<double>"), "paths")
    sizes = stored(V.centroids(rows, ["part"]).join(rows.groupBy("part").agg(F.count(F.lit(1)).alias("size")), "part"), "sizes")
    if sizes.isEmpty():
        return paths.select(F.col("place").alias("pos"), "vec_id")
    ranked_cells = stored(sizes.select("part", "size").join(cell_order(sizes.select("part", "size", "centroid")), "part"), "ranks")
    ways = stored(_variants(paths.select("part", "place", "embedding"), variants), "ways")
    picked = chain(ways.join(ranked_cells.select("part", "rank"), "part"))
    picked = stored(ranked_cells.join(picked.join(ways.select("part", "n", "cut", "turned"), ["part", "n"]), "part"), "picked")
    place = F.pmod(F.col("place") - F.col("cut"), F.col("size"))
    turned = paths.join(picked, "part").select("part", F.when(F.col("turned"), F.col("size") - 1 - place).otherwise(place).alias("place"), "vec_id", "rank")
    turned = stored(turned, "turned")
    order = stored(_concatenate(turned.select("part", "place", "vec_id"), ranked_cells), "order")
    if not joint:
        return order
    first = turned.where("place = 0").select("vec_id", "part", "rank").join(order, "vec_id").join(ranked_cells.select("part", "size"), "part")
    before = ranked_cells.select((F.col("rank") + 1).alias("rank"), F.col("size").alias("before"))
    return refine_joints(df, order, first.join(before, "rank").select(F.col("pos").alias("start"), "size", "before"), joint)


def block_two_opt(df: DataFrame, order: DataFrame, block: int = 100, shift: int = 90) -> DataFrame:
    """2-opt with fixed ends inside blocks of positions.

    Blocks start at multiples of ``shift`` and overlap; even blocks improve first, then odd
    ones, so blocks of a phase share no position and the path never gets longer.  The tail
    is covered too.
    """
    if block > 2 * shift:
        raise ValueError("blocks of one phase may not overlap: block <= 2 * shift")
    rows = _vectors(df)

    def improve(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("pos")
        best = kernels.two_opt(np.stack(pdf["embedding"].to_list()), np.arange(len(pdf)))
        return pd.DataFrame({"pos": pdf["pos"].to_numpy(), "vec_id": pdf["vec_id"].to_numpy()[best]})

    for phase in (0, 1):
        b = F.floor((F.col("pos") - phase * shift) / (2 * shift)).cast("long")
        inside = (F.col("pos") - phase * shift - b * 2 * shift) < block
        whole = order.withColumn("b", b).withColumn("inside", inside & (F.col("pos") >= phase * shift))
        better = whole.where("inside").join(rows, "vec_id").groupBy("b").applyInPandas(improve, "pos long, vec_id long")
        order = stored(better.unionByName(whole.where("not inside").select("pos", "vec_id")), "order")
    return order


def repaired(order: DataFrame, nodes: DataFrame) -> DataFrame:
    """An order made whole: the first place of each id, then the ids it lacks by id."""
    first = order.groupBy("vec_id").agg(F.min("pos").alias("at"))
    lacking = nodes.select("vec_id").join(first, "vec_id", "left_anti").select("vec_id", F.lit(None).cast("long").alias("at"))
    known = first.join(nodes.select("vec_id"), "vec_id", "left_semi")
    key = F.struct(F.col("at").isNull().alias("late"), F.col("at"), F.col("vec_id"))
    return ranked(known.unionByName(lacking).withColumn("key", key), "key", "rank").select((F.col("rank") - 1).alias("pos"), "vec_id")


def polish_longest(df: DataFrame, order: DataFrame, edges: int = 300, reach: int = 68) -> DataFrame:
    """One reversal in each window of ``reach`` positions around the longest steps.

    Overlapping windows are merged; at most ``edges`` windows are listed on the driver.  The
    path never gets longer.
    """
    from quern.operators.metrics import steps

    rows = order.join(_vectors(df), "vec_id")
    longest = [r["pos"] for r in steps(rows).orderBy(F.desc("dist"), "pos").limit(edges).collect()]
    windows: list[list[int]] = []
    for p in sorted(longest):
        low, high = max(0, p - reach), p + reach
        if windows and low <= windows[-1][1]:
            windows[-1][1] = max(windows[-1][1], high)
        else:
            windows.append([low, high])
    if not windows:
        return order
    listed = df.sparkSession.createDataFrame([(i, a, b) for i, (a, b) in enumerate(windows)], "w int, low long, high long")
    placed = rows.join(F.broadcast(listed), F.col("pos").between(F.col("low"), F.col("high")), "left")

    def improve(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("pos")
        best = kernels.best_reversal(np.stack(pdf["embedding"].to_list()), np.arange(len(pdf)))
        return pd.DataFrame({"pos": pdf["pos"].to_numpy(), "vec_id": pdf["vec_id"].to_numpy()[best]})

    inside = placed.where("w is not null").groupBy("w").applyInPandas(improve, "pos long, vec_id long")
    return inside.unionByName(placed.where("w is null").select("pos", "vec_id"))
