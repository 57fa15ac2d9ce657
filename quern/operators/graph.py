"""Graph operators over edge tables: components, mutual edges, spanning forests."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.stages import stored

#: Contracted edges that one task may solve; both ends of this many fit a few MB.
FINISH = 1 << 17


def reciprocal(edges: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """Keeps the edges whose reverse is present."""
    back = edges.select(F.col(dst).alias("_a"), F.col(src).alias("_b")).distinct()
    return edges.join(back, (F.col(src) == F.col("_a")) & (F.col(dst) == F.col("_b")), "left_semi")


def symmetrized(edges: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """Edges in both directions, once each."""
    return edges.select(src, dst).union(edges.select(dst, src)).distinct()


def _solved(edges: DataFrame) -> DataFrame:
    """(node, component) of a bounded edge table (a, b), in one task."""
    kind = edges.schema["a"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = list(batches)
        if not found:
            return
        table = pa.Table.from_batches(found)
        both = pa.chunked_array([*table.column("a").chunks, *table.column("b").chunks]).combine_chunks().dictionary_encode()
        order = pc.sort_indices(both.dictionary).to_numpy()
        rank = np.empty_like(order)
        rank[order] = np.arange(len(order))
        at = rank[both.indices.to_numpy()].astype(np.int64)
        a, b = at[: table.num_rows], at[table.num_rows :]
        to = np.arange(len(order))
        while (to[a] != to[b]).any():
            low = np.minimum(to[a], to[b])
            np.minimum.at(to, to[a], low)
            np.minimum.at(to, to[b], low)
            while (to[to] != to).any():
                to = to[to]
        names = both.dictionary.take(pa.array(order))
        yield pa.record_batch([names, names.take(pa.array(to))], names=["node", "component"])

    return edges.coalesce(1).mapInArrow(run, f"node {kind}, component {kind}")


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst", finish: int = FINISH) -> DataFrame:
    """(node, component) for every node of an edge; component is its smallest node.

    Each round hooks every node to its smallest neighbour, jumps pointers once, and
    contracts the edges, so a path of length n takes about log n rounds and the edge table
    shrinks all along.  Minima are combined before the shuffle, and every round is stored,
    so a lost executor costs one round at most.  Once the edges left are counted to be
    ``finish`` or fewer, one task solves them; the result is the same.  Edges with a null
    end are ignored; a loop makes a node of its own.
    """
    ends = edges.select(F.col(src).alias("a"), F.col(dst).alias("b")).where("a is not null and b is not null")
    left = stored(ends.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
    hooks = []
    while (n := left.count()) > finish:
        both = left.where("a <> b").union(left.where("a <> b").select("b", "a"))
        hook = both.groupBy("a").agg(F.min("b").alias("b")).select(F.col("a").alias("node"), F.least("a", "b").alias("to"))
        loops = left.where("a = b").select(F.col("a").alias("node"), F.col("a").alias("to"))
        hook = stored(hook.union(loops).groupBy("node").agg(F.min("to").alias("to")), "hook")
        far = hook.select(F.col("node").alias("to"), F.col("to").alias("far"))
        hook = stored(hook.join(far, "to", "left").select("node", F.coalesce("far", "to").alias("to")), "hook")
        hooks.append(hook)
        moved = left.join(hook.select(F.col("node").alias("a"), F.col("to").alias("x")), "a").join(hook.select(F.col("node").alias("b"), F.col("to").alias("y")), "b")
        moved = moved.where("x <> y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))
        left = stored(moved.distinct(), "edges")
    if n or not hooks:
        hooks.append(_solved(left).select("node", F.col("component").alias("to")))
    found = hooks[0]
    for hook in hooks[1:]:
        step = hook.select(F.col("node").alias("to"), F.col("to").alias("next"))
        found = found.join(step, "to", "left").select("node", F.coalesce("next", "to").alias("to"))
    return found.select("node", F.col("to").alias("component"))
