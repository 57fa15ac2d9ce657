"""A pivot index over vectors, and joins that it prunes.

A few rows, spread out, are pivots.  Every row is keyed by its nearest pivot and the distance
to it; rows in key order are cut in blocks, so a block is a ring around its pivot.  For each
block the directory holds the least and greatest distance of its rows to every pivot.  By the
triangle inequality two rows are no closer than their distances to any pivot differ, so a pair
of blocks, or a row and a block, whose intervals lie too far apart is left out before any
vector moves.  A search visits the nearest rings first, each round several times as many, and
stops where the bound of the next ring is beyond the k-th row found.

Results do not depend on the pivots.  Both sizes that leave Spark are bounded: pivots come
from a sample of ``SAMPLE`` rows, and blocks grow with the table so that the directory has at
most ``MAX_BLOCKS`` of them (and one more a pivot).
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from quern.operators.ranks import positions
from quern.stages import stored

PIVOTS, SAMPLE = 32, 4096
#: Bytes of vectors in a block, unless that makes more than MAX_BLOCKS.
BLOCK_BYTES = 16 << 20
MAX_BLOCKS = 1 << 16
#: Share of the widest distance by which bounds may be off, for rounding.
SLACK = 1e-6
#: Blocks a search visits in its first round, and by how much that grows.
FIRST, GROWTH = 2, 8

Lift = Callable[[np.ndarray], np.ndarray]
Found = tuple[np.ndarray, np.ndarray, np.ndarray]


def matrix(column: pa.Array) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    n = len(column)
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(n, -1) if n else np.zeros((0, 0))


def plain(x: np.ndarray) -> np.ndarray:
    return x


def choose(rows: DataFrame, n: int, lift: Lift = plain, count: int = PIVOTS, sample: int = SAMPLE) -> np.ndarray:
    """Up to ``count`` pivots from a sample of (id, v): always the row farthest from those taken."""
    share = F.pmod(F.xxhash64("id"), F.lit(1 << 30)) < int(min(1.0, sample / max(n, 1)) * (1 << 30))
    few = rows.where(share).select("id", "v").limit(2 * sample).toArrow().sort_by("id")
    x = lift(matrix(few.column("v")))
    if not len(x):
        return x
    picked, gap = [0], ((x - x[0]) ** 2).sum(axis=1)
    while len(picked) < count and gap.max() > 0:
        picked.append(int(gap.argmax()))
        gap = np.minimum(gap, ((x - x[picked[-1]]) ** 2).sum(axis=1))
    return x[picked]


def to_pivots(x: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    """(n, pivots) distances, taken around the pivots' mean."""
    centre = pivots.mean(axis=0)
    x, p = x - centre, pivots - centre
    return np.sqrt(np.maximum((x * x).sum(axis=1)[:, None] + (p * p).sum(axis=1) - 2 * (x @ p.T), 0))


@dataclass
class Directory:
    """For each block: its number, rows, and the interval of distances to every pivot."""

    block: np.ndarray
    rows: np.ndarray
    low: np.ndarray
    high: np.ndarray

    def bounds(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """How close rows with distances in low..high (one a pivot) can be to those of each block."""
        if not len(self.block):
            return np.zeros(0)
        return np.maximum(np.maximum(self.low - high, low - self.high).max(axis=1), 0)


def blocked(rows: DataFrame, pivots: np.ndarray, width: int, lift: Lift = plain) -> tuple[DataFrame, Directory]:
    """The rows (id, v, ..) with their ``block``, stored, and the directory of blocks.

    A block has ``width`` rows of one pivot, or fewer at the end of the pivot's rows; how many
    rows a pivot has does not matter, as places are dealt by range.
    """
    shared = rows.sparkSession.sparkContext.broadcast(pivots)

    def key(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                far = to_pivots(lift(matrix(batch.column("v"))), shared.value)
                near = far.argmin(axis=1)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(near.astype(np.int32)), pa.array(far[np.arange(len(near)), near])], names=[*batch.schema.names, "pivot", "reach"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)
    keyed = rows.mapInArrow(key, f"{fields}, pivot int, reach double")
    placed = positions(keyed, ["pivot"], ["reach", "id"], "place")
    block = F.col("pivot").cast("long") * (1 << 40) + F.floor(F.col("place") / width)
    out = stored(placed.select(*rows.columns, block.alias("block")), "blocks")

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                far, of = to_pivots(lift(matrix(batch.column("v"))), shared.value), batch.column("block").to_numpy()
                order = np.argsort(of, kind="stable")
                names, starts, counts = np.unique(of[order], return_index=True, return_counts=True)
                low, high = np.minimum.reduceat(far[order], starts), np.maximum.reduceat(far[order], starts)
                p = far.shape[1]
                each = lambda a: np.repeat(a, p)
                yield pa.RecordBatch.from_arrays([pa.array(z) for z in (each(names), np.tile(np.arange(p, dtype=np.int32), len(names)), each(counts), low.ravel(), high.ravel())], names=["block", "p", "n", "low", "high"])

    parts = out.select("v", "block").mapInArrow(spread, "block long, p int, n long, low double, high double")
    whole = parts.groupBy("block", "p").agg(F.sum("n").alias("n"), F.min("low").alias("low"), F.max("high").alias("high")).toArrow().sort_by([("block", "ascending"), ("p", "ascending")])
    p = max(len(pivots), 1)
    column = lambda name: whole.column(name).to_numpy()
    return out, Directory(column("block")[::p], column("n")[::p], column("low").reshape(-1, p), column("high").reshape(-1, p))


def width_for(n: int, size: int) -> int:
    """Rows of a block, for n rows of size bytes in all."""
    return max(1, int(BLOCK_BYTES / max(size / max(n, 1), 1)), -(-n // MAX_BLOCKS))


def _slack(*directories: Directory) -> float:
    return SLACK * max((float(d.high.max()) for d in directories if len(d.block)), default=0.0)


def near_blocks(directory: Directory, eps: float, spark) -> DataFrame:
    """(a, b), a <= b: the pairs of blocks that may hold rows within eps."""
    shared, slack = spark.sparkContext.broadcast(directory), _slack(directory)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        d = shared.value
        for batch in batches:
            for i in batch.column(0).to_numpy().tolist():
                j = i + np.flatnonzero(d.bounds(d.low[i], d.high[i])[i:] <= eps + slack)
                yield pa.record_batch([pa.array(np.full(len(j), d.block[i])), pa.array(d.block[j])], names=["a", "b"])

    return spark.range(len(directory.block)).mapInArrow(run, "a long, b long")


def _cells(left: DataFrame, right: DataFrame, pairs: DataFrame, run: Callable[[pa.Table, pa.Table], Iterator[Found]], schema: str) -> DataFrame:
    """What run(rows of block a, rows of block b) gives, step by step, for every pair of blocks; a
    task holds two blocks and one step."""
    one = left.withColumnRenamed("block", "a").join(pairs, "a").withColumn("side", F.lit(0))
    other = right.select(F.col("block").alias("b"), "id", "v").join(pairs, "b").withColumn("side", F.lit(1))
    names = [field.split()[0] for field in schema.split(", ")]

    def cell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        whole = pa.Table.from_batches(list(batches))
        one, other = (whole.filter(pc.equal(whole.column("side"), side)) for side in (0, 1))
        del whole
        if len(one) and len(other):
            for found in run(one, other):
                if len(found[0]):
                    yield pa.RecordBatch.from_arrays([pa.array(z) for z in found], names=names)

    return one.unionByName(other, allowMissingColumns=True).groupBy("a", "b").applyInArrow(cell, schema)


def eps_pairs(rows: DataFrame, n: int, size: int, eps: float, kernel: Callable[..., Iterator[Found]], schema: str = "src long, dst long, dist double") -> tuple[DataFrame, dict[str, int]]:
    """(src, dst, dist) of all rows (id, v) within eps, both ways, by the steps of kernel(ids, x,
    ids, x), or what it gives by another schema, one way; and how many pairs of blocks there are
    and were visited."""
    pivots = choose(rows, n)
    if not len(pivots):
        return rows.sparkSession.createDataFrame([], schema), {"pairs": 0, "visited": 0}
    table, directory = blocked(rows, pivots, width_for(n, size))
    pairs = stored(near_blocks(directory, eps, rows.sparkSession), "pairs")

    def run(one: pa.Table, other: pa.Table) -> Iterator[Found]:
        once = "dist" not in schema or one.column("a")[0].as_py() == one.column("b")[0].as_py()
        for src, dst, *dist in kernel(one.column("id").to_numpy(), matrix(one.column("v")), other.column("id").to_numpy(), matrix(other.column("v"))):
            yield src, dst, *dist
            if not once:
                yield dst, src, *dist

    blocks = len(directory.block)
    return _cells(table, table, pairs, run, schema), {"pairs": blocks * (blocks + 1) // 2, "visited": pairs.count()}


def _next_blocks(queries: Directory, base: Directory, need: DataFrame, low: int, high: int) -> DataFrame:
    """(a, b): of the base blocks in order of their bound from query block a, those from place
    ``low`` to ``high`` that its radius reaches."""
    shared, slack = need.sparkSession.sparkContext.broadcast((queries, base)), _slack(queries, base)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        q, b = shared.value
        middle = (b.low + b.high) / 2
        for batch in batches:
            for block, radius in zip(batch.column("block").to_numpy().tolist(), batch.column("radius").to_numpy().tolist(), strict=True):
                i = int(np.searchsorted(q.block, block))
                bound = b.bounds(q.low[i], q.high[i])
                apart = np.abs(middle - (q.low[i] + q.high[i]) / 2).max(axis=1)
                take = np.lexsort((b.block, apart, bound))[low:high]
                take = take[bound[take] <= radius + slack]
                yield pa.record_batch([pa.array(np.full(len(take), block)), pa.array(b.block[take])], names=["a", "b"])

    return need.mapInArrow(run, "a long, b long")


def search(
    queries: DataFrame,
    base: DataFrame,
    k: int,
    kernel: Callable[..., Found],
    key_type: str = "double",
    radius: Callable[[Column, Column], Column] = lambda key, own: key,
    lift: Lift = plain,
    query_lift: Lift = plain,
    count: int = PIVOTS,
    width: int | None = None,
    query_width: int | None = None,
) -> tuple[DataFrame, dict[str, int]]:
    """(src, dst, key) of the k smallest keys of ``base`` (id, v) for each of ``queries`` (id, v,
    own), ties by dst; and how many pairs of blocks there are and were visited.

    kernel(query ids, q, ids, x, worst) gives (src, dst, key), the k best for each query, of
    keys up to ``worst``.  ``radius(key, own)`` is the distance, between the lifted vectors,
    beyond which no key is as small.  Every round visits each query block's next base blocks in
    order of their bounds, with queries that a block cannot improve left out one by one, and
    merges what is found, so at most k rows a query and cell are shuffled.
    """
    spark, schema = base.sparkSession, f"src long, dst long, key {key_type}"
    n, size = base.agg(F.count(F.lit(1)), F.sum(F.size("v") * 8 + 8)).first()
    pivots = choose(base, n, lift, count)
    if not len(pivots) or k <= 0:
        return spark.createDataFrame([], schema), {"pairs": 0, "visited": 0}
    width = width or width_for(n, size)
    table, directory = blocked(base, pivots, width, lift)
    asked, asking = blocked(queries, pivots, max(query_width or width, -(-queries.count() // MAX_BLOCKS)), query_lift)
    shared, slack = spark.sparkContext.broadcast((pivots, directory)), _slack(directory, asking)

    def run(one: pa.Table, other: pa.Table) -> Iterator[Found]:
        p, d = shared.value
        q, reach = matrix(one.column("v")), one.column("radius").to_numpy()
        far, i = to_pivots(query_lift(q), p), int(np.searchsorted(d.block, one.column("b")[0].as_py()))
        bound = np.maximum(d.low[i] - far, far - d.high[i]).max(axis=1)
        go = bound <= reach + slack
        yield kernel(one.column("id").to_numpy()[go], q[go], other.column("id").to_numpy(), matrix(other.column("v")), one.column("worst").to_numpy()[go])

    best, seen, low, high = None, 0, 0, FIRST
    none, most = F.lit(float("inf")), F.lit(np.iinfo(np.int64).max if key_type == "long" else float("inf")).cast(key_type)
    while low < len(directory.block):
        if best is None:
            now = asked.withColumns({"radius": none, "worst": most})
        else:
            full = best.groupBy(F.col("src").alias("id")).agg(F.max("key").alias("worst"), F.count(F.lit(1)).alias("n")).where(F.col("n") >= k).drop("n")
            now = asked.join(full, "id", "left").withColumn("radius", F.when(F.col("worst").isNotNull(), radius(F.col("worst"), F.col("own"))).otherwise(none)).withColumn("worst", F.coalesce("worst", most))
        now = now.select("id", "v", "block", "radius", "worst")
        pairs = stored(_next_blocks(asking, directory, now.groupBy("block").agg(F.max("radius").alias("radius")), low, high), "pairs")
        visited = pairs.count()
        if not visited:
            break
        seen += visited
        found = _cells(now, table, pairs, run, schema)
        place = F.row_number().over(W.partitionBy("src").orderBy("key", "dst"))
        best = stored((found if best is None else best.unionByName(found)).withColumn("place", place).where(F.col("place") <= k).drop("place"), "best")
        low, high = high, high * GROWTH
    return spark.createDataFrame([], schema) if best is None else best, {"pairs": len(asking.block) * len(directory.block), "visited": seen}
