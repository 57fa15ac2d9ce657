"""Nearest neighbours: range joins, k-NN joins, single and fused queries.

Distances are Euclidean, in double precision.  Joins over all pairs run as Arrow kernels:
a base that is measured to fit ``BROADCAST_BYTES`` is broadcast as one matrix and every
task compares its own rows with it; a larger base is cut in the blocks of a pivot index, and
only pairs of blocks that the triangle inequality leaves possible are compared, each in one
task, so neither side ever has to fit one machine.  Candidates are found by a product in single
precision, with a slack for its rounding, and measured again by direct differences, a few thousand
pairs at a time, so a task's memory does not depend on how many pairs are close.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from quern.functions import vectors as V
from quern.operators import pivots as P
from quern.operators.pivots import matrix

#: Every Python worker of an executor holds a copy of a broadcast base.
BROADCAST_BYTES = 64 << 20
#: Numbers in the matrix product of one step, and rows of the base that one step compares.
STEP_CELLS, STEP_BASE = 1 << 20, 1 << 13
#: Pairs that are measured again at once, and the share of a step's pairs from which on they are
#: screened once more before that.
AGAIN, MANY = 1 << 12, 1 / 32


def _step(n: int) -> int:
    return max(16, STEP_CELLS // max(n, 1))


_EPS = np.finfo(np.float64).eps
_FAR = float(np.finfo(np.float32).max)


def _products(x: np.ndarray, b: np.ndarray, norms: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Squared distances by the fast product, and how far those of each row of x may be off."""
    own, d = (x * x).sum(axis=1), x.shape[1]
    d2 = norms[None, :] - 2 * (x @ b.T) + own[:, None]
    return d2, 8 * (d + 8) * _EPS * (own + norms.max()) + 1e-300


def _centred(q: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    """Both sides less the mean of b, and how far that moves a coordinate at most."""
    centre = b.mean(axis=0)
    return q - centre, b - centre, 4 * _EPS * float(max(np.abs(b).max(initial=0), np.abs(q).max(initial=0)))


@dataclass
class _Screen:
    """Both sides in single precision, such that one product gives squared distances over
    ``unit``: how far each may be off (``slack``), and how far centring moves a coordinate."""

    left: np.ndarray
    right: np.ndarray
    unit: float
    slack: float
    moved: float

    def far(self, at: slice) -> np.ndarray:
        return self.left[at] @ self.right


def _screen(q: np.ndarray, b: np.ndarray) -> _Screen:
    qc, bc, moved = _centred(q, b)
    own, norms, d = (qc * qc).sum(axis=1), (bc * bc).sum(axis=1), q.shape[1]
    lengths = np.concatenate((own, norms))
    unit = float(lengths[np.isfinite(lengths)].max(initial=0)) or 1.0
    one, root = np.ones((len(qc), 1)), np.sqrt(unit)
    left = np.hstack((qc * (-2 / root), one, own[:, None] / unit)).astype(np.float32)
    right = np.vstack((bc.T / root, norms / unit, np.ones(len(bc)))).astype(np.float32)
    return _Screen(left, right, unit, 8 * (d + 8) * 2.0**-24, moved)


def _again(x: np.ndarray, r: np.ndarray, b: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Distances of x[r] to b[c] by direct differences, for a bounded number of pairs at once."""
    out = np.empty(len(r))
    for at in range(0, len(r), AGAIN):
        here = slice(at, at + AGAIN)
        out[here] = np.sqrt(((x[r[here]] - b[c[here]]) ** 2).sum(axis=1))
    return out


def _nearest(qi: np.ndarray, q: np.ndarray, bi: np.ndarray, b: np.ndarray, k: int, worst: np.ndarray | None = None) -> P.Found:
    """Rows (src, dst, dist) of the k nearest of b to each of q; ties by dst, self left out.

    The base is taken in stretches, each merged with the k best so far; what is farther than the
    k-th of these, or than ``worst``, is not looked for."""
    worst = np.full(len(q), np.inf) if worst is None else worst
    found = _nearest_in(qi, q, bi[:STEP_BASE], b[:STEP_BASE], k, worst)
    best = found[0][:0], found[1][:0], found[2][:0]
    for at in range(STEP_BASE, len(b), STEP_BASE):
        src, dst, dist = (np.concatenate(z) for z in zip(best, found, strict=True))
        order = np.lexsort((dst, dist, src))
        src = src[order]
        place = np.arange(len(src)) - np.searchsorted(src, src)
        keep = place < k
        best = src[keep], dst[order[keep]], dist[order[keep]]
        full, last = src[place == k - 1], dist[order[place == k - 1]]
        if len(full):
            i = np.minimum(np.searchsorted(full, qi), len(full) - 1)
            worst = np.where(full[i] == qi, np.minimum(worst, last[i]), worst)
        found = _nearest_in(qi, q, bi[at : at + STEP_BASE], b[at : at + STEP_BASE], k, worst)
    if len(b) <= STEP_BASE:
        return found
    src, dst, dist = (np.concatenate(z) for z in zip(best, found, strict=True))
    order = np.lexsort((dst, dist, src))
    order = order[np.arange(len(src)) - np.searchsorted(src[order], src[order]) < k]
    return src[order], dst[order], dist[order]


def _nearest_in(qi: np.ndarray, q: np.ndarray, bi: np.ndarray, b: np.ndarray, k: int, worst: np.ndarray) -> P.Found:
    if not len(q) or not len(b) or k <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
    out = []
    screen, exact = _screen(q, b), None
    by_id = np.argsort(bi, kind="stable")
    first, past = np.searchsorted(bi[by_id], qi), np.searchsorted(bi[by_id], qi, "right")
    step, take = _step(len(b)), min(k, len(b))
    loose = 8 * screen.moved * np.sqrt(q.shape[1])
    for at in range(0, len(q), step):
        here = slice(at, at + step)
        x, xi, reach = q[here], qi[here], worst[here]
        d2 = screen.far(here)
        for i in np.flatnonzero(past[here] > first[here]).tolist():
            d2[i, by_id[first[at + i] : past[at + i]]] = np.inf
        most = np.where(np.isfinite(reach), reach, 0)
        limit = np.where(np.isfinite(reach), np.minimum((most * most + loose * (most + screen.moved)) / screen.unit + screen.slack, _FAR), _FAR)
        close = d2 <= limit.astype(np.float32)[:, None]
        if np.count_nonzero(close) > MANY * d2.size:
            bound = np.partition(d2, take - 1, axis=1)[:, take - 1].astype(np.float64)
            near = np.sqrt(np.maximum(np.where(np.isfinite(bound), bound, 0), 0) * screen.unit) + screen.moved
            close &= d2 <= np.minimum(bound + 2 * screen.slack + loose * near / screen.unit, _FAR).astype(np.float32)[:, None]
        if np.count_nonzero(close) > MANY * d2.size:  # near copies, too close for single precision
            if exact is None:
                exact = _centred(q, b)
                norms = (exact[1] ** 2).sum(axis=1)
            fine, slack = _products(exact[0][here], exact[1], norms)
            fine[~close] = np.inf
            bound = np.partition(fine, take - 1, axis=1)[:, take - 1]
            near = np.sqrt(np.maximum(np.where(np.isfinite(bound), bound, 0), 0)) + screen.moved
            close = (fine <= (bound + 2 * slack + loose * near)[:, None]) & np.isfinite(fine)
        r, c = np.divmod(np.flatnonzero(close), len(b))
        dist = _again(x, r, b, c)
        order = np.lexsort((bi[c], dist, r))
        r, c, dist = r[order], c[order], dist[order]
        keep = (np.arange(len(r)) - np.searchsorted(r, r) < k) & (dist <= reach[r])
        out.append((xi[r[keep]], bi[c[keep]], dist[keep]))
    return tuple(np.concatenate(z) for z in zip(*out, strict=True))


def _within(qi: np.ndarray, q: np.ndarray, bi: np.ndarray, b: np.ndarray, eps: float, inclusive: bool) -> Iterator[P.Found]:
    """(src, dst, dist) of the pairs within eps, step by step."""
    for at in range(0, len(b), STEP_BASE):
        yield from _within_in(qi, q, bi[at : at + STEP_BASE], b[at : at + STEP_BASE], eps, inclusive)


def _close_in(q: np.ndarray, b: np.ndarray, eps: float) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(at, r, c), step by step: candidates q[at + r], b[c] for being within eps, by the screen."""
    if not len(q) or not len(b):
        return
    screen, step = _screen(q, b), _step(len(b))
    loose = 8 * screen.moved * np.sqrt(q.shape[1]) * (eps + screen.moved) + 4 * _EPS * eps * eps
    limit = np.float32(min((eps * eps + loose) / screen.unit + screen.slack, _FAR))
    for at in range(0, len(q), step):
        yield at, *np.divmod(np.flatnonzero(screen.far(slice(at, at + step)) <= limit), len(b))


def _within_in(qi: np.ndarray, q: np.ndarray, bi: np.ndarray, b: np.ndarray, eps: float, inclusive: bool) -> Iterator[P.Found]:
    for at, r, c in _close_in(q, b, eps):
        r = r + at
        dist = _again(q, r, b, c)
        keep = (dist <= eps if inclusive else dist < eps) & (qi[r] != bi[c])
        yield qi[r[keep]], bi[c[keep]], dist[keep]


def _links(qi: np.ndarray, q: np.ndarray, bi: np.ndarray, b: np.ndarray, eps: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(src, dst): a forest with the components of the pairs closer than eps.  Pairs that are
    linked already are not measured."""
    names, place = np.unique(np.concatenate((qi, bi)), return_inverse=True)
    mine, other, to = place[: len(qi)], place[len(qi) :], np.arange(len(names))
    for low in range(0, len(b), STEP_BASE):
        y, there = b[low : low + STEP_BASE], other[low : low + STEP_BASE]
        for at, r, c in _close_in(q, y, eps):
            r = r + at
            new = to[mine[r]] != to[there[c]]
            r, c = r[new], c[new]
            near = _again(q, r, y, c) < eps
            one, two = mine[r[near]], there[c[near]]
            while (to[one] != to[two]).any():
                least = np.minimum(to[one], to[two])
                np.minimum.at(to, to[one], least)
                np.minimum.at(to, to[two], least)
                while (to[to] != to).any():
                    to = to[to]
    moved = np.flatnonzero(to != np.arange(len(names)))
    yield names[moved], names[to[moved]]


PAIRS = "src long, dst long, dist double"


def _broadcast(queries: DataFrame, base: DataFrame, kernel: Callable[..., P.Found | Iterator[P.Found]], schema: str = PAIRS) -> DataFrame:
    """Runs kernel(qi, q, bi, b) over all of queries x a small base; (src, dst, dist), or as the
    schema says.

    A kernel may give what it finds in steps, which are passed on one by one."""
    whole = base.toArrow()
    shared = queries.sparkSession.sparkContext.broadcast((whole.column("id").to_numpy(), matrix(whole.column("v"))))
    names = [field.split()[0] for field in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bi, b = shared.value
        for batch in batches:
            if batch.num_rows:
                found = kernel(batch.column(0).to_numpy(), matrix(batch.column(1)), bi, b)
                for columns in [found] if isinstance(found, tuple) else found:
                    if len(columns[0]):
                        yield pa.record_batch([pa.array(z) for z in columns], names=names)

    parts = max(int(queries.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1)
    return queries.repartition(parts, "id").mapInArrow(run, schema)


def _measure(base: DataFrame) -> tuple[int, int]:
    """Rows, and bytes of ids and vectors."""
    n, size = base.agg(F.count(F.lit(1)), F.sum(F.size("v") * 8 + 8)).first()
    return n, size or 0


def _rows(df: DataFrame, id_col: str, vector: str) -> DataFrame:
    """Rows (id, v); vectors of floats stay so until a task compares them, at half the bytes."""
    v = F.col(vector) if df.schema[vector].dataType.simpleString() == "array<float>" else F.col(vector).cast("array<double>")
    return df.select(F.col(id_col).cast("long").alias("id"), v.alias("v")).where("id is not null and v is not null")


def knn_join(df: DataFrame, k: int, queries: DataFrame | None = None, id_col: str = "vec_id", vector: str = "embedding", broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """(src, dst, rank, dist): the k nearest of ``df`` to each query, never the query itself.

    ``queries`` defaults to ``df``.  Ties go to the smaller dst; fewer than k come back
    where there are no more rows.
    """
    base = _rows(df, id_col, vector)
    asked = base if queries is None else _rows(queries, id_col, vector)
    if _measure(base)[1] <= broadcast_bytes:
        found = _broadcast(asked, base, lambda qi, q, bi, b: _nearest(qi, q, bi, b, k))
    else:
        found = knn_pruned(asked, base, k)[0]
    rank = F.row_number().over(W.partitionBy("src").orderBy("dist", "dst"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("src", "dst", "rank", "dist")


def knn_pruned(queries: DataFrame, base: DataFrame, k: int) -> tuple[DataFrame, dict[str, int]]:
    """(src, dst, dist) by the pivot index, from rows (id, v); and its pairs of blocks and how
    many of them were visited."""

    def kernel(qi: np.ndarray, q: np.ndarray, bi: np.ndarray, b: np.ndarray, worst: np.ndarray) -> P.Found:
        return _nearest(qi, q, bi, b, k, worst)

    found, report = P.search(queries.withColumn("own", F.lit(0.0)), base, k, kernel)
    return found.withColumnRenamed("key", "dist"), report


def eps_join(df: DataFrame, eps: float, inclusive: bool = False, id_col: str = "vec_id", vector: str = "embedding", broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """(src, dst, dist) of all ordered pairs closer than ``eps`` (or at it, if inclusive)."""
    base = _rows(df, id_col, vector)
    if eps <= 0:
        return base.sparkSession.createDataFrame([], "src long, dst long, dist double")
    if _measure(base)[1] <= broadcast_bytes:
        return _broadcast(base, base, lambda qi, q, bi, b: _within(qi, q, bi, b, eps, inclusive))
    return eps_pruned(base, eps, inclusive)[0]


def eps_links(df: DataFrame, eps: float, id_col: str = "vec_id", vector: str = "embedding", broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """(src, dst): edges with the components of all pairs closer than ``eps``.

    A task gives a forest of the pairs it compares, so no more edges than it has rows."""
    base = _rows(df, id_col, vector)
    if eps <= 0:
        return base.sparkSession.createDataFrame([], "src long, dst long")
    n, size = _measure(base)
    kernel = lambda qi, q, bi, b: _links(qi, q, bi, b, eps)
    if size <= broadcast_bytes:
        return _broadcast(base, base, kernel, "src long, dst long")
    return P.eps_pairs(base, n, size, eps, kernel, "src long, dst long")[0]


def eps_pruned(base: DataFrame, eps: float, inclusive: bool = False) -> tuple[DataFrame, dict[str, int]]:
    """(src, dst, dist) by the pivot index, from rows (id, v); and its pairs of blocks and how
    many of them were visited."""
    return P.eps_pairs(base, *_measure(base), eps, lambda qi, q, bi, b: _within(qi, q, bi, b, eps, inclusive))


def knn_query(df: DataFrame, query: Column, k: int, exclude: Column | None = None, id_col: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """The k rows nearest to one vector: top-k per task, then one merge; no shuffle."""
    rows = df if exclude is None else df.where(~F.coalesce(exclude, F.lit(False)))
    return rows.select(F.col(id_col), V.l2(vector, query).alias("dist")).orderBy("dist", id_col).limit(k)


def vector_of(df: DataFrame, key: object, id_col: str = "vec_id", vector: str = "embedding") -> Column:
    """The vector of one row as a literal (null if there is no such row)."""
    row = df.where(F.col(id_col) == F.lit(key)).select(F.col(vector).cast("array<double>")).first()
    return F.lit(None).cast("array<double>") if row is None else F.array(*[F.lit(float(x)) for x in row[0]])


def degrees(edges: DataFrame, nodes: DataFrame, id_col: str = "vec_id") -> DataFrame:
    """(id, degree) for every node, 0 included."""
    n = edges.groupBy(F.col("src").alias(id_col)).agg(F.count(F.lit(1)).alias("degree"))
    return nodes.select(id_col).join(n, id_col, "left").select(id_col, F.coalesce("degree", F.lit(0).cast("long")).alias("degree"))


def shared_neighbors(knn: DataFrame) -> DataFrame:
    """(src, dst, shared) for k-NN edges from the smaller id: neighbours in common.

    As in the k-NN lists of either end; an edge counts only if it is in the list of its
    smaller end.
    """
    near = knn.select("src", "dst").groupBy("src").agg(F.collect_set("dst").alias("near"))
    edge = knn.where("src < dst").select("src", "dst")
    both = edge.join(near, "src").join(near.select(F.col("src").alias("dst"), F.col("near").alias("far")), "dst")
    return both.select("src", "dst", F.size(F.array_intersect("near", "far")).cast("long").alias("shared"))


def neighbor_list(knn: DataFrame, order: DataFrame | None = None, places: int = 6) -> DataFrame:
    """(src, neighbors): "position:distance" joined by commas, nearest first.

    ``order`` (vec_id, pos) turns ids into positions; without it ids are given.
    """
    if order is not None:
        knn = knn.join(order.select(F.col("vec_id").alias("dst"), F.col("pos").alias("_p")), "dst")
        knn = knn.join(order.select(F.col("vec_id").alias("src"), F.col("pos").alias("_s")), "src").select(F.col("_s").alias("src"), F.col("_p").alias("dst"), "rank", "dist")
    item = F.concat(F.col("dst").cast("string"), F.lit(":"), F.format_string(f"%.{places}f", F.col("dist")))
    return knn.groupBy("src").agg(F.concat_ws(",", F.transform(F.array_sort(F.collect_list(F.struct("rank", item.alias("item")))), lambda s: s["item"])).alias("neighbors"))


def format_result(query: str, position: Column, hits: DataFrame, mode: str = "both") -> DataFrame:
    """Result lines of one query: "Indexed: ..." with positions, "Paths: ..." with paths, or both.

    ``hits``: rank, pos, path, dist.
    """
    ordered = lambda item: F.transform(F.array_sort(F.collect_list(F.struct("rank", item.alias("item")))), lambda s: s["item"])
    indexed = F.concat(F.lit(f"Indexed: {query}\t"), position.cast("string"), F.lit("\t"), F.concat_ws(",", ordered(F.concat(F.col("pos").cast("string"), F.lit(":"), F.format_string("%.6f", "dist")))))
    paths = F.concat(F.lit(f"Paths: {query}"), F.concat_ws("", ordered(F.concat(F.lit("\t"), F.col("path"), F.lit("\t"), F.format_string("%.6f", "dist")))))
    wanted = {"indexed": [indexed], "paths": [paths], "both": [indexed, paths]}[mode]
    return hits.agg(F.array(*wanted).alias("lines")).select(F.explode("lines").alias("line"))
