"""Exact top-k search by inner product over a pivot-distance index.

Vectors of any length are lifted by one coordinate, sqrt(M^2 - |v|^2) with M the greatest
length, and queries by 0.  All lifted vectors are equally long, so the highest inner product
is the smallest distance, and the triangle inequality holds for scores.  Every row is keyed
by its nearest pivot and the distance to it; rows in key order are cut in annuli.  A query
visits annuli in order of their lower bound, each round several times as many, and stops when
the next annulus lies beyond its k-th score.  Visited annuli are scored exactly, in integers.

Queries meet annuli in blocks: a cell is one block of queries and one annulus, both of bounded
size, and sends on at most k rows a query.  Pivots are fitted on a bounded sample; every row
is indexed, and results do not depend on the pivots.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from quern.llm.common import stored
from quern.operators import pivots as P

_EXACT = float(1 << 53)
#: Scores in one step of a cell.
STEP_CELLS = 1 << 22


def _products(q: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Integer inner products: by doubles where these are exact, else by 64-bit integers."""
    most = np.abs(q).max(initial=0) * np.abs(b).max(initial=0) * max(q.shape[1], 1)
    return q @ b.T if most < _EXACT else q.astype(np.int64) @ b.astype(np.int64).T


def highest(qi: np.ndarray, q: np.ndarray, bi: np.ndarray, b: np.ndarray, worst: np.ndarray, k: int) -> P.Found:
    """(src, dst, -score) of the k highest scores of each query, of those down to -worst; ties to
    the smaller id, rows with the query's id left out."""
    out = [(np.zeros(0, np.int64),) * 3]
    step = max(1, STEP_CELLS // max(len(b), 1))
    for at in range(0, len(q) if len(b) else 0, step):
        ids, key = qi[at : at + step], -_products(q[at : at + step], b)
        other = ids[:, None] != bi[None, :]
        last = np.iinfo(np.int64).max if key.dtype == np.int64 else np.inf
        cut = np.partition(np.where(other, key, last), min(k, len(b)) - 1, axis=1)[:, min(k, len(b)) - 1]
        r, c = np.nonzero(other & (key <= np.minimum(cut, worst[at : at + step].astype(key.dtype))[:, None]))
        key = key[r, c].astype(np.int64)
        order = np.lexsort((bi[c], key, r))
        r, c, key = r[order], c[order], key[order]
        keep = np.arange(len(r)) - np.searchsorted(r, r) < k
        out.append((ids[r[keep]], bi[c[keep]], key[keep]))
    return tuple(np.concatenate(z) for z in zip(*out, strict=True))


def integers(df: DataFrame, scale: int = 1024, id_col: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(id, v): floor(scale * x) of the usable vectors, shorter ones filled up with 0."""
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    rows = df.select(F.col(id_col).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("v")).where("id is not null and v is not null").where(F.forall("v", finite))
    rows = stored(rows.select("id", F.transform("v", lambda x: F.floor(x * scale).cast("double")).alias("v")), "integers")
    longest = max(rows.agg(F.max(F.size("v"))).first()[0] or 0, 1)
    return rows.select("id", F.concat("v", F.array_repeat(F.lit(0.0), F.lit(longest) - F.size("v"))).alias("v"))


def top_k(
    df: DataFrame,
    is_query: Column,
    k: int = 10,
    scale: int = 1024,
    id_col: str = "vec_id",
    vector: str = "embedding",
    pivots: int = P.PIVOTS,
    width: int | None = None,
) -> tuple[DataFrame, dict[str, int]]:
    """The k rows with the highest score for each query, and how many cells there are and were
    visited.

    The score is the inner product of the vectors' floor(scale * x), exact while it fits a long.
    ``is_query`` picks queries by the columns id and v.  Returns (query_id, rank, vec_id, score),
    ties to the smaller vec_id, fewer rows where there are fewer candidates.  Rows with a null
    id, or a vector that is null or holds a null or a number that is not finite, take no part.
    Shorter vectors count as filled up with 0.  Of rows that repeat a query's id one asks, the
    one with the smallest vector, and none is its candidate; other repeated rows are listed each.
    Other columns are ignored.  A table without queries or candidates gives an empty result.
    """
    rows = integers(df, scale, id_col, vector)
    square = F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x)
    queries = rows.where(is_query).groupBy("id").agg(F.min("v").alias("v")).withColumn("own", square)
    longest = rows.agg(F.max(square)).first()[0] or 0.0

    def lift(x: np.ndarray) -> np.ndarray:
        return np.column_stack((x, np.sqrt(np.maximum(longest - (x * x).sum(axis=1), 0))))

    def flat(x: np.ndarray) -> np.ndarray:
        return np.column_stack((x, np.zeros(len(x))))

    found, report = P.search(
        queries,
        rows,
        k,
        lambda qi, q, bi, b, worst: highest(qi, q, bi, b, worst, k),
        key_type="long",
        radius=lambda key, own: F.sqrt(F.greatest(own + longest + 2 * key.cast("double"), F.lit(0.0))),
        lift=lift,
        query_lift=flat,
        count=pivots,
        width=width,
    )
    rank = F.row_number().over(W.partitionBy("src").orderBy("key", "dst"))
    return found.select(F.col("src").alias("query_id"), rank.alias("rank"), F.col("dst").alias("vec_id"), (-F.col("key")).alias("score")), report


SQL = """
WITH t AS (SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)) AS v FROM embeddings
           WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.v, c.v)::BIGINT AS score FROM t q JOIN t c ON c.vec_id <> q.vec_id WHERE q.vec_id % 100 = 0)
SELECT query_id, (row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id))::INT AS rank, vec_id, score
FROM s QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) <= 10
"""
