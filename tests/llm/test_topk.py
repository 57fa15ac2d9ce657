import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from quern.llm import topk_search as T

SCHEMA = "vec_id long, embedding array<double>"


def brute(rows, k, by=100):
    usable = [(i, [math.floor(1024 * x) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    asked = {}
    for i, v in usable:
        if i % by == 0:
            asked[i] = min(v, asked.get(i, v))
    out = []
    for i, q in asked.items():
        scored = sorted((-sum(a * b for a, b in zip(q, v)), j) for j, v in usable if j != i)  # noqa: B905
        out += [(i, rank, j, -s) for rank, (s, j) in enumerate(scored[:k], 1)]
    return sorted(out)


def run(spark, rows, k, by=100, **options):
    df = spark.createDataFrame(rows, SCHEMA).withColumns({c: F.lit("x") for c in ("id", "v", "block", "own", "key", "rank")})
    found, report = T.top_k(df, F.col("id") % by == 0, k, **options)
    return sorted(map(tuple, found.collect())), report


def vectors(n, d, seed, centres=0, spread=1.0):
    rng = np.random.default_rng(seed)
    x = rng.normal(0, spread, (n, d))
    if centres:
        x += rng.normal(0, 5, (centres, d))[rng.integers(0, centres, n)]
    return [(i, v) for i, v in enumerate(x.tolist())]


@pytest.mark.parametrize("width,centres", [(7, 9), (64, 0), (None, 9)])
def test_matches_every_pair(spark, width, centres):
    rows = vectors(500, 8, 1, centres, 0.2 if centres else 1.0)
    got, report = run(spark, rows, 10, by=20, width=width)
    assert got == brute(rows, 10, 20)
    assert report["visited"] <= report["pairs"]


def test_bounds_stop_the_search(spark):
    rows = vectors(900, 6, 2, centres=15, spread=0.05)
    got, report = run(spark, rows, 3, by=10, width=20)
    assert got == brute(rows, 3, 10) and report["visited"] < 0.5 * report["pairs"]


def test_ties_repeats_and_copies(spark):
    rows = [(i, [1.0, 2.0, 0.5]) for i in range(300)] + [(i, [0.5, 0.25, 1.0]) for i in range(300, 330)] + [(100, [1.0, 2.0, 0.5]), (305, [0.5, 0.25, 1.0]), (200, [0.0, 9.0, 1.0])]
    assert run(spark, rows, 5, width=16)[0] == brute(rows, 5)


def test_unusable_and_odd_vectors(spark):
    rows = [(0, [1.0, -1.0]), (1, None), (2, [None, 1.0]), (3, [float("nan"), 1.0]), (4, [float("inf"), 1.0]), (None, [1.0, 1.0]), (5, [0.0, 0.0]), (6, []), (7, [3.0]), (8, [1.0, -1.0, 7.0]), (100, [1e5, -1e5]), (9, [-1e6, 1e6]), (-100, [2.0, 2.0])]
    assert run(spark, rows, 20)[0] == brute(rows, 20)


@pytest.mark.parametrize("rows", [[], [(0, [1.0])], [(0, None)], [(1, [1.0]), (2, [2.0])], [(0, []), (1, [])]])
def test_tiny(spark, rows):
    assert run(spark, rows, 3)[0] == brute(rows, 3)


def test_numbers_beyond_doubles():
    q, b = np.array([[2.0**52, 3.0]]), np.array([[3.0, 1.0], [3.0, 2.0]])
    src, dst, key = T.highest(np.array([5]), q, np.array([1, 2]), b, np.array([np.iinfo(np.int64).max]), 1)
    assert (src.tolist(), dst.tolist(), key.tolist()) == ([5], [2], [-(3 * 2**52 + 6)])


def test_all_queries_of_the_table(spark, sf):
    df = spark.read.parquet(f"{sf}/embeddings.parquet")
    rows = [(r["vec_id"], [float(x) for x in r["embedding"]]) for r in df.collect()]
    found, report = T.top_k(df, F.col("id") % 100 == 0)
    assert sorted(map(tuple, found.collect())) == brute(rows, 10) and report["visited"] > 0
