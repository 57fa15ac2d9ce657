import numpy as np
import pytest

from quern.operators import graph as G
from quern.operators import neighbors as N
from quern.operators import pivots as P
from tests.fixtures import frame, planted


def brute(x, k):
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1))
    out = set()
    for i in range(len(x)):
        order = sorted((d[i, j], j) for j in range(len(x)) if j != i)[:k]
        out |= {(i, j, r + 1) for r, (_, j) in enumerate(order)}
    return out


@pytest.mark.parametrize("limit", [1 << 30, 0])
def test_knn_with_and_without_broadcast(spark, limit):
    x = np.random.default_rng(1).normal(size=(60, 4)).astype(np.float32)
    got = {(r["src"], r["dst"], r["rank"]) for r in N.knn_join(frame(spark, x), 5, broadcast_bytes=limit).collect()}
    assert got == brute(x.astype(float), 5)


def test_duplicates_and_k_beyond_n(spark):
    x = np.array([[1.0, 0.0]] * 3)
    got = {(r["src"], r["dst"], r["rank"], r["dist"]) for r in N.knn_join(frame(spark, x), 9).collect()}
    assert got == {(0, 1, 1, 0.0), (0, 2, 2, 0.0), (1, 0, 1, 0.0), (1, 2, 2, 0.0), (2, 0, 1, 0.0), (2, 1, 2, 0.0)}


@pytest.mark.parametrize("n", [0, 1])
def test_tiny(spark, n):
    df = frame(spark, np.eye(2)[:n])
    assert N.knn_join(df, 3).count() == 0 and N.eps_join(df, 1.0).count() == 0
    assert N.eps_join(df, 0.0).count() == 0


@pytest.mark.parametrize("limit", [1 << 30, 0])
def test_eps_is_strict_unless_inclusive(spark, limit):
    x = np.array([[0.0], [1.0], [2.5]])
    assert N.eps_join(frame(spark, x), 1.0, broadcast_bytes=limit).count() == 0
    assert N.eps_join(frame(spark, x), 1.0, inclusive=True, broadcast_bytes=limit).count() == 2


@pytest.mark.parametrize("limit", [1 << 30, 0])
@pytest.mark.parametrize("d,offset,spread", [(8, 1e4, 1e-3), (200, 0.0, 1.0)])
def test_far_from_the_origin_and_wide(spark, limit, d, offset, spread, monkeypatch):
    monkeypatch.setattr(P, "BLOCK_BYTES", 20 * d * 8)
    x = offset + np.random.default_rng(2).normal(0, spread, (50, d))
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    far = np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1))
    got = {(r["src"], r["dst"], r["rank"]) for r in N.knn_join(rows, 3, broadcast_bytes=limit).collect()}
    assert got == brute(x, 3)
    eps = float(np.quantile(far[far > 0], 0.1))
    assert {(r["src"], r["dst"]) for r in N.eps_join(rows, eps, broadcast_bytes=limit).collect()} == {(i, j) for i, j in zip(*np.nonzero(far < eps), strict=True) if i != j}


def test_components_by_rounds_and_at_once(spark):
    rng = np.random.default_rng(4)
    edges = spark.createDataFrame([(int(a), int(b)) for a, b in rng.integers(0, 200, (150, 2))] + [(i, i + 1) for i in range(300, 330)], "src long, dst long")
    once = sorted(map(tuple, G.connected_components(edges).collect()))
    assert once == sorted(map(tuple, G.connected_components(edges, finish=0).collect()))
    names = edges.selectExpr("cast(src as string) src", "cast(dst as string) dst")
    sizes = lambda rows: sorted(sum(1 for r in rows if r[1] == c) for c in {r[1] for r in rows})
    assert sizes(G.connected_components(names).collect()) == sizes(once)


def test_components(spark):
    rng = np.random.default_rng(3)
    chain = [(i, i + 1) for i in range(100, 140)]
    edges = [*chain, *[(int(a), int(b)) for a, b in rng.integers(0, 90, (60, 2)) if a != b], (500, 500), (None, 3)]
    got = {r["node"]: r["component"] for r in G.connected_components(spark.createDataFrame(edges, "src long, dst long")).collect()}
    parent = {}

    def find(a):
        parent.setdefault(a, a)
        while parent[a] != a:
            a = parent[a]
        return a

    for a, b in edges:
        if a is not None:
            x, y = find(a), find(b)
            parent[max(x, y)] = min(x, y)
    assert got == {a: find(a) for a in parent}
    assert G.connected_components(spark.createDataFrame([], "src long, dst long")).count() == 0


def test_partitions_do_not_matter(spark):
    x, _ = planted()
    df = frame(spark, x)
    a = sorted(map(tuple, N.knn_join(df.repartition(7), 4).collect()))
    assert a == sorted(map(tuple, N.knn_join(df.coalesce(1), 4).collect()))


def clustered(n=600, d=6, centres=12, seed=3):
    rng = np.random.default_rng(seed)
    at = rng.normal(0, 10, (centres, d))
    return (at[rng.integers(0, centres, n)] + rng.normal(0, 0.3, (n, d))).astype(np.float32)


@pytest.mark.parametrize("block", [20, 5000])
def test_pivots_skip_blocks_and_lose_nothing(spark, monkeypatch, block):
    monkeypatch.setattr(P, "BLOCK_BYTES", block * 56)
    x = clustered()
    df = frame(spark, x)
    base = N._rows(df, "vec_id", "embedding")
    found, report = N.knn_pruned(base, base, 4)
    rank = {(r["src"], r["dst"]) for r in found.collect()}
    assert rank == {(i, j) for i, j, _ in brute(x.astype(float), 4)}
    d = np.sqrt(((x[:, None].astype(float) - x[None]) ** 2).sum(-1))
    near, pairs = N.eps_pruned(base, 0.6)
    assert {(r["src"], r["dst"]) for r in near.collect()} == {(i, j) for i, j in zip(*np.nonzero(d < 0.6), strict=True) if i != j}
    assert pairs["visited"] < 0.5 * pairs["pairs"] and report["visited"] < 0.6 * report["pairs"]


def test_pivot_search_for_other_queries_repeats_and_hot_pivot(spark, monkeypatch):
    monkeypatch.setattr(P, "BLOCK_BYTES", 16 * 56)
    x = np.vstack((np.zeros((150, 6)), clustered(200)))
    queries = clustered(40, seed=9) + 0.01
    got = {(r["src"], r["dst"], r["rank"]) for r in N.knn_join(frame(spark, x), 3, frame(spark, queries, ids=range(1000, 1040)), broadcast_bytes=0).collect()}
    d = np.sqrt(((queries.astype(np.float32).astype(float)[:, None] - x[None].astype(np.float32).astype(float)) ** 2).sum(-1))
    assert got == {(1000 + i, j, r + 1) for i in range(40) for r, j in enumerate(np.lexsort((np.arange(len(x)), d[i]))[:3].tolist())}
    same = N.knn_join(frame(spark, x), 2, broadcast_bytes=0).where("src < 150")
    assert {(r["src"], r["dst"]) for r in same.collect()} == {(i, j) for i in range(150) for j in [j for j in range(3) if j != i][:2]}


def test_fewer_rows_than_asked(spark):
    x = clustered(7)
    assert N.knn_join(frame(spark, x), 20, broadcast_bytes=0).count() == 42
    assert N.knn_join(frame(spark, x[:0]), 20, broadcast_bytes=0).count() == 0


def test_kernels_by_stretches_hold_no_more_than_a_step(monkeypatch):
    import tracemalloc

    rng = np.random.default_rng(8)
    x, ids = rng.normal(size=(30_000, 4)), rng.permutation(30_000).astype(np.int64)
    whole = np.linalg.norm(x[:50, None] - x[None], axis=2)
    tracemalloc.start()
    src, dst, dist = N._nearest(ids[:2000], x[:2000], ids, x, 3)
    found = [(s, t) for s, t, _ in N._within(ids[:50], x[:50], ids, x, 0.5, False)]
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 100 << 20  # a step held 8 M numbers, several times over
    for i in range(50):
        order = [j for j in np.lexsort((ids, whole[i])) if j != i][:3]
        assert dst[src == ids[i]].tolist() == ids[order].tolist()
    want = {(ids[i], ids[j]) for i, j in zip(*np.nonzero(whole < 0.5), strict=True) if i != j}
    assert {p for s, t in found for p in zip(s.tolist(), t.tolist(), strict=True)} == want and len(found) > 1


def test_a_cell_passes_its_pairs_on_step_by_step(spark, monkeypatch):
    monkeypatch.setattr(P, "BLOCK_BYTES", 20 * 3 * 8)

    def steps(qi, q, bi, b):
        for at in range(0, len(q), 7):
            src, dst = (z.ravel() for z in np.meshgrid(qi[at : at + 7], bi, indexing="ij"))
            yield src, dst, np.zeros(len(src))

    x = np.random.default_rng(7).normal(size=(60, 3))
    found = P.eps_pairs(N._rows(frame(spark, x), "vec_id", "embedding"), 60, 60 * 32, 100.0, steps)[0]
    assert sorted((r["src"], r["dst"]) for r in found.collect()) == [(i, j) for i in range(60) for j in range(60)]


def _peak(run) -> int:
    import tracemalloc

    tracemalloc.start()
    run()
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    return peak


@pytest.mark.parametrize("spread", [0, 1e-9])
def test_copies_take_no_more_memory_than_other_rows(spread):
    n, d = 8192, 64
    x, ids = 0.1 + np.random.default_rng(5).normal(0, 1, (n, d)) * spread, np.arange(n)
    assert _peak(lambda: [len(s) for s, _, _ in N._within(ids[:256], x[:256], ids, x, 1.15, False)]) < 200 << 20  # 1 GB: all differences of a step's pairs
    assert _peak(lambda: N._nearest(ids[:256], x[:256], ids, x, 10)) < 200 << 20
    src, dst, _ = N._nearest(ids[:5], x[:5], ids, x, 10)
    near = np.sqrt(((x[:5, None] - x[None]) ** 2).sum(axis=2))
    near[np.arange(5), np.arange(5)] = np.inf
    assert dst.reshape(5, 10).tolist() == [np.lexsort((ids, row))[:10].tolist() for row in near]


def _hard_rows() -> dict[str, np.ndarray]:
    rng = np.random.default_rng(11)
    x = rng.normal(size=(900, 5))
    mixed = x.copy()
    mixed[:400], mixed[400:600], mixed[600] = x[0], x[0] + rng.normal(size=(200, 5)) * 1e-7, 1e6
    return {"plain": x, "copies, near copies and one far off": mixed, "all alike": x * 0, "far from zero": 1e8 + x * 1e-3, "tiny": x * 1e-170, "huge": x * 1e150, "ties": np.round(x * 2), "ever nearer": np.sort(x, axis=0)[::-1].copy()}


@pytest.mark.parametrize("name", list(_hard_rows()))
def test_screening_in_single_precision_loses_nothing(monkeypatch, name):
    monkeypatch.setattr(N, "STEP_BASE", 256)
    x, ids = _hard_rows()[name], np.random.default_rng(2).permutation(900)
    dist = np.sqrt(((x[:, None] - x[None]) ** 2).sum(axis=2))
    own = dist + np.diag(np.full(900, np.inf))
    want = [(ids[i], ids[j], own[i, j]) for i in range(900) for j in np.lexsort((ids, own[i]))[:7]]
    found = N._nearest(ids, x, ids, x, 7)
    assert sorted(zip(*(z.tolist() for z in found), strict=True)) == sorted(want)
    limit = float(np.median(np.sort(own, axis=1)[:, 5])) or 1e-3
    close = [(s, t) for src, dst, _ in N._within(ids, x, ids, x, limit, True) for s, t in zip(src.tolist(), dst.tolist(), strict=True)]
    assert sorted(close) == sorted((ids[i], ids[j]) for i, j in zip(*np.nonzero(own <= limit), strict=True))


def test_search_by_blocks_with_a_bound_keeps_ties():
    x, ids = np.repeat(np.arange(6.0), 50)[:, None], np.arange(300)
    worst = np.full(300, 1.0)
    src, dst, dist = N._nearest(ids, x, ids, x, 60, worst)
    assert dist.max() == 1.0 and np.bincount(src).tolist() == [60] * 300
    assert len(N._nearest(ids, x, ids, x, 60, np.zeros(300))[0]) == 300 * 49


@pytest.mark.parametrize("broadcast_bytes", [1 << 26, 0])
def test_links_have_the_components_of_all_pairs_and_few_edges(spark, broadcast_bytes, monkeypatch):
    from quern.operators.graph import connected_components

    monkeypatch.setattr("quern.operators.pivots.BLOCK_BYTES", 2048)
    x = np.vstack((np.random.default_rng(3).normal(size=(150, 2)), np.full((50, 2), 9.0), np.full((1, 2), 9.5)))
    df = frame(spark, x).repartition(3)
    for eps in (0.25, 0.5):
        parts = lambda e: {(r["node"], r["component"]) for r in connected_components(e).collect()}
        links = N.eps_links(df, eps, broadcast_bytes=broadcast_bytes)
        every = N.eps_join(df, eps)
        assert parts(links) == parts(every)
        tasks = 4 if broadcast_bytes else 400
        assert links.count() < min(every.count(), tasks * 201)
    assert N.eps_links(df, 0).count() == 0
