import numpy as np
import pytest

from quern.operators import kernels as Kn
from quern.operators import metrics as M
from quern.operators import order as O
from quern.operators import packing as P
from tests.fixtures import frame, planted


def positions(df):
    rows = df.orderBy("pos").collect()
    assert [r["pos"] for r in rows] == list(range(len(rows)))
    return [r["vec_id"] for r in rows]


@pytest.fixture(scope="module")
def blobs(spark):
    x, label = planted()
    return frame(spark, x, label).cache(), x, label


def length(x, path):
    return float(np.linalg.norm(np.diff(x[path], axis=0), axis=1).sum())


def test_orders_are_permutations_and_two_opt_never_lengthens(spark, blobs):
    df, x, _ = blobs
    for order in (O.dfs_order(df, 5), O.insertion_order(df, 4)):
        path = positions(order)
        assert sorted(path) == list(range(len(x)))
        better = positions(O.block_two_opt(df, order, 20, 15))
        assert sorted(better) == sorted(path) and length(x, better) <= length(x, path) + 1e-9
        polished = positions(O.polish_longest(df, order, 5, 8))
        assert sorted(polished) == sorted(path) and length(x, polished) <= length(x, path) + 1e-9


def test_line_is_found(spark):
    at = np.random.default_rng(0).permutation(40)
    path = Kn.insertion_path(at[:, None].astype(float))
    assert abs(length(at[:, None].astype(float), path) - 39) < 1e-9


def test_spanning_forest_weight(spark, blobs):
    df, x, _ = blobs
    graph = O.neighbor_graph(df, 6)
    edges = sorted((r["w"], r["u"], r["v"]) for r in graph.collect())
    parent = list(range(len(x)))

    def find(a):
        while parent[a] != a:
            a = parent[a]
        return a

    want = []
    for w, u, v in edges:
        a, b = find(u), find(v)
        if a != b:
            parent[a] = b
            want.append((u, v))
    assert sorted((r["u"], r["v"]) for r in O.minimum_spanning_forest(graph).collect()) == sorted(want)


def test_repair(spark):
    nodes = frame(spark, np.eye(4))
    broken = spark.createDataFrame([(0, 2), (1, 2), (2, 0), (3, 9)], "pos long, vec_id long")
    assert positions(O.repaired(broken, nodes)) == [2, 0, 1, 3]


def test_packing_conserves(spark, blobs):
    from quern.operators.cluster import cc_graph

    df, x, _ = blobs
    base = cc_graph(df, 0.35, 2)
    for similar in (False, True):
        seq = positions(P.fill_groups(df, base, 10, similar=similar))
        assert sorted(seq) == list(range(len(x)))
    assert sorted(positions(P.cluster_sort(df, base, 10))) == list(range(len(x)))
    parts = P.split_clusters(df, base, 10, "fi").groupBy("cluster_id", "part").count().collect()
    assert max(r["count"] for r in parts) <= 10


def test_pack():
    assert P.pack([4, 4, 4], 10, 100) == [[0, 1], [2]]
    assert P.pack([6, 6, 4, 4], 10, 0) == [[0, 2], [1, 3]]
    with pytest.raises(ValueError):
        P.pack([11], 10, 0)


def test_metrics_on_a_perfect_order(spark):
    x = np.arange(30, dtype=float)[:, None]
    df = frame(spark, x, [0] * 15 + [1] * 15)
    order = df.selectExpr("vec_id pos", "vec_id")
    r = M.evaluate(df, order, 4).first()
    assert r["path_length"] == 29 and r["max_edge"] == 1 and abs(r["path_smoothness"] - 1) < 1e-9
    assert r["n_runs"] == 2 and r["label_homogeneity"] == 1 and r["boundary_consistency"] == 1
    assert r["knn_recall_w10"] == 1


def test_average_rank(spark):
    df = spark.createDataFrame([(3.0,), (1.0,), (3.0,), (2.0,)], "a double")
    assert sorted((r["a"], r["r"]) for r in M.average_rank(df, "a", "r").collect()) == [(1.0, 1.0), (2.0, 2.0), (3.0, 3.5), (3.0, 3.5)]


@pytest.mark.parametrize("block", [1, 3, 100])
def test_parts_are_put_in_a_row(spark, block):
    sizes = [3, 1, 4, 1, 5, 2, 6]
    parts = [(p, k, 100 * p + k) for p, n in enumerate(sizes) for k in range(n)]
    order = [(p, n, len(sizes) - p) for p, n in enumerate(sizes)]
    got = O._concatenate(spark.createDataFrame(parts, "part long, place long, vec_id long"), spark.createDataFrame(order, "part long, size long, rank long"), block)
    want = [100 * p + k for p in reversed(range(len(sizes))) for k in range(sizes[p])]
    assert [(r["pos"], r["vec_id"]) for r in got.orderBy("pos").collect()] == list(enumerate(want))
