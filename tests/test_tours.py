import numpy as np

from quern.operators import kernels as Kn
from quern.operators import order as O
from quern.operators import tours as T
from tests.fixtures import frame, planted


def random_tree(rng, n, shape):
    """Edges (u, v, w) of a tree over n shuffled ids."""
    ids = rng.permutation(n)
    parent = {"path": lambda i: i - 1, "star": lambda i: 0, "any": lambda i: int(rng.integers(0, i)), "broom": lambda i: i - 1 if i < n // 2 else n // 2 - 1}[shape]
    return [(int(ids[parent(i)]), int(ids[i]), float(rng.integers(1, 5)) if shape == "any" else float(rng.random() + 0.1)) for i in range(1, n)]


def walked(edges):
    """The kernel's order of a tree, by its own ids."""
    ids = sorted({x for u, v, _ in edges for x in (u, v)})
    at = {x: i for i, x in enumerate(ids)}
    return [ids[i] for i in Kn.tree_order(len(ids), sorted((w, at[min(u, v)], at[max(u, v)]) for u, v, w in edges))]


def test_order_equals_the_walk_of_one_task(spark, monkeypatch):
    monkeypatch.setattr(T, "BLOCK", 16)
    rng, rows, want, base = np.random.default_rng(1), [], {}, 0
    for n, shape in [(2, "path"), (3, "star"), (40, "path"), (30, "star"), (60, "any"), (61, "any"), (35, "broom"), (150, "any")]:
        edges = [(u + base, v + base, w) for u, v, w in random_tree(rng, n, shape)]
        part = min(min(u, v) for u, v, _ in edges)
        rows += [(part, min(u, v), max(u, v), w) for u, v, w in edges]
        want[part] = walked(edges)
        base += n
    got = {}
    for r in T.preorder(spark.createDataFrame(rows, "part long, u long, v long, w double")).orderBy("part", "place").collect():
        got.setdefault(r["part"], []).append((r["place"], r["vec_id"]))
    assert {p: [v for _, v in z] for p, z in got.items()} == want
    assert all([a for a, _ in z] == list(range(len(z))) for z in got.values())


def test_dfs_order_by_tours_and_in_tasks(spark):
    x, label = planted(3, (9, 14, 25, 33), 4)
    df = frame(spark, x, label)
    orders = [[(r["pos"], r["vec_id"]) for r in O.dfs_order(df, 6, limit).orderBy("pos").collect()] for limit in (0, 20, 20_000)]
    assert orders[0] == orders[1] == orders[2] and [p for p, _ in orders[0]] == list(range(len(x)))
