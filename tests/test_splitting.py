import numpy as np
import pytest

from quern.operators import splitting as Sp
from tests.fixtures import partition
from tests.reference import refine


def clusters(count=16):
    """Clusters to refine: clumps with strays, copies, chains, single rows."""
    rng = np.random.default_rng(21)
    for k in range(count):
        n, d = int(rng.integers(1, 30)), 3
        x = rng.normal(0, 1, (max(1, n // 10 + 1), d))[rng.integers(0, max(1, n // 10 + 1), n)] * 6 + rng.normal(0, 0.3, (n, d))
        if k % 4 == 0:
            x = np.vstack((x, x[: n // 2]))
        if k % 5 == 0:
            x[0] += 40
        yield x


@pytest.mark.parametrize("eps,min_size", [(1.2, 2), (0.4, 3)])
def test_equal_to_the_kernel(spark, eps, min_size):
    rows, want, at = [], [], 0
    for c, x in enumerate(clusters()):
        rows += [(at + i, v, c) for i, v in enumerate(x.tolist())]
        part = refine(x, eps, min_size)
        want += [[at + i for i in np.flatnonzero(part == p).tolist()] for p in np.unique(part[part >= 0])]
        at += len(x)
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, cluster_id int")
    got = Sp.refined(df, eps, min_size).collect()
    assert partition([{"vec_id": r["vec_id"], "cluster_id": r["label"]} for r in got]) == sorted(want)


def one_by_one(edges, ratio):
    """What is left when the longest edge goes as long as it is over the bound."""
    if not edges:
        return set()
    w, u, v = max(edges, key=lambda e: (e[0], -e[1], -e[2]))
    if not (w > ratio * sum(e[0] for e in edges) / len(edges) and w > 1e-4):
        return {(a, b) for _, a, b in edges}
    rest = [e for e in edges if e[1:] != (u, v)]
    side, grown = {u}, True
    while grown:
        more = {x for _, a, b in rest for x in (a, b) if (a in side) != (b in side)} - side
        grown = bool(more)
        side |= more
    return one_by_one([e for e in rest if e[1] in side], ratio) | one_by_one([e for e in rest if e[1] not in side], ratio)


@pytest.mark.parametrize("most", [4, 4096])
def test_cuts_of_many_at_once_are_those_one_by_one(spark, most):
    rng, rows, want, base = np.random.default_rng(4), [], set(), 0
    for n in (2, 3, 12, 30):
        edges = [(float(rng.pareto(1.0)), base + int(rng.integers(0, i)), base + i) for i in range(1, n)]
        rows += [(base, u, v, w) for w, u, v in edges]
        want |= one_by_one(edges, 2.4)
        base += n
    found = Sp.split_trees(spark.createDataFrame(rows, "tree long, u long, v long, w double"), 2.4, most)
    assert {(r["u"], r["v"]) for r in found.collect()} == want and 0 < len(want) < len(rows)
