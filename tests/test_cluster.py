import numpy as np
import pytest

from quern.operators import cluster as C
from quern.operators.kernels import distances
from tests.fixtures import frame, partition, planted, unit
from tests.reference import linkage_cut


@pytest.fixture(scope="module")
def blobs(spark):
    x, label = planted()
    df = frame(spark, x, label).cache()
    want = sorted(np.flatnonzero(label == k).tolist() for k in range(4))
    return df, want


METHODS = {
    "greedy": lambda d: C.greedy_distance(d, 0.35, 50, 2),
    "cc": lambda d: C.cc_graph(d, 0.35, 2),
    "mutual": lambda d: C.mutual_graph(d, 0.35, 2),
    "dbscan": lambda d: C.dbscan(d, 0.35, 3),
    "adaptive": lambda d: C.adaptive_graph(d, 0.35, 2),
    "complete": lambda d: C.complete_linkage(d, 0.5, 2),
    "ward": lambda d: C.ward(d, 0.6, 2),
    "hdbscan": lambda d: C.hdbscan(d, 5),
    "optics": lambda d: C.optics(d, 0.35, 4),
}


@pytest.mark.parametrize("name", [n for n in METHODS if n not in ("hdbscan", "optics")])
def test_finds_planted_clusters(blobs, name):
    df, want = blobs
    assert partition(METHODS[name](df).collect()) == want


@pytest.mark.parametrize("name", ["hdbscan", "optics"])
def test_density_methods_stay_inside_clusters(blobs, name):
    df, want = blobs
    got = partition(METHODS[name](df).collect())
    assert got and all(any(set(g) <= set(w) for w in want) for g in got)


def test_numbers_and_discards(blobs):
    df, _ = blobs
    rows = C.cc_graph(df, 0.35, 7).collect()
    least = {}
    for r in rows:
        if r["cluster_id"] is not None:
            least[r["cluster_id"]] = min(r["vec_id"], least.get(r["cluster_id"], 1 << 60))
    assert sorted(least) == [1, 2, 3] and sorted(least.values()) == [least[k] for k in (1, 2, 3)]
    assert len(rows) == 69


@pytest.mark.parametrize("ratio", [0.3, 0.5, 1.0])
def test_greedy_matches_plain_scan(spark, ratio):
    x = unit(np.random.default_rng(int(ratio * 10)).normal(size=(60, 4)))
    eps = 0.6
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1))
    groups = []
    for i in range(len(x)):
        best = None
        for g in groups:
            hit = sum(1 for j in g if d[i, j] < eps)
            if hit >= np.ceil(len(g) * ratio) and (best is None or hit > best[0]):
                best = (hit, g)
        best[1].append(i) if best else groups.append([i])
    got = partition(C.greedy_distance(frame(spark, x.astype(np.float64)), eps, ratio * 100, 1).collect())
    assert got == sorted(groups)


def test_dbscan_border_goes_to_the_first_cluster(spark):
    x = np.array([[0.0], [0.1], [0.2], [0.95], [1.7], [1.8], [1.9]])
    rows = C.dbscan(frame(spark, x), 0.8, 4).collect()
    assert {r["vec_id"]: r["cluster_id"] for r in rows}[3] == 1


def test_degenerate(spark):
    one = frame(spark, np.eye(2)[:1])
    assert [r["cluster_id"] for r in C.greedy_distance(one, 0.0).collect()] == [None]
    assert [r["cluster_id"] for r in C.greedy_distance(one, 0.5, 50, 1).collect()] == [1]
    assert C.cc_graph(frame(spark, np.zeros((0, 2))), 0.5).count() == 0


def test_complete_linkage_diameter():
    x = unit(np.random.default_rng(5).normal(size=(80, 3)))
    label = linkage_cut(x, 0.7, ward=False)
    d = distances(x)
    assert all(d[np.ix_(label == c, label == c)].max() < 0.7 for c in np.unique(label))


def test_refine_only_removes(blobs):
    df, _ = blobs
    base = C.cc_graph(df, 0.35, 2)
    kept = {r["vec_id"] for r in C.refine(df, base, 0.35, 2).where("cluster_id is not null").collect()}
    assert kept and kept <= {r["vec_id"] for r in base.where("cluster_id is not null").collect()}


def test_refuses_large_groups(blobs):
    df, _ = blobs
    with pytest.raises(ValueError):
        C.optics(df, 0.5, max_rows=10)


def test_pca_whitening(spark):
    x = np.random.default_rng(2).normal(size=(50, 5)) @ np.diag([5, 3, 2, 1, 0.5])
    rows = C.pca_whiten(frame(spark, x), 3).orderBy("vec_id").collect()
    y = np.array([r["embedding"] for r in rows])
    assert np.allclose(np.cov(y.T), np.eye(3), atol=1e-3) and np.allclose(y.mean(axis=0), 0, atol=1e-4)


@pytest.mark.parametrize("eps,size", [(0.0, 3), (0.0, 2), (0.9, 4), (0.35, 5)])
def test_optics_by_edges_is_that_by_all_distances(spark, blobs, eps, size):
    from quern.operators import kernels

    rng = np.random.default_rng(8)
    for x in (rng.normal(size=(80, 3)), np.vstack([c + 0.1 * rng.normal(size=(25, 3)) for c in np.eye(3)])):
        df = frame(spark, x)
        label = kernels.optics(x.astype(np.float32).astype(float), size, eps or np.inf)
        want = sorted(np.flatnonzero(label == c).tolist() for c in set(label.tolist()) - {-1})
        assert partition(C.optics(df, eps, size).collect()) == want
