"""Small tables of vectors with known structure."""

import numpy as np

SCHEMA = "vec_id long, embedding array<float>, label int"


def frame(spark, x, label=None, ids=None):
    ids = range(len(x)) if ids is None else ids
    label = [0] * len(x) if label is None else label
    return spark.createDataFrame([(int(i), [float(z) for z in v], int(k)) for i, v, k in zip(ids, x, label, strict=True)], SCHEMA)


def unit(x):
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def planted(seed=0, sizes=(6, 10, 18, 30), noise=5, d=8):
    """Tight clusters far apart, then noise; labels from 0, noise -1."""
    rng = np.random.default_rng(seed)
    centres = np.eye(d)[: len(sizes)]
    x = [unit(c + rng.normal(0, 0.02, (n, d))) for c, n in zip(centres, sizes, strict=True)]
    lone = np.eye(d)[len(sizes) : len(sizes) + noise]
    while len(lone) < noise:
        lone = np.vstack((lone, -np.eye(d)[len(lone) - (d - len(sizes))]))
    label = np.concatenate([np.full(n, k) for k, n in enumerate(sizes)] + [np.full(noise, -1)])
    return np.vstack([*x, unit(lone[:noise])]), label


def partition(rows, key="cluster_id"):
    out = {}
    for r in rows:
        if r[key] is not None:
            out.setdefault(r[key], set()).add(r["vec_id"])
    return sorted(map(sorted, out.values()))
