"""Methods of the library as they run over one small table in memory, step by step.

Every function takes an (n, d) float64 array whose rows are in id order, and breaks ties by the
lower row.
"""

import numpy as np

from quern.operators.kernels import distances


def components(n: int, u: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Label of each of n nodes: the smallest node of its component."""
    label = np.arange(n)
    while len(u):
        low = np.minimum(label[u], label[v])
        new = label.copy()
        np.minimum.at(new, label[u], low)
        np.minimum.at(new, label[v], low)
        new = new[new]
        while (new != new[new]).any():
            new = new[new]
        label = new[label]
        apart = label[u] != label[v]
        u, v = u[apart], v[apart]
    return label


def linkage_cut(x: np.ndarray, threshold: float, ward: bool) -> np.ndarray:
    """Agglomerative clusters below a cut: complete linkage, or Ward's distance."""
    n = len(x)
    if n < 2:
        return np.zeros(n, np.int64)
    d = distances(x)
    np.fill_diagonal(d, np.inf)
    size, parent = np.ones(n), np.arange(n)
    alive = np.ones(n, bool)
    while alive.sum() > 1:
        flat = int(d.argmin())
        i, j = divmod(flat, n)
        if not d[i, j] < threshold:
            break
        i, j = min(i, j), max(i, j)
        if ward:
            a, b, c = size[i], size[j], size
            with np.errstate(invalid="ignore"):
                row = np.sqrt(np.maximum(((a + c) * d[i] ** 2 + (b + c) * d[j] ** 2 - c * d[i, j] ** 2) / (a + b + c), 0))
        else:
            row = np.maximum(d[i], d[j])
        size[i] += size[j]
        alive[j] = False
        row[~alive] = np.inf
        row[i] = np.inf
        d[i], d[:, i], d[j], d[:, j] = row, row, np.inf, np.inf
        parent[parent == j] = i
    return parent


def spanning_tree(d: np.ndarray) -> list[tuple[float, int, int]]:
    """Edges (w, u, v) of a minimum spanning tree of a complete graph, by Prim from row 0."""
    n = len(d)
    best, link, out = d[0].copy() if n else np.zeros(0), np.zeros(n, int), []
    inside = np.zeros(n, bool)
    if n:
        inside[0] = True
    for _ in range(n - 1):
        v = int(np.where(inside, np.inf, best).argmin())
        out.append((float(best[v]), min(int(link[v]), v), max(int(link[v]), v)))
        inside[v] = True
        closer = ~inside & (d[v] < best)
        best[closer], link[closer] = d[v][closer], v
    return out


def tree_split(x: np.ndarray, rows: np.ndarray, ratio: float = 2.4) -> list[np.ndarray]:
    """Cuts the longest tree edge while it is over ``ratio`` times the mean and 1e-4."""
    work, out = [rows], []
    while work:
        part = work.pop()
        edges = spanning_tree(distances(x[part]))
        w = np.array([e[0] for e in edges])
        if len(w) and w.max() > ratio * w.mean() and w.max() > 1e-4:
            cut = int(w.argmax())
            rest = [e for k, e in enumerate(edges) if k != cut]
            label = components(len(part), np.array([e[1] for e in rest], int), np.array([e[2] for e in rest], int))
            work += [part[label == c] for c in np.unique(label)]
        else:
            out.append(part)
    return sorted(out, key=lambda p: p[0])


def refine(x: np.ndarray, eps: float, min_size: int, sigma: float = 2.0, density: float = 0.6, rescue: float = 0.75) -> np.ndarray:
    """Refines one cluster: split by its tree, prune outliers, and of a part that is too
    wide keep only its dense cores.  Returns a part number for each row, -1 for dropped."""
    label, number = np.full(len(x), -1), 0
    if len(x) < min_size:
        return label
    for part in tree_split(x, np.arange(len(x))):
        if len(part) < min_size:
            continue
        r = np.linalg.norm(x[part] - x[part].mean(axis=0), axis=1)
        if r.std() >= 1e-6:
            part = part[r <= r.mean() + sigma * r.std()]
        if len(part) < min_size:
            continue
        wide = np.linalg.norm(x[part] - x[part].mean(axis=0), axis=1).mean()
        limit = eps * density * (1.0 if len(part) >= max(5, min_size + 1) else 1.5)
        cores = [part]
        if eps > 0 and wide > limit:
            u, v = np.nonzero(np.triu(distances(x[part]) <= eps * rescue, 1))
            comp = components(len(part), u, v)
            cores = [part[comp == c] for c in np.unique(comp)]
        for core in cores:
            if len(core) >= min_size:
                label[core] = number
                number += 1
    return label
