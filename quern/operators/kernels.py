"""In-memory kernels for one group of vectors: clustering, linkage, trees and paths.

Every function takes an (n, d) float64 array whose rows are in id order, and breaks ties
by the lower row, so results do not depend on partitioning.
"""

from __future__ import annotations

import heapq
import math

import numpy as np


def distances(x: np.ndarray) -> np.ndarray:
    """All pairwise distances; near-zero ones are taken by direct difference."""
    n = (x * x).sum(axis=1)
    d2 = np.maximum(n[:, None] + n[None, :] - 2 * (x @ x.T), 0)
    r, c = np.nonzero(d2 < 1e-6)
    d2[r, c] = ((x[r] - x[c]) ** 2).sum(axis=1)
    np.fill_diagonal(d2, 0)
    return np.sqrt(d2)


def between(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Distances of all rows of x to all of y; small ones are taken by direct difference."""
    centre = y.mean(axis=0) if len(y) else 0.0
    a, b = x - centre, y - centre
    na, nb = (a * a).sum(axis=1)[:, None], (b * b).sum(axis=1)
    d2 = np.maximum(na + nb - 2 * (a @ b.T), 0)
    r, c = np.nonzero(d2 < 1e-6 * (na + nb))
    d2[r, c] = ((x[r] - y[c]) ** 2).sum(axis=1)
    return np.sqrt(d2)


def rounded_between(x: np.ndarray, y: np.ndarray, places: float) -> np.ndarray:
    """Distances in units of the last place; those near the edge of two are taken by direct
    differences, so that the fast product decides no rounding."""
    d = between(x, y)
    centre = y.mean(axis=0)
    most = ((x - centre) ** 2).sum(axis=1).max() + ((y - centre) ** 2).sum(axis=1).max()
    loose = 8 * (x.shape[1] + 8) * np.finfo(np.float64).eps * most / np.maximum(d, 1e-300)
    d *= places
    r, c = np.nonzero(np.abs(d - np.floor(d) - 0.5) <= loose * places)
    d[r, c] = np.sqrt(((x[r] - y[c]) ** 2).sum(axis=1)) * places
    return np.floor(d + 0.5)


def greedy_block(rows: list[int], near: dict[int, list[int]], hit: dict[int, list[tuple[int, int]]], size: dict[int, int], ratio: float) -> dict[int, int]:
    """Greedy assignment of some rows in order: a row joins the cluster that holds most of its
    neighbours, if those are at least ``ratio`` of the cluster; else it opens one.

    ``near`` gives neighbours among these rows, ``hit`` (cluster, neighbours in it) of clusters
    opened before, ``size`` the sizes of those.  Clusters are named by their first row, and ties
    go to the one opened first.
    """
    of, size = {}, dict(size)
    for i in rows:
        hits = dict(hit.get(i, ()))
        for j in near.get(i, ()):
            hits[of[j]] = hits.get(of[j], 0) + 1
        fit = [(-n, c) for c, n in hits.items() if n >= math.ceil(size[c] * ratio)]
        of[i] = min(fit)[1] if fit else i
        size[of[i]] = size.get(of[i], 0) + 1
    return of


def optics(x: np.ndarray, min_samples: int, max_eps: float, xi: float = 0.05) -> np.ndarray:
    """OPTICS ordering with xi extraction of the smallest clusters; -1 is noise."""
    n = len(x)
    if n < max(2, min_samples):
        return np.full(n, -1)
    d = distances(x)
    core = np.sort(d, axis=1)[:, min_samples - 1]
    core[core > max_eps] = np.inf
    reach, done, order = np.full(n, np.inf), np.zeros(n, bool), []
    for start in range(n):
        if done[start]:
            continue
        heap = [(np.inf, start)]
        while heap:
            r, p = heapq.heappop(heap)
            if done[p] or r > reach[p]:
                continue
            done[p] = True
            order.append(p)
            if np.isinf(core[p]):
                continue
            near = np.flatnonzero(~done & (d[p] <= max_eps))
            new = np.maximum(core[p], d[p][near])
            better = new < reach[near]
            for q, r2 in zip(near[better].tolist(), new[better].tolist(), strict=True):
                reach[q] = r2
                heapq.heappush(heap, (r2, q))
    return steep_clusters(np.array(order), reach, min_samples, xi)


def sparse_reach(n: int, start: np.ndarray, to: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The order of OPTICS and the reach of each row, along edges alone: those from row i are
    start[i] to start[i + 1]."""
    reach, done, order = np.full(n, np.inf), np.zeros(n, bool), []
    for first in range(n):
        heap = [] if done[first] else [(np.inf, first)]
        while heap:
            r, p = heapq.heappop(heap)
            if done[p] or r > reach[p]:
                continue
            done[p] = True
            order.append(p)
            for e in range(start[p], start[p + 1]):
                q, r2 = int(to[e]), float(weight[e])
                if not done[q] and r2 < reach[q]:
                    reach[q] = r2
                    heapq.heappush(heap, (r2, q))
    return np.array(order, dtype=int), reach


def steep_clusters(order: np.ndarray, reach: np.ndarray, min_samples: int, xi: float = 0.05) -> np.ndarray:
    """xi extraction of the smallest clusters from a reachability plot; -1 is noise."""
    n = len(order)
    plot = np.append(reach[order], np.inf)
    with np.errstate(invalid="ignore"):
        down, up = plot[:-1] * (1 - xi) >= plot[1:], plot[:-1] <= plot[1:] * (1 - xi)
        lower, higher = plot[:-1] >= plot[1:], plot[:-1] <= plot[1:]

    def area(steep: np.ndarray, flat: np.ndarray, i: int) -> int:
        end, loose, j = i, 0, i
        while j < n:
            if steep[j]:
                end, loose = j, 0
            elif flat[j]:
                loose += 1
                if loose > min_samples:
                    break
            else:
                break
            j += 1
        return end

    found, falls, mib, i = [], [], 0.0, 0
    while i < n:
        mib = max(mib, plot[i]) if not np.isinf(plot[i]) or i else mib
        if down[i]:
            falls = [[a, b, max(m, mib)] for a, b, m in falls if mib <= plot[a] * (1 - xi)]
            end = area(down, lower, i)
            falls.append([i, end, 0.0])
            i, mib = end + 1, plot[min(end + 1, n)]
            continue
        if up[i]:
            falls = [[a, b, max(m, mib)] for a, b, m in falls if mib <= plot[a] * (1 - xi)]
            end = area(up, higher, i)
            for a, b, m in falls:
                if plot[end + 1] * (1 - xi) < m:
                    continue
                s, e = a, end
                if plot[a] * (1 - xi) >= plot[end + 1]:
                    while s < b and plot[s + 1] > plot[end + 1]:
                        s += 1
                elif plot[end + 1] * (1 - xi) >= plot[a]:
                    while e > i and plot[e - 1] > plot[a]:
                        e -= 1
                if e - s + 1 >= min_samples and s <= b and e >= i:
                    found.append((s, e))
            i, mib = end + 1, plot[min(end + 1, n)]
            continue
        i += 1
    label = np.full(n, -1)
    for number, (s, e) in enumerate(sorted(set(found), key=lambda z: (z[1] - z[0], z))):
        rows = order[s : e + 1]
        if (label[rows] < 0).all():
            label[rows] = number
    return label


def insertion_path(x: np.ndarray, window: int = 40) -> np.ndarray:
    """Farthest insertion: starts at two far ends, then always inserts the row farthest
    from the path, near its closest path row or at an end, where it costs least.

    The start is found from row 0: the row farthest from it, and the row farthest from that.
    """
    n = len(x)
    if n < 2:
        return np.arange(n)
    square = lambda i: ((x - x[i]) ** 2).sum(axis=1)
    a = int(square(0).argmax())
    da = square(a)
    b = int(da.argmax())
    if a == b:
        b = (a + 1) % n
    db = square(b)
    path = [a, b]
    gap, anchor = np.minimum(da, db), np.where(da <= db, a, b)
    gap[[a, b]] = -np.inf
    for _ in range(n - 2):
        f = int(gap.argmax())
        at = path.index(int(anchor[f]))
        low, high = max(0, at - window), min(len(path) - 1, at + window)
        span = np.array(path[low : high + 1])
        to = np.linalg.norm(x[span] - x[f], axis=1)
        step = np.linalg.norm(x[span[1:]] - x[span[:-1]], axis=1)
        cost = np.concatenate(([np.linalg.norm(x[path[0]] - x[f])], to[:-1] + to[1:] - step, [np.linalg.norm(x[path[-1]] - x[f])]))
        best = int(cost.argmin())
        place = 0 if best == 0 else len(path) if best == len(cost) - 1 else low + best
        path.insert(place, f)
        gap[f] = -np.inf
        new = square(f)
        closer = new < gap
        gap[closer], anchor[closer] = new[closer], f
    return np.array(path)


def two_opt(x: np.ndarray, path: np.ndarray) -> np.ndarray:
    """Reverses stretches between fixed ends until none shortens the path by over 1e-6."""
    path = path.copy()
    m = len(path)
    if m < 4:
        return path
    d = distances(x)
    while True:
        p = path
        i, j = np.triu_indices(m - 1, 1)
        keep = i >= 1
        i, j = i[keep], j[keep]
        gain = d[p[i - 1], p[i]] + d[p[j], p[j + 1]] - d[p[i - 1], p[j]] - d[p[i], p[j + 1]]
        best = int(gain.argmax()) if len(gain) else -1
        if best < 0 or gain[best] <= 1e-6:
            return path
        path[i[best] : j[best] + 1] = path[i[best] : j[best] + 1][::-1]


def prim(x: np.ndarray) -> list[tuple[float, int, int]]:
    """Edges (w, u, v), u < v, of the minimum spanning tree of all distances; ties by (w, u, v)."""
    n, out = len(x), []
    rows, best, link = np.arange(n), np.full(n, np.inf), np.zeros(n, int)
    outside, at = np.ones(n, bool), 0
    for _ in range(n - 1):
        outside[at] = False
        d = np.sqrt(((x - x[at]) ** 2).sum(axis=1))
        pair = np.minimum(rows, at) * n + np.maximum(rows, at)
        closer = outside & ((d < best) | ((d == best) & (pair < np.minimum(rows, link) * n + np.maximum(rows, link))))
        best[closer], link[closer] = d[closer], at
        left = np.flatnonzero(outside & (best == best[outside].min()))
        at = int(left[(np.minimum(left, link[left]) * n + np.maximum(left, link[left])).argmin()])
        out.append((float(best[at]), min(at, int(link[at])), max(at, int(link[at]))))
    return out


def tree_order(n: int, edges: list[tuple[float, int, int]], beta: float = 0.3, gamma: float = 1e-4, root: int | None = None) -> list[int]:
    """Depth-first order of a tree from its weighted centre, or from ``root``.

    Children come in order of edge weight, plus a share of the lightest edge onward, less a
    little for each row below.
    """
    near: list[list[tuple[float, int]]] = [[] for _ in range(n)]
    for w, u, v in edges:
        near[u].append((w, v))
        near[v].append((w, u))

    def far(start: int) -> tuple[int, list[float], list[int]]:
        dist, back, stack = [math.inf] * n, [-1] * n, [start]
        dist[start] = 0.0
        while stack:
            u = stack.pop()
            for w, v in near[u]:
                if dist[v] == math.inf:
                    dist[v], back[v] = dist[u] + w, u
                    stack.append(v)
        reached = [i for i in range(n) if dist[i] < math.inf]
        return max(reached, key=lambda i: (dist[i], -i)), dist, back

    if n == 0:
        return []
    centre = root
    if centre is None:
        b, dist, back = far(far(0)[0])
        centre, half = b, dist[b] / 2
        while back[centre] >= 0 and dist[back[centre]] >= half:
            centre = back[centre]
    order, parent, stack = [], [-1] * n, [centre]
    while stack:
        u = stack.pop()
        order.append(u)
        for _, v in near[u]:
            if v != parent[u]:
                parent[v] = u
                stack.append(v)
    size = [1] * n
    for u in reversed(order):
        if parent[u] >= 0:
            size[parent[u]] += size[u]
    out, stack = [], [centre]
    while stack:
        u = stack.pop()
        out.append(u)
        kids = []
        for w, v in near[u]:
            if v != parent[u]:
                onward = min((w2 for w2, y in near[v] if y != u), default=0.0)
                kids.append((w + beta * onward - gamma * size[v], v))
        stack += [v for _, v in sorted(kids, reverse=True)]
    return out


def best_reversal(x: np.ndarray, path: np.ndarray) -> np.ndarray:
    """The one reversal between fixed ends that shortens the path most, if any does."""
    m = len(path)
    if m < 4:
        return path
    d = distances(x)
    i, j = np.triu_indices(m - 1, 1)
    keep = i >= 1
    i, j = i[keep], j[keep]
    gain = d[path[i - 1], path[i]] + d[path[j], path[j + 1]] - d[path[i - 1], path[j]] - d[path[i], path[j + 1]]
    best = int(gain.argmax()) if len(gain) else -1
    if best < 0 or gain[best] <= 1e-6:
        return path
    out = path.copy()
    out[i[best] : j[best] + 1] = out[i[best] : j[best] + 1][::-1]
    return out
