"""Brute-force NumPy definitions used as test oracles (tests only)."""

from __future__ import annotations

import numpy as np


def cos_lib(a, b):
    na = np.linalg.norm(a, axis=1, keepdims=True)
    nb = np.linalg.norm(b, axis=1, keepdims=True)
    ua = np.divide(a, na, out=np.zeros_like(a), where=na != 0)
    ub = np.divide(b, nb, out=np.zeros_like(b), where=nb != 0)
    return np.clip(1 - ua @ ub.T, 0, 2)


def euclid(a, b):
    return np.sqrt(((a[:, None, :] - b[None, :, :]) ** 2).sum(-1))


def silhouette(x, labels, dist=euclid):
    d = dist(x, x)
    out = []
    for i in range(len(x)):
        own = labels == labels[i]
        if own.sum() <= 1:
            out.append(0.0)
            continue
        a = d[i, own].sum() / (own.sum() - 1)
        b = min(d[i, labels == l].mean() for l in set(labels) if l != labels[i])
        out.append((b - a) / max(a, b) if max(a, b) > 0 else 0.0)
    return float(np.mean(out))


def dbscan(x, eps, min_samples):
    d = euclid(x, x)
    nb = [np.nonzero(d[i] <= eps)[0] for i in range(len(x))]
    core = np.array([len(n) >= min_samples for n in nb])
    labels = np.full(len(x), -1)
    c = 0
    for i in range(len(x)):
        if labels[i] != -1 or not core[i]:
            continue
        stack = [i]
        labels[i] = c
        while stack:
            p = stack.pop()
            if not core[p]:
                continue
            for q in nb[p]:
                if labels[q] == -1:
                    labels[q] = c
                    stack.append(q)
        c += 1
    return labels


def same_partition(a, b):
    """Equal up to renaming of labels (noise -1 must match exactly)."""
    a, b = np.asarray(a), np.asarray(b)
    if not np.array_equal(a == -1, b == -1):
        return False
    m = {}
    for x, y in zip(a, b):
        if m.setdefault(x, y) != y:
            return False
    return len(set(m.values())) == len(m)


def hdbscan(x, least, min_samples):
    """Labels and number of clusters from the definition: components of the
    mutual-reachability graph at every distinct weight, from the top down."""
    d = euclid(x, x)
    np.fill_diagonal(d, 0.0)
    core = np.sort(d, axis=1)[:, min_samples]
    m = np.maximum(np.maximum(core[:, None], core[None, :]), d)
    n = len(x)
    m = np.round(m, 9)

    def parts(ids, w):
        """Components of ``ids`` by edges below ``w``."""
        ids, out = set(ids), []
        while ids:
            todo, comp = [ids.pop()], []
            while todo:
                i = todo.pop()
                comp.append(i)
                near = [j for j in ids if m[i, j] < w]
                ids.difference_update(near)
                todo += near
            out.append(sorted(comp))
        return out

    def widest(ids):
        """Largest weight of the spanning tree of ``ids``."""
        for w in sorted({m[i, j] for i in ids for j in ids if i < j}):
            if len(parts(ids, np.nextafter(w, np.inf))) == 1:
                return w

    count = 0

    def grow(ids, birth):
        """(best sum, chosen clusters, own stability, kept) of a cluster."""
        nonlocal count
        count += 1
        stability, cur = 0.0, ids
        while True:
            w = widest(cur)
            lam = 1 / max(w, 1e-300)
            split = parts(cur, w)
            big = [p for p in split if len(p) >= least]
            if len(big) == 1:
                stability += (len(cur) - len(big[0])) * (lam - birth)
                cur = big[0]
                continue
            stability += len(cur) * (lam - birth)
            kids = [grow(p, lam) for p in big]
            below = sum(k[0] for k in kids)
            chosen = [c for k in kids for c in k[1]]
            if kids and below > stability:
                return below, chosen, chosen
            return stability, [ids], chosen

    chosen = grow(list(range(n)), 0.0)[2]  # the root is not selectable
    labels = [-1] * n
    for k, ids in enumerate(sorted(chosen)):
        for i in ids:
            labels[i] = k
    return labels, count
