"""NumPy distance kernels used inside pair-kernel tasks.

These run on one tile (a bounded block of left vectors against a bounded
block of right vectors) inside an Arrow-batched ``applyInPandas`` task.
Semantics follow the row-wise expressions in :mod:`vectors`.
"""

from __future__ import annotations

import numpy as np


def stack(series) -> np.ndarray:
    """Arrow list column (pandas Series of arrays) -> 2-D float64 matrix."""
    if len(series) == 0:
        return np.zeros((0, 0), dtype=np.float64)
    return np.stack([np.asarray(v, dtype=np.float64) for v in series.to_numpy()])


#: Rows and columns of a block of Manhattan distances.
MANHATTAN_ROWS, MANHATTAN_COLS = 8, 4096


def _unit_rows(x: np.ndarray) -> np.ndarray:
    n = np.sqrt(np.einsum("ij,ij->i", x, x))
    n = np.where(n == 0, 1.0, n)
    return x / n[:, None]


def pairwise(metric: str, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Distance matrix ``(len(a), len(b))``."""
    if a.shape[0] == 0 or b.shape[0] == 0:
        return np.zeros((a.shape[0], b.shape[0]))
    if metric == "cosine":
        s = _unit_rows(a) @ _unit_rows(b).T
        return np.clip(1.0 - s, 0.0, 2.0)
    if metric == "faiss_cosine":
        return 1.0 - _unit_rows(a) @ _unit_rows(b).T
    if metric == "cosine_raw":
        na = np.sqrt(np.einsum("ij,ij->i", a, a))
        nb = np.sqrt(np.einsum("ij,ij->i", b, b))
        with np.errstate(divide="ignore", invalid="ignore"):
            return 1.0 - (a @ b.T) / (na[:, None] * nb[None, :])
    if metric in ("euclidean", "sqeuclidean", "faiss_l2"):
        aa = np.einsum("ij,ij->i", a, a)
        bb = np.einsum("ij,ij->i", b, b)
        sq, ab = aa[:, None] + bb[None, :], a @ b.T
        ab *= 2.0
        sq -= ab
        np.maximum(sq, 0.0, out=sq)
        return sq if metric != "euclidean" else np.sqrt(sq, out=sq)
    if metric == "dot":
        return a @ b.T
    if metric == "manhattan":
        return np.concatenate([x for _, x in _manhattan_rows(a, b)])
    raise ValueError(f"Unknown method: {metric}")


def _manhattan_rows(a: np.ndarray, b: np.ndarray):
    """``(first row, distances of some rows)``, in the precision of ``a`` and ``b``, by
    blocks that stay in the processor's cache."""
    bt = np.ascontiguousarray(b.T)
    for s in range(0, len(a), MANHATTAN_ROWS):
        x = a[s:s + MANHATTAN_ROWS]
        out = np.empty((len(x), len(b)), a.dtype)
        for t in range(0, len(b), MANHATTAN_COLS):
            y = bt[:, t:t + MANHATTAN_COLS]
            total, gap = np.zeros((len(x), y.shape[1]), a.dtype), np.empty((len(x), y.shape[1]), a.dtype)
            for k in range(a.shape[1]):
                np.subtract(x[:, k, None], y[k, None, :], out=gap)
                np.abs(gap, out=gap)
                np.add(total, gap, out=total)
            out[:, t:t + MANHATTAN_COLS] = total
        yield s, out


def nearest_manhattan(a: np.ndarray, b: np.ndarray, k: int):
    """The ``k`` nearest rows of ``b`` for each row of ``a``: ``(row, column, distance)``.

    Single precision narrows the columns down: its error is within ``room``, a bound from
    the sizes of the rows, and every column that may be among the nearest by it is
    measured in double precision."""
    rows, cols, vals = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0)]
    kk = min(k, len(b)) - 1
    with np.errstate(over="ignore", invalid="ignore"):
        middle = b.mean(axis=0) if len(b) else 0.0  # distances do not change by it, their rounding does
        fa, fb = (a - middle).astype(np.float32), (b - middle).astype(np.float32)
        spread = np.abs(a - middle).sum(axis=1) + np.abs(b - middle).sum(axis=1).max(initial=0.0)
        size = np.abs(a).sum(axis=1) + np.abs(b).sum(axis=1).max(initial=0.0)
        room = ((a.shape[1] + 8) * (float(np.finfo(np.float32).eps) * spread + 4 * float(np.finfo(np.float64).eps) * size)
                + a.shape[1] * float(np.finfo(np.float32).tiny))
        for s, near in _manhattan_rows(fa, fb):
            for i, row in enumerate(near, s):
                limit = np.float64(np.partition(row, kk)[kk]) + 2.0 * room[i]
                # with numbers too large for single precision, or none, all are measured
                at = np.flatnonzero(row <= limit) if np.isfinite(limit) and np.isfinite(row).all() else np.arange(len(b))
                d = np.abs(a[i][None, :] - b[at]).sum(axis=1)
                d = np.where(np.isnan(d), np.inf, d)
                best = np.argpartition(d, kk)[:kk + 1] if kk + 1 < len(d) else np.arange(len(d))
                best = best[np.isfinite(d[best])]
                rows.append(np.full(len(best), i))
                cols.append(at[best])
                vals.append(d[best])
    return np.concatenate(rows), np.concatenate(cols), np.concatenate(vals)


def components(n: int, src: np.ndarray, dst: np.ndarray) -> np.ndarray:
    """Connected components of a small graph: label = smallest node index.

    Min-label propagation with pointer jumping, vectorised; used inside one
    tile only (the graph is bounded by the tile size).
    """
    lab = np.arange(n)
    if src.size == 0:
        return lab
    while True:
        new = lab.copy()
        np.minimum.at(new, src, lab[dst])
        np.minimum.at(new, dst, lab[src])
        while True:
            jumped = new[new]
            if np.array_equal(jumped, new):
                break
            new = jumped
        if np.array_equal(new, lab):
            return lab
        lab = new


def rowwise(metric: str, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Distance of row i of ``a`` to row i of ``b`` (same semantics as
    :func:`pairwise`)."""
    if a.shape[0] == 0:
        return np.zeros(0)
    if metric in ("cosine", "faiss_cosine"):
        s = np.einsum("ij,ij->i", _unit_rows(a), _unit_rows(b))
        return np.clip(1.0 - s, 0.0, 2.0) if metric == "cosine" else 1.0 - s
    if metric == "cosine_raw":
        na = np.sqrt(np.einsum("ij,ij->i", a, a))
        nb = np.sqrt(np.einsum("ij,ij->i", b, b))
        with np.errstate(divide="ignore", invalid="ignore"):
            return 1.0 - np.einsum("ij,ij->i", a, b) / (na * nb)
    diff = a - b
    if metric == "euclidean":
        return np.sqrt(np.einsum("ij,ij->i", diff, diff))
    if metric in ("sqeuclidean", "faiss_l2"):
        return np.einsum("ij,ij->i", diff, diff)
    if metric == "manhattan":
        return np.abs(diff).sum(axis=1)
    raise ValueError(f"Unknown method: {metric}")


def group_pairs(lcodes: np.ndarray, rcodes: np.ndarray):
    """All (left row, right row) index pairs with equal group code.

    Rows need not be sorted; returns ``(li, ri)`` ordered by group.
    """
    lo = np.argsort(lcodes, kind="stable")
    ro = np.argsort(rcodes, kind="stable")
    lc, rc = lcodes[lo], rcodes[ro]
    groups, rstart, rcount = np.unique(rc, return_index=True, return_counts=True)
    pos = np.searchsorted(groups, lc)
    pos = np.clip(pos, 0, max(len(groups) - 1, 0))
    present = (len(groups) > 0) & (groups[pos] == lc) if len(groups) else np.zeros(len(lc), bool)
    per_left = np.where(present, rcount[pos] if len(groups) else 0, 0)
    total = int(per_left.sum())
    li = np.repeat(np.arange(len(lc)), per_left)
    starts = np.cumsum(per_left) - per_left
    within = np.arange(total) - np.repeat(starts, per_left)
    ri = np.repeat(rstart[pos] if len(groups) else np.zeros(len(lc), int), per_left) + within
    return lo[li], ro[ri]
