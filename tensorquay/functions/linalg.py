"""Small dense linear algebra in double precision, for grouped Arrow UDFs."""

from __future__ import annotations

import numpy as np


def unpacked_upper(tri: np.ndarray, n: int) -> np.ndarray:
    """The symmetric matrix of a row-major packed upper triangle."""
    m = np.zeros((n, n))
    m[np.triu_indices(n)] = tri
    return m + np.triu(m, 1).T


def packed_upper(m: np.ndarray) -> np.ndarray:
    return m[np.triu_indices(len(m))]


def cholesky(h: np.ndarray) -> np.ndarray:
    """Lower factor; an error that names the first row whose pivot is not positive."""
    n = len(h)
    low = np.zeros((n, n))
    for i in range(n):
        pivot = h[i, i] - low[i, :i] @ low[i, :i]
        if not pivot > 0:
            raise ValueError(f"row {i}: the matrix is not positive definite")
        low[i, i] = np.sqrt(pivot)
        low[i + 1 :, i] = (h[i + 1 :, i] - low[i + 1 :, :i] @ low[i, :i]) / low[i, i]
    return low


def solve_lower(low: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.linalg.solve(low, b)


def solve_lower_transposed(low: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.linalg.solve(low.T, b)


def inverse_column(low: np.ndarray, j: int) -> np.ndarray:
    """Column j of the inverse of low @ low.T."""
    e = np.zeros(len(low))
    e[j] = 1
    return solve_lower_transposed(low, solve_lower(low, e))


def saliency(low: np.ndarray) -> np.ndarray:
    """1 / diagonal of the inverse: what each channel's error costs once the others may answer it."""
    return 1 / (np.linalg.inv(low) ** 2).sum(axis=0)


def pivoted_cholesky(h: np.ndarray, most: int, tolerance: float = 0.0) -> tuple[np.ndarray, list[int]]:
    """(N x k factor, pivots): greedy low rank until the rest of the trace is small; ties take the last."""
    left, n = np.diag(h).astype(float).copy(), len(h)
    stop, factor, pivots = tolerance * left.sum(), np.zeros((n, 0)), []
    while len(pivots) < min(most, n) and left.sum() > stop:
        p = n - 1 - int(np.argmax(left[::-1]))
        if not left[p] > 0:
            break
        column = (h[:, p] - factor @ factor[p]) / np.sqrt(left[p])
        column[pivots] = 0
        factor = np.column_stack([factor, column])
        left = np.maximum(left - column * column, 0)
        left[[*pivots, p]] = 0
        pivots.append(p)
    return factor, pivots


def compensation(h: np.ndarray, region: list[int]) -> tuple[list[int], np.ndarray]:
    """(free channels, M): the change M @ d of the free channels that answers a change d of the region best."""
    n = len(h)
    if len(set(region)) != len(region) or any(not 0 <= r < n for r in region):
        raise ValueError("the region must hold different channels of the matrix")
    region = sorted(region)
    free = [i for i in range(n) if i not in set(region)]
    if not region or not free:
        return free, np.zeros((len(free), len(region)))
    return free, -np.linalg.solve(h[np.ix_(free, free)], h[np.ix_(free, region)])


def matrix_report(h: np.ndarray, rank: int, block: int) -> dict[str, float]:
    """Relative Frobenius errors of cheap forms of a symmetric matrix, its spectrum and symmetry."""
    values, vectors = np.linalg.eigh((h + h.T) / 2)
    norm = np.linalg.norm(h) or 1.0
    top = np.argsort(values)[::-1][:rank]
    low = vectors[:, top] @ np.diag(values[top]) @ vectors[:, top].T
    blocks = np.zeros_like(h)
    for a in range(0, len(h), block):
        blocks[a : a + block, a : a + block] = h[a : a + block, a : a + block]
    keep = np.zeros_like(h)
    strongest = np.argsort(-np.abs(h), axis=0, kind="stable")[:rank]
    np.put_along_axis(keep, strongest, np.take_along_axis(h, strongest, axis=0), axis=0)
    return {
        "low_rank": float(np.linalg.norm(h - low) / norm),
        "sparse": float(np.linalg.norm(h - keep) / norm),
        "block": float(np.linalg.norm(h - blocks) / norm),
        "negative": int((values < -1e-9 * max(1.0, abs(values[-1]))).sum()),
        "asymmetry": float(np.abs(h - h.T).max()),
    }
