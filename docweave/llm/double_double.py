"""Sums and matrix products in double-double: an unevaluated sum of two doubles, by error-free transformations."""

from __future__ import annotations

import numpy as np

#: Bits of a slice. Products of two slices over a block of BLOCK rows stay below 2**53, so a block's sum is exact.
SLICE_BITS = 21
BLOCK = 1024
#: Slices of a number. Products of slices whose places add up to SLICES or more are below 2**-84 of the largest.
SLICES = 4

Pair = tuple[np.ndarray, np.ndarray]


def two_sum(a: np.ndarray, b: np.ndarray) -> Pair:
    """a + b as (rounded sum, what rounding lost), exactly (Knuth)."""
    s = a + b
    t = s - a
    return s, (a - (s - t)) + (b - t)


def add(x: Pair, y: Pair) -> Pair:
    """Sum of two double-doubles: high and low parts are added apart and then renormalised."""
    s, e = two_sum(x[0], y[0])
    t, f = two_sum(x[1], y[1])
    s, e = two_sum(s, e + t)
    return two_sum(s, e + f)


def slices(high: np.ndarray, low: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(parts, exponents): columns as sums of SLICES whole numbers of at most SLICE_BITS bits, each scaled by a power of two.

    Column j is the sum over k of parts[k][:, j] * 2**(exponents[j] - SLICE_BITS * (k + 1)), but for less than
    2**-(SLICES * SLICE_BITS) of its largest entry. Taking a slice away leaves no rounding error.
    """
    _, exponents = np.frexp(np.abs(high).max(axis=0, initial=0.0))
    out = np.empty((SLICES, *high.shape))
    for k in range(SLICES):
        at = SLICE_BITS * (k + 1) - exponents
        out[k] = np.rint(np.ldexp(high, at))
        high, low = two_sum(high - np.ldexp(out[k], -at), low)
    return out, exponents


def outer_sums(high: np.ndarray, low: np.ndarray) -> Pair:
    """Sum over rows of each row's outer product with itself, rows given in double-double, as a double-double matrix.

    Each block of rows is cut into slices whose outer products sum up exactly in plain doubles; these exact matrices are
    added with error-free sums, the largest first.
    """
    d = high.shape[1]
    total = np.zeros((d, d)), np.zeros((d, d))
    for at in range(0, len(high), BLOCK):
        part, e = slices(high[at : at + BLOCK], low[at : at + BLOCK])
        scale = e[:, None] + e[None, :]
        for both in range(SLICES):
            for k in range(both // 2 + 1):
                exact = part[k].T @ part[both - k]
                exact = exact if 2 * k == both else exact + exact.T
                total = add(total, (np.ldexp(exact, scale - SLICE_BITS * (both + 2)), np.zeros((d, d))))
    return total


def tridiagonal(a: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(diagonal, off-diagonal, q) with a = q t q^T, by Householder reflections; a is symmetric."""
    a, n = a.astype(np.float64).copy(), len(a)
    q = np.eye(n)
    for k in range(n - 2):
        x = a[k + 1 :, k]
        size = np.abs(x).max()
        if size == 0 or np.abs(x[1:]).max() == 0:
            continue
        v = x / size
        v[0] += np.copysign(np.linalg.norm(v), v[0])
        v /= np.linalg.norm(v)
        a[k + 1 :] -= 2 * np.outer(v, v @ a[k + 1 :])
        a[:, k + 1 :] -= 2 * np.outer(a[:, k + 1 :] @ v, v)
        q[:, k + 1 :] -= 2 * np.outer(q[:, k + 1 :] @ v, v)
    return np.diag(a).copy(), np.diag(a, -1).copy(), q


def _rank_one(d: np.ndarray, z: np.ndarray, rho: float) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues and eigenvectors of diag(d) + rho z z^T with rho > 0, d rising, all gaps and all z clear of zero."""
    n = len(d)
    gap = np.append(np.diff(d), rho * (z @ z))
    # each root lies between its pole and the next one; it is searched as a distance from the nearer pole, so that it stays exact
    away = d[None, :] - (d + gap / 2)[:, None]
    upper = 1 + rho * (z**2 / away).sum(axis=1) < 0  # the root is beyond the middle
    upper[-1] &= n == 1
    pole = np.arange(n) + (upper & (np.arange(n) < n - 1))
    delta = d[None, :] - d[pole][:, None]  # distance of each pole from the chosen one
    low = np.where(pole > np.arange(n), -gap / 2, 0.0)
    high = np.where(pole > np.arange(n), 0.0, np.append(gap[:-1] / 2, gap[-1]))
    for _ in range(200):
        mid = (low + high) / 2
        with np.errstate(divide="ignore"):
            f = 1 + rho * (z**2 / (delta - mid[:, None])).sum(axis=1)
        low, high = np.where(f < 0, mid, low), np.where(f < 0, high, mid)
    shift = (low + high) / 2
    shift = np.where(shift == 0, np.finfo(float).tiny, shift)
    far = shift[:, None] - delta  # eigenvalue i minus pole j
    # the z whose roots these are exactly, so that the vectors are orthogonal (Gu and Eisenstat)
    ratio = far.copy()
    span = d[None, :] - d[:, None]
    for j in range(n):
        ratio[:j, j] /= span[j, :j]
        ratio[j:-1, j] /= span[j, j + 1 :]
    exact = np.copysign(np.sqrt(np.abs(ratio.prod(axis=0))), z)
    vectors = exact[:, None] / -far.T
    return d[pole] + shift, vectors / np.linalg.norm(vectors, axis=0)


def _merge(d: np.ndarray, z: np.ndarray, rho: float, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues (rising) and eigenvectors of q (diag(d) + rho z z^T) q^T."""
    if rho < 0:
        w, v = _merge(-d, z, -rho, q)
        return -w[::-1], v[:, ::-1]
    order = np.argsort(d, kind="stable")
    d, z, q = d[order].copy(), z[order].copy(), q[:, order].copy()
    small = 8 * np.finfo(float).eps * max(np.abs(d).max(), rho * np.abs(z).max(), np.finfo(float).tiny)
    last = -1
    for k in range(len(d)):  # deflation: what hardly couples, and poles that hardly differ
        if rho * abs(z[k]) <= small:
            z[k] = 0.0
            continue
        if last >= 0 and d[k] - d[last] <= small:
            r = np.hypot(z[last], z[k])
            c, s = z[k] / r, z[last] / r
            q[:, [last, k]] = np.stack((c * q[:, last] - s * q[:, k], s * q[:, last] + c * q[:, k]), axis=1)
            z[last], z[k] = 0.0, r
        last = k
    live = np.flatnonzero(z)
    w = d.copy()
    if len(live):
        w[live], v = _rank_one(d[live], z[live], rho)
        q[:, live] = q[:, live] @ v
    order = np.argsort(w, kind="stable")
    return w[order], q[:, order]


def divide_and_conquer(d: np.ndarray, e: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues (rising) and eigenvectors of the tridiagonal matrix with diagonal d and off-diagonal e (Cuppen).

    The matrix is torn in two by a rank-one change, both halves are solved, and the change is put back by the roots of
    the secular equation.
    """
    n = len(d)
    if n == 1:
        return d.astype(np.float64), np.ones((1, 1))
    m, rho = n // 2, float(e[n // 2 - 1])
    left, right = d[:m].astype(np.float64), d[m:].astype(np.float64)
    left[-1] -= rho
    right[0] -= rho
    (w1, q1), (w2, q2) = divide_and_conquer(left, e[: m - 1]), divide_and_conquer(right, e[m:])
    q = np.zeros((n, n))
    q[:m, :m], q[m:, m:] = q1, q2
    return _merge(np.concatenate((w1, w2)), np.concatenate((q1[-1], q2[0])), rho, q)


def eigen(a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues, falling, and unit eigenvectors (columns) of a symmetric matrix; signs: the largest entry is positive."""
    scale = np.abs(a).max(initial=0.0) or 1.0
    d, e, q = tridiagonal(a / scale)
    w, v = divide_and_conquer(d, e)
    w, v = w[::-1] * scale, (q @ v)[:, ::-1]
    return w, v * np.where(v[np.abs(v).argmax(axis=0), np.arange(len(a))] < 0, -1.0, 1.0)
