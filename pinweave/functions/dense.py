"""Small dense algebra for the driver: bases, orthonormal blocks, projected pencils."""

from __future__ import annotations

import numpy as np

DROP = 1e-10


def helmert(n: int) -> np.ndarray:
    """n by n-1: an orthonormal basis of all that sums to nothing."""
    out = np.zeros((n, max(n - 1, 0)))
    for j in range(1, n):
        out[:j, j - 1] = 1.0
        out[j, j - 1] = -float(j)
        out[:, j - 1] /= np.sqrt(j * (j + 1.0))
    return out


def whiten(g: np.ndarray, drop: float = DROP) -> np.ndarray:
    """T with T' g T = 1 on the directions of a symmetric g that are not null."""
    val, vec = np.linalg.eigh((g + g.T) / 2)
    keep = val > drop * max(float(val.max(initial=0.0)), 1e-300)
    return vec[:, keep] / np.sqrt(val[keep])


def orthonormalize(x: np.ndarray, bx: np.ndarray | None = None) -> np.ndarray:
    """Columns of x made orthonormal in the product whose image of x is bx: by Cholesky, or by whitening (twice) where that fails."""
    g = x.T @ (x if bx is None else bx)
    try:
        return np.linalg.solve(np.linalg.cholesky((g + g.T) / 2), x.T).T
    except np.linalg.LinAlgError:
        t = whiten(g)
        x = x @ t
        return x if bx is None or not x.shape[1] else x @ whiten(x.T @ (bx @ t))


def project_out(x: np.ndarray, y: np.ndarray, by: np.ndarray) -> np.ndarray:
    """x less its part along y in the product whose image of y is by."""
    return x - y @ np.linalg.lstsq(y.T @ by, by.T @ x, rcond=None)[0] if y.shape[1] else x


def pencil(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ascending eigenpairs of A x = lambda B x: by Cholesky of B, or on its range where B is singular."""
    a = (a + a.T) / 2
    try:
        low = np.linalg.cholesky((b + b.T) / 2)
        inv = np.linalg.inv(low)
        val, vec = np.linalg.eigh(inv @ a @ inv.T)
        return val, inv.T @ vec
    except np.linalg.LinAlgError:
        t = whiten(b)
        val, vec = np.linalg.eigh(t.T @ a @ t)
        return val, t @ vec


def take(val: np.ndarray, vec: np.ndarray, d: int, largest: bool = False, skip: int = 0) -> np.ndarray:
    """d eigenvectors from either end after skipping some; equal values keep their order."""
    order = np.argsort(-val if largest else val, kind="stable")
    return vec[:, order[skip : skip + d]]


def columns_by_mask(x: np.ndarray, mask: np.ndarray) -> np.ndarray:
    """The columns that a mask leaves active."""
    return x[:, np.flatnonzero(mask)]
