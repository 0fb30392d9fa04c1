"""Pairs at the very limit of 0.93 share a cell; with 8 tables 9 in 6,000 of them did not."""

import numpy as np

from pinweave.llm import vectors


def test_no_pair_at_the_limit_is_missed():
    rng, n = np.random.default_rng(5), 6000
    x = rng.standard_normal((n, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    y = rng.standard_normal((n, 64))
    y -= (y * x).sum(axis=1, keepdims=True) * x
    y = 0.93 * x + np.sqrt(1 - 0.93**2) * y / np.linalg.norm(y, axis=1, keepdims=True)
    planes = vectors.projections(64)
    missed = 0
    for at in range(0, n, 1000):
        a, b = (vectors.cells(z[at : at + 1000], planes).reshape(-1, vectors.TABLES, vectors.CELLS) for z in (x, y))
        missed += int((~(a[:, :, :, None] == b[:, :, None, :]).any(axis=(1, 2, 3))).sum())
    assert missed == 0
