"""The local kernel against brute force, and the engine end to end."""

import numpy as np
import pytest

from pinweave.functions.rng import Xoshiro256PlusPlus
from pinweave.model import Hypergraph, PartitionConfig
from pinweave.operators import kernel, metrics
from pinweave.operators.projection import strategy
from pinweave.plans import engine


def random_hypergraph(rng, n, m):
    size = rng.integers(2, 5, size=m)
    pe = np.repeat(np.arange(m), size)
    return kernel.build(n, rng.integers(1, 4, size=n), np.full(n, -1), rng.integers(1, 5, size=m), pe, rng.integers(0, n, size=len(pe)))


@pytest.mark.parametrize("seed", range(12))
def test_profile_counts_cuts(seed):
    rng = np.random.default_rng(seed)
    h = random_hypergraph(rng, int(rng.integers(4, 12)), int(rng.integers(3, 15)))
    n = h.n
    tree = kernel.Rooted(n, np.arange(1, n), np.array([rng.integers(0, i) for i in range(1, n)]))
    p = kernel.profile(h, tree, h.vwt, None)
    side = np.full(n, -1)
    side[0], side[n - 1] = 0, 1
    forced = kernel.profile(h, tree, h.vwt, side)
    for v in range(1, n):
        inside = np.zeros(n, dtype=bool)
        inside[tree.order[tree.tin[v] : tree.tout[v]]] = True
        assert p.cut[v] == kernel.cut_of(h, inside.astype(int)) and p.weight[v] == h.vwt[inside].sum()
        for q, cost in ((0, forced.exc0[v]), (1, forced.exc1[v])):
            part = np.where(inside, q, 1 - q)
            part[0], part[n - 1] = 0, 1
            assert cost == kernel.cut_of(h, part)


@pytest.mark.parametrize("seed", range(6))
def test_exact_and_gains(seed):
    rng = np.random.default_rng(100 + seed)
    h = random_hypergraph(rng, 8, 12)
    least, most = metrics.limits_of(int(h.vwt.sum()), 2, 10)
    best = min((kernel.cut_of(h, q) for b in range(256) if (w := kernel.weights_of(h, q := np.array([b >> i & 1 for i in range(8)]), 2)).min() >= least and w.max() <= most), default=None)
    found = kernel.exact(h, 2, least, most)
    assert (found is None) == (best is None) and (best is None or kernel.cut_of(h, found) == best)
    s = kernel.State(h, rng.integers(0, 3, size=8), 3)
    for q in range(3):
        for v, d in enumerate(s.deltas(q)):
            if s.part[v] != q:
                after = s.part.copy()
                after[v] = q
                assert d == s.delta(v, q) == kernel.cut_of(h, after) - kernel.cut_of(h, s.part)


@pytest.mark.parametrize("kind", [kernel.spanning_tree, kernel.low_stretch_tree])
def test_trees_span(kind):
    rng = np.random.default_rng(3)
    h = random_hypergraph(rng, 40, 60)
    u, v, w = kernel.graph_of(h, 1, rng)
    x = rng.random((40, 2))
    tree = kernel.Rooted(40, *kind(40, u, v, kernel.lengths((u, v, w), x), x))
    assert sorted(tree.order.tolist()) == list(range(40))


def test_two_cliques_are_found(spark, scratch):
    """Two dense groups with one bridge, an island and a fixed vertex: the bridge is the cut."""
    pins = [(e, v) for e, (a, b) in enumerate((i, j) for g in (0, 15) for i in range(g, g + 15) for j in range(i + 1, g + 15)) for v in (a, b)]
    m = len(pins) // 2
    pins += [(m, 3), (m, 20), (m + 1, 30), (m + 1, 31)]
    verts = spark.createDataFrame([(v, 1, 1 if v == 0 else -1) for v in range(32)], "v long, vwt int, fixed int")
    h = Hypergraph(verts, spark.range(m + 2).selectExpr("id AS e", "1 AS hwt"), spark.createDataFrame(pins, "e long, v long"))
    for cfg in (PartitionConfig(imb=5, refine_iters=1), PartitionConfig(imb=5, local_vertices=3, solver_iters=5, refine_iters=1)):
        got = {r["v"]: r["part"] for r in engine.partition(h, cfg, scratch).collect()}
        assert len(got) == 32 and got[0] == 1
        assert {got[v] for v in range(15)} == {1} and {got[v] for v in range(15, 30)} == {0} and got[30] == got[31]


def test_strategy_names():
    assert strategy("Odd_Even") == strategy("alternating columns") == "alternating" and strategy("prefix") == "leading"
    with pytest.raises(ValueError):
        strategy("none")


def test_generator():
    a, b = Xoshiro256PlusPlus(5), Xoshiro256PlusPlus(5)
    assert a.permutation(50) == b.permutation(50) and sorted(a.permutation(50)) == list(range(50))
    assert a.fork("x").next() == b.fork("x").next() if a.s == b.s else True
    assert all(0 <= a.random() < 1 and a.below(7) < 7 for _ in range(200))


def test_dense_algebra():
    from pinweave.functions import dense

    q = dense.helmert(6)
    assert np.allclose(q.T @ q, np.eye(5)) and np.allclose(q.sum(axis=0), 0)
    rng = np.random.default_rng(0)
    x, s = rng.random((8, 3)), rng.random((8, 8))
    b = s @ s.T
    o = dense.orthonormalize(x, b @ x)
    assert np.allclose(o.T @ b @ o, np.eye(3))
    assert dense.orthonormalize(np.column_stack([x, x[:, 0]])).shape[1] in (3, 4)
    assert np.allclose(dense.project_out(x, o, b @ o), 0)
    a = np.diag(np.arange(8.0))
    val, vec = dense.pencil(a, b)
    assert np.allclose(a @ vec, b @ vec * val) and np.all(np.diff(val) >= 0)
    assert np.allclose(dense.take(val, vec, 2, skip=1), vec[:, 1:3]) and dense.take(val, vec, 1, largest=True)[0] == vec[0, -1]
    assert dense.columns_by_mask(x, np.array([True, False, True])).shape == (8, 2)
    val, vec = dense.pencil(np.eye(3), np.diag([1.0, 1.0, 0.0]))
    assert len(val) == 2


def test_given_solver_is_taken_if_balanced(spark):
    rng = np.random.default_rng(5)
    h = random_hypergraph(rng, 10, 12)
    want = kernel.exact(h, 2, *metrics.limits_of(int(h.vwt.sum()), 2, 10))
    good = engine.local_best(spark, h, PartitionConfig(imb=10, coarse_solver=lambda h, k, least, most: want), rng)
    bad = engine.local_best(spark, h, PartitionConfig(imb=10, coarse_solver=lambda h, k, least, most: np.zeros(h.n, dtype=int)), rng)
    assert (good == want).all() and kernel.cut_of(h, bad) == kernel.cut_of(h, want)
