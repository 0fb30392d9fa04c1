"""Trees in tables against the array kernel, at depths and degrees that no walk by levels would take."""

import numpy as np
import pytest

from pinweave.model import Hypergraph
from pinweave.operators import cuts, euler, kernel


def shape(kind, n, rng):
    if kind == "path":
        return np.arange(1, n), np.arange(n - 1)
    if kind == "star":
        return np.arange(1, n), np.zeros(n - 1, dtype=int)
    return np.arange(1, n), np.array([rng.integers(0, i) for i in range(1, n)])


@pytest.mark.parametrize("kind,n", [("path", 10_000), ("star", 300), ("random", 200)])
def test_profiles_equal_the_kernel(spark, scratch, kind, n):
    rng = np.random.default_rng(n)
    a, b = shape(kind, n, rng)
    m = 150
    sizes = rng.integers(2, 8, size=m)
    pe = np.repeat(np.arange(m), sizes)
    pv = rng.integers(0, n, size=len(pe))
    fixed = np.where(rng.random(n) < 0.1, rng.integers(0, 2, size=n), -1)
    local = kernel.build(n, rng.integers(1, 4, size=n), fixed, rng.integers(1, 6, size=m), pe, pv)
    rows = lambda *c: [tuple(int(x) for x in r) for r in zip(*c, strict=True)]
    h = Hypergraph(
        spark.createDataFrame(rows(range(n), local.vwt, local.fixed), "v long, vwt int, fixed int"),
        spark.createDataFrame(rows(range(local.m), local.hwt), "e long, hwt int"),
        spark.createDataFrame(rows(local.pe, local.pv), "e long, v long"),
    )
    tree = euler.rooted(spark.createDataFrame(rows(a, b), "u long, v long"), 0, scratch)
    got = {r["v"]: r for r in tree.collect()}
    own = kernel.Rooted(n, a, b)
    assert all((got[v]["parent"] or 0) == max(own.parent[v], 0) and got[v]["depth"] == own.depth[v] for v in range(n))
    assert sorted(r["tin"] for r in got.values()) == list(range(n)) and all(got[v]["tout"] - got[v]["tin"] == own.tout[v] - own.tin[v] for v in range(n))
    sides = spark.createDataFrame([(int(v), int(fixed[v])) for v in np.flatnonzero(fixed >= 0)], "v long, side tinyint")
    for side, table in ((None, None), (fixed, sides)):
        want = kernel.profile(local, own, local.vwt, side)
        for r in cuts.cut_profile(h, tree, table, scratch).collect():
            assert (r["weight"], r["exc0"], r["exc1"]) == (want.weight[r["v"]], want.exc0[r["v"]], want.exc1[r["v"]])


def test_sweep_cuts_within_limits(spark, scratch):
    n = 40  # four clusters of ten on a path
    pins = [(e, v) for e in range(36) for v in (e + e // 9, e + e // 9 + 1)] + [(100 + c, 10 * c + i) for c in range(4) for i in range(10)] + [(200 + c, 10 * c + 9 + i) for c in range(3) for i in (0, 1)]
    h = Hypergraph(spark.createDataFrame([(v, 1, -1) for v in range(n)], "v long, vwt int, fixed int"), spark.createDataFrame([(e, 1) for e in {e for e, _ in pins}], "e long, hwt int"), spark.createDataFrame(pins, "e long, v long"))
    tree = euler.rooted(spark.createDataFrame([(i, i + 1) for i in range(n - 1)], "u long, v long"), 0, scratch)
    for k in (2, 4):
        part = {r["v"]: r["part"] for r in cuts.tree_sweep(h, tree, None, k, 8, 22 if k == 2 else 12, scratch).collect()}
        assert sorted(part) == list(range(n)) and {part[v] for v in range(n)} == set(range(k))
        assert all(part[v] == part[v - v % 10] for v in range(n))


def test_single_vertex_and_ancestors(spark, scratch):
    one = euler.rooted(spark.createDataFrame([], "u long, v long"), 5, scratch).collect()
    assert [tuple(r) for r in one] == [(5, None, 0, 1, 0)]
    tree = euler.rooted(spark.createDataFrame([(0, 1), (1, 2), (0, 3), (3, 4)], "u long, v long"), 0, scratch)
    got = euler.ancestors(tree, spark.createDataFrame([(1,), (3,)], "a long")).collect()
    assert sorted((r["v"], r["a"]) for r in got) == [(1, 1), (2, 1), (3, 3), (4, 3)]
