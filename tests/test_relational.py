"""The micro hypergraph, followed through the operators by hand."""

import numpy as np
import pytest

from pinweave.model import Hypergraph, PartitionConfig, validate
from pinweave.operators import cuts, graphs, incidence, islands, metrics, overlay, spectral
from pinweave.sources import files

TEXT = """6 8 11
2 1 2
1 2 3 4
3 1 2 3 4
1 4 5
5 6
1 7 8
1
2
1
1
3
1
2
2
"""
FIXED = "-1\n-1\n-1\n-1\n-1\n-1\n1\n-1\n"


@pytest.fixture(scope="module")
def h(spark, tmp_path_factory):
    d = tmp_path_factory.mktemp("hgr")
    (d / "t.hgr").write_text(TEXT)
    (d / "t.fix").write_text(FIXED)
    return files.read_hypergraph(spark, str(d / "t.hgr"), str(d / "t.fix"))


def part(spark, labels):
    return spark.createDataFrame(list(enumerate(labels)), "v long, part int")


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def small(h):
    five = h.vertices.where("v < 5")
    return incidence.restrict(h, five)


def test_read(h):
    assert [r["hwt"] for r in h.hyperedges.orderBy("e").collect()] == [2, 1, 3, 1, 5, 1]
    assert [r["vwt"] for r in h.vertices.orderBy("v").collect()] == [1, 2, 1, 1, 3, 1, 2, 2]
    assert [r["fixed"] for r in h.vertices.orderBy("v").collect()] == [-1] * 6 + [1, -1]


@pytest.mark.parametrize("text,error", [("", "empty"), ("3\n", "begins"), ("2 2\n1 2\n", "ends"), ("1 2\n1 3\n", "names")])
def test_read_rejects(text, error):
    with pytest.raises(ValueError, match=error):
        list(files.parse_hypergraph(text.splitlines()))


def test_header_formats():
    plain = list(files.parse_hypergraph(["1 2", "1 2"]))
    assert plain == [("e", 0, 0, 1), ("p", 0, 0, 0), ("p", 0, 1, 1), ("v", 0, 0, 1), ("v", 1, 0, 1)]
    blank = list(files.parse_hypergraph(["2 2 1", "", "4 1 2", "", "7"]))
    assert blank == [("e", 0, 0, 1), ("e", 1, 0, 4), ("p", 1, 0, 0), ("p", 1, 1, 1), ("v", 0, 0, 7), ("v", 1, 0, 1)]


def test_write_and_read_again(spark, h, tmp_path):
    files.write_hypergraph(h, str(tmp_path / "o.hgr"))
    again = files.read_hypergraph(spark, str(tmp_path / "o.hgr"))
    assert rows(again.pins) == rows(h.pins) and rows(again.hyperedges) == rows(h.hyperedges)
    files.write_hypergraph(h, str(tmp_path / "p.hgr"), vwt_plus_one=True)
    assert [r["vwt"] for r in files.read_hypergraph(spark, str(tmp_path / "p.hgr")).vertices.orderBy("v").collect()] == [2, 3, 2, 2, 4, 2, 3, 3]
    files.write_partition(part(spark, [1, 0, None]), str(tmp_path / "p.part"))
    assert (tmp_path / "p.part").read_text() == "1\n0\n-1\n"
    assert files.read_partition_if_valid(spark, str(tmp_path / "p.part"), 4) is None
    assert files.read_partition_if_valid(spark, str(tmp_path / "p.part"), 3) is not None


def test_metis_and_results(spark, tmp_path):
    g = spark.createDataFrame([(0, 1, 2.7), (1, 2, float("inf"))], "u long, v long, w double")
    files.write_metis_graph(g, spark.range(4).withColumnRenamed("id", "v"), str(tmp_path / "g"))
    assert (tmp_path / "g").read_text() == "4 2 001\n2 2\n1 2 3 0\n2 0\n\n"
    files.write_results(g, str(tmp_path / "r.md"), "md")
    assert (tmp_path / "r.md").read_text().startswith("| u | v | w |")
    (tmp_path / "c.tsv").write_text("name\thypergraph\tnum_parts\tseed\n# no\na\tb\t2\t1\n")
    assert files.read_cases(spark, str(tmp_path / "c.tsv")).count() == 1


def test_components_and_lift(spark, h, scratch):
    comps = islands.numbered(islands.components(h, scratch), scratch)
    assert rows(comps) == [(0, 0), (1, 0), (2, 0), (3, 0), (4, 0), (5, 1), (6, 2), (7, 2)]
    main = islands.main_component(h, comps)
    assert rows(main.vertices.select("v")) == [(v,) for v in range(5)] and main.hyperedges.count() == 4
    lifted = islands.lift(h, comps, part(spark, [0, 0, 1, 1, 1]), 2)
    assert [p for _, p in rows(lifted)] == [0, 0, 1, 1, 1, 0, 1, 1]
    assert metrics.evaluate(h, lifted, 2).first()["balance"] == [4, 9]
    assert metrics.balance_penalty(h, lifted, 2, 2).first()["penalty"] == 8


def test_lift_splits_conflicts_by_weight(spark, scratch):
    verts = spark.createDataFrame([(0, 1, -1), (1, 1, -1), (2, 1, -1), (3, 1, 0), (4, 5, 1), (5, 1, -1)], "v long, vwt int, fixed int")
    pins = spark.createDataFrame([(0, 0), (0, 1), (0, 2), (0, 2), (1, 3), (1, 4), (1, 5)], "e long, v long").distinct()
    hh = Hypergraph(verts, spark.createDataFrame([(0, 1), (1, 1)], "e long, hwt int"), pins)
    comps = spark.createDataFrame([(0, 0), (1, 0), (2, 0), (3, 1), (4, 1), (5, 1)], "v long, comp long")
    assert [p for _, p in rows(islands.lift(hh, comps, part(spark, [0, 1, 0]), 2))] == [0, 1, 0, 0, 1, 1]


def test_evaluate_and_gains(spark, h):
    s = small(h)
    p = part(spark, [0, 0, 1, 1, 1])
    assert tuple(metrics.evaluate(s, p, 2).first()) == (4, [3, 5])
    assert rows(metrics.balance_limits(s, 2, 2)) == [(3, 5)] and rows(metrics.balance_limits(h, 2, 2)) == [(6, 7)]
    gains = {(v, q): d for v, q, d in rows(metrics.move_gains(s, part(spark, [0, 0, 0, 0, 1]), 2))}
    assert gains[4, 0] == -1
    assert [q for _, q in rows(metrics.compact_labels(part(spark, [5, 5, 2, 9, 2])))] == [0, 0, 1, 2, 1]


def test_graph(h):
    s = small(h)
    w = {(u, v): w for u, v, w in rows(graphs.hypergraph_to_graph(s, order="pin"))}
    assert w == pytest.approx({(0, 1): 3.125, (1, 2): 1.625, (2, 3): 1.625, (1, 3): 0.5, (0, 3): 1.125, (3, 4): 1.0})
    total = graphs.cycle_links(s, cycles=3, seed=5).agg({"w": "sum"}).first()[0]
    assert total == pytest.approx(4 * 3 / (2 * 4 / 3))


def test_path_and_tree_profiles(spark, h, scratch):
    s = small(h)
    order = spark.createDataFrame([(v, v) for v in range(5)], "v long, rank long")
    prof = cuts.path_profile(s, order, scratch)
    assert rows(prof.select("rank", "cut", "below")) == [(0, 0, 0), (1, 5, 1), (2, 4, 3), (3, 4, 4), (4, 1, 5)]
    assert rows(cuts.best_path_cut(prof, 8, 5)) == [(4, 1)]
    tree = spark.createDataFrame([(v, v - 1 if v else None) for v in range(5)], "v long, parent long")
    assert rows(cuts.tree_profile(s, tree, scratch))[1:] == [(1, 5, 7), (2, 4, 5), (3, 4, 4), (4, 1, 3)]


def test_overlay_and_contraction(spark, h, scratch):
    s = small(h)
    parts = [part(spark, [0, 0, 1, 1, 1]), part(spark, [0, 0, 0, 0, 1])]
    cl = overlay.clusters(s, parts, scratch)
    assert [c for _, c in rows(cl)] == [0, 0, 1, 2, 3]
    coarse = overlay.contract(s, cl)
    assert rows(coarse.vertices.select("v", "vwt")) == [(0, 3), (1, 1), (2, 1), (3, 3)]
    assert rows(overlay.contracted_sets(s, cl)) == [("0,1,2", 4), ("2,3", 1)]
    for p in parts:
        there = overlay.onto_clusters(cl, p)
        assert metrics.cut_size(coarse, there).first()["cutsize"] == metrics.cut_size(s, p).first()["cutsize"]
        assert rows(overlay.uncontract(cl, there)) == rows(p)


def test_spectral_invariants(spark, h, scratch):
    ones = h.vertices.selectExpr("v", "1.0D AS x0", "CAST(v AS DOUBLE) AS x1")
    a = spectral.hypergraph_apply(h, ones)
    assert all(abs(r["x0"]) < 1e-12 for r in a.collect())
    joined = a.withColumnRenamed("x1", "y").join(ones.select("v", "x1"), "v")
    assert joined.selectExpr("sum(y * x1)").first()[0] > 0 and abs(joined.selectExpr("sum(y)").first()[0]) < 1e-9
    assert all(abs(r["x0"]) < 1e-9 for r in spectral.clique_apply(h, ones).collect())
    sides = spark.createDataFrame([(0, 0), (1, 1), (2, 1)], "v long, side tinyint")
    assert all(abs(r["x0"]) < 1e-9 for r in spectral.biclique_apply(sides, ones).collect())
    x = spectral.solve(small(h), graphs.hypergraph_to_graph(small(h), order="pin"), 1, 8, scratch)
    y = spectral.hypergraph_apply(small(h), x.selectExpr("v", "x[0] AS x0")).withColumnRenamed("x0", "ax")
    z = spectral.clique_apply(small(h), x.selectExpr("v", "x[0] AS x0")).withColumnRenamed("x0", "bx")
    got = np.array([(r["ax"], r["bx"]) for r in y.join(z, "v").collect()])
    lam = (got[:, 0] @ got[:, 1]) / (got[:, 1] @ got[:, 1])
    assert np.linalg.norm(got[:, 0] - lam * got[:, 1]) < 1e-3 * np.linalg.norm(got[:, 0]) + 1e-6


def test_config_and_validation(h):
    with pytest.raises(ValueError):
        PartitionConfig(num_parts=1)
    with pytest.raises(ValueError):
        validate(h.with_(vertices=h.vertices.selectExpr("v", "vwt", "4 AS fixed")), 2)


def test_forest_equals_kruskal(spark, scratch):
    from pinweave.operators import kernel, trees

    rng = np.random.default_rng(1)
    pairs = sorted({(int(min(a, b)), int(max(a, b))) for a, b in rng.integers(0, 30, size=(90, 2)) if a != b})
    w = rng.integers(1, 9, size=len(pairs)).astype(float)
    g = spark.createDataFrame([(a, b, float(x)) for (a, b), x in zip(pairs, w, strict=True)], "u long, v long, w double")
    got = {(r["u"], r["v"]) for r in trees.minimum_spanning_forest(g, scratch).collect()}
    sets, want = kernel.Sets(30), set()
    for i in sorted(range(len(pairs)), key=lambda i: (w[i], pairs[i])):
        if sets.join(*pairs[i]):
            want.add(pairs[i])
    assert got == want
    x = spark.createDataFrame([(v, [float(v)]) for v in range(33)], "v long, x array<double>")
    assert trees.spanning_tree(g, x, scratch).count() == 32
    left = trees.pieces_without(g, x, g.limit(0), scratch)
    assert left.select("root").distinct().count() == 33 - len(want)


def test_forced_profile_equals_kernel(spark, scratch):
    from pinweave.operators import kernel

    rng = np.random.default_rng(9)
    n, m = 9, 14
    pe, pv = np.repeat(np.arange(m), 3), rng.integers(0, n, size=3 * m)
    hwt = rng.integers(1, 5, size=m)
    verts = spark.createDataFrame([(v, 1, -1) for v in range(n)], "v long, vwt int, fixed int")
    hh = incidence.drop_single_pin_edges(Hypergraph(verts, spark.createDataFrame([(e, int(x)) for e, x in enumerate(hwt)], "e long, hwt int"), spark.createDataFrame([(int(a), int(b)) for a, b in zip(pe, pv, strict=True)], "e long, v long").distinct()))
    parent = [None] + [int(rng.integers(0, i)) for i in range(1, n)]
    tree = spark.createDataFrame(list(enumerate(parent)), "v long, parent long")
    sides = spark.createDataFrame([(0, 0), (n - 1, 1)], "v long, side tinyint")
    free = incidence.forced_edges(hh, sides)
    sums = {k: hh.hyperedges.join(free.where(f"forced = '{k}'"), "e").agg({"hwt": "sum"}).first()[0] or 0 for k in ("0", "1", "01")}
    loose = hh.with_(pins=hh.pins.join(free.where("forced = 'free'"), "e", "left_semi"))
    prof = cuts.tree_profile(loose, tree, scratch).join(cuts.forced_profile(hh, tree, sides, scratch), "v").selectExpr("*", f"{sums['0']} AS f0", f"{sums['1']} AS f1", f"{sums['01']} AS f01")
    got = {r["v"]: (r["exc0"], r["exc1"]) for r in cuts.tree_cut_costs(prof).collect()}
    h = kernel.build(n, np.ones(n), np.full(n, -1), hwt, pe, pv)
    side = np.full(n, -1)
    side[0], side[n - 1] = 0, 1
    p = kernel.profile(h, kernel.Rooted(n, np.arange(1, n), np.array(parent[1:])), h.vwt, side)
    assert all(got[v] == (p.exc0[v], p.exc1[v]) for v in range(1, n))


def test_multigrid(spark, scratch):
    from pinweave.operators import multigrid

    rng = np.random.default_rng(2)
    n = 400
    u, v = np.arange(n - 1), np.arange(1, n)
    cycle = multigrid.Cycle(n, u, v, rng.random(n - 1) + 0.5)
    assert cycle.levels and cycle(rng.random((n, 2))).shape == (n, 2)
    g = spark.createDataFrame([(0, 1, 5.0), (1, 2, 1.0), (2, 3, 5.0), (3, 4, 0.1)], "u long, v long, w double")
    grouped = multigrid.groups(g, scratch)
    assert rows(grouped) == [(0, 0), (1, 0), (2, 2), (3, 2), (4, 2)]
    assert rows(multigrid.coarsen(g, grouped)) == [(0, 2, 1.0)]


def test_harness(spark, tmp_path):
    from pinweave.plans.harness import run_cases, same_partition, summary

    (tmp_path / "t.hgr").write_text(TEXT)
    (tmp_path / "cases.tsv").write_text(f"name\thypergraph\tnum_parts\tseed\timb\nok\t{tmp_path}/t.hgr\t2\t1\t10\nbad\t{tmp_path}/none\t2\t1\t5\n")
    runs = run_cases(spark, str(tmp_path / "cases.tsv"))
    assert {r["name"]: r["status"] for r in runs.collect()} == {"ok": "ok", "bad": "failed"}
    assert summary(runs).count() == 2
    assert tuple(same_partition(part(spark, [0, 0, 1]), part(spark, [1, 1, 0])).first()) == (True, False, True)


def test_command_line(spark, tmp_path, capsys):
    from pinweave.__main__ import main

    (tmp_path / "t.hgr").write_text(TEXT)
    (tmp_path / "t.fix").write_text(FIXED)
    assert main([str(tmp_path / "t.hgr"), "--fixed-file", str(tmp_path / "t.fix"), "--imb", "10", "--output", str(tmp_path / "o")]) == 0
    labels = (tmp_path / "o").read_text().split()
    assert len(labels) == 8 and labels[6] == "1" and "cutsize" in capsys.readouterr().out


def test_large_reader_equals_small_one(spark, h, scratch, tmp_path):
    for text in (TEXT, "2 3\n1 2\n\n", "2 3 1\n\n4 1 3\n\n7\n\n8\n"):
        (tmp_path / "x.hgr").write_text(text)
        small_one, large_one = files.read_hypergraph(spark, str(tmp_path / "x.hgr")), files.read_large_hypergraph(spark, str(tmp_path / "x.hgr"), scratch)
        for t in ("vertices", "hyperedges", "pins"):
            assert rows(getattr(small_one, t)) == rows(getattr(large_one, t))
    (tmp_path / "x.hgr").write_text("3 2\n1 2\n")
    with pytest.raises(ValueError, match="ends"):
        files.read_large_hypergraph(spark, str(tmp_path / "x.hgr"), scratch)
