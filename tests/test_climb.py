"""Cut costs of a tree in one pass over the pins."""

import random

import pytest
from pyspark.sql import functions as F

from pinweave.model import from_table
from pinweave.operators import cuts, euler, incidence


@pytest.mark.parametrize("most", [500_000, 0])
def test_lca_of_all_pairs(spark, scratch, monkeypatch, most):
    monkeypatch.setattr(euler, "MAX_BROADCAST_VERTICES", most)
    rng = random.Random(4)
    up = {v: rng.randrange(max(0, v - 6), v) for v in range(1, 40)}
    tree = euler.rooted(spark.createDataFrame([*up.items()], "u long, v long"), 0, scratch)
    at = {r["v"]: r["tin"] for r in tree.collect()}
    above = lambda v: [v, *above(up[v])] if v else [0]
    want = {tuple(sorted((at[a], at[b]))): at[next(x for x in above(a) if x in above(b))] for a in range(40) for b in range(40)}
    got = euler.lca(spark.createDataFrame([*want], "lo long, hi long"), tree, scratch)
    assert {(r["lo"], r["hi"]): r["top"] for r in got.collect()} == want


def test_pins_are_not_written(spark, scratch):
    rows = [(e, (e * 5 + i * 3) % 15) for e in range(30) for i in range(1 + e % 5)]
    rows = [(e, v) for e, v in rows if any(x > 1 for f, x in rows if f == e)]  # edges of fixed vertices alone count as cut
    h = from_table(spark.createDataFrame(rows, "e long, v long"), "e", "v")
    h = h.with_(vertices=spark.range(15).select(F.col("id").alias("v"), F.lit(1).cast("long").alias("vwt"), F.when(F.col("id") < 2, F.col("id").cast("int")).otherwise(-1).alias("fixed")))
    tree = euler.rooted(h.vertices.where("v > 0").select("v", F.floor((F.col("v") - 1) / 2).cast("long").alias("u")), 0, scratch)
    labels = []
    keep = scratch.keep
    scratch.keep = lambda df, label="t", *a, **b: (labels.append(label), keep(df, label, *a, **b))[1]
    got = {r["v"]: (r["weight"], r["exc0"], r["exc1"]) for r in cuts.cut_profile(h, tree, incidence.sides_from_fixed(h), scratch).collect()}
    assert not {"pins", "pairs", "forced"} & set(labels) and labels.count("ordered") == 1
    below = {v: {d for d in range(15) if v in _up(d)} for v in range(15)}
    edges = [{v for e, v in rows if e == x} for x in range(30)]
    for v, inside in below.items():
        want = []
        for side in (0, 1):  # the subtree's free vertices on the side, all others on the other one
            ones = {x for x in inside if x > 1} | {side}
            want.append(sum(bool(e & ones) and bool(e - ones) for e in edges))
        assert got[v] == (len(inside), *want)


def _up(v):
    return [v, *_up((v - 1) // 2)] if v else [0]
