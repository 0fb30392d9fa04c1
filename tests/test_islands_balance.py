"""Islands of fixed vertices must not unbalance a partition; the arrays of a hypergraph come over Arrow."""

import numpy as np

from pinweave.model import Hypergraph, PartitionConfig
from pinweave.operators import metrics
from pinweave.plans import engine


def copies(spark, n, each):
    """n paths of ``each`` vertices that no edge joins, each with a vertex fixed to either side and a heavier one to side 1."""
    ids = [(c * each + i, 5 if i == 1 else 1, {0: 0, 1: 1}.get(i, -1)) for c in range(n) for i in range(each)]
    pins = [(c * each + i, c * each + i + d) for c in range(n) for i in range(each - 1) for d in (0, 1)]
    edges = sorted({e for e, _ in pins})
    return Hypergraph(spark.createDataFrame(ids, "v long, vwt long, fixed int"), spark.createDataFrame([(e, 1) for e in edges], "e long, hwt long"), spark.createDataFrame(pins, "e long, v long"))


def test_islands_fixed_alike_leave_the_partition_balanced(spark, scratch):
    h = copies(spark, 6, 40)
    for k in (2, 3):
        part = scratch.keep(engine.partition(h, PartitionConfig(num_parts=k, refine_iters=1, solver_iters=8), scratch))
        row = metrics.checks(h, part, k).first()
        assert row["complete"] and row["fixed_ok"] and row["labels_ok"] and part.count() == 240
        assert metrics.balance_penalty(h, part, k, 2).first()["penalty"] == 0


def test_fetch_takes_no_rows(spark, monkeypatch):
    h = copies(spark, 2, 5)
    monkeypatch.setattr(type(h.pins), "toPandas", lambda self: 1 / 0)
    monkeypatch.setattr(type(h.pins), "collect", lambda self: 1 / 0)
    got = engine.fetch(h)
    assert got.names.tolist() == list(range(10)) and got.local.vwt.tolist() == [1, 5, 1, 1, 1] * 2
    assert np.column_stack([got.local.pe, got.local.pv]).tolist() == [[e, e // 4 * 5 + e % 4 + d] for e in range(8) for d in (0, 1)]
