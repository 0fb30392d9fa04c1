"""Pins dealt by edge: one pass for graphs."""

import re

from pinweave import model
from pinweave.operators import graphs


def _small(spark, rows):
    return model.from_table(spark.createDataFrame(rows, "e long, v long"), "e", "v")


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


ROWS = [(e, (e * 7 + i * i) % 23) for e in range(60) for i in range(1 + e % 6)]


def test_tasks_grow_with_the_pins(spark, monkeypatch):
    monkeypatch.setattr(model, "TASK_ROWS", 10)
    h = _small(spark, ROWS + ROWS)
    assert h.pins.count() == len(set(ROWS)) and h.pins.rdd.getNumPartitions() == -(-2 * len(ROWS) // 10)


def test_graph_sorts_the_pins_once(spark):
    h = _small(spark, ROWS)
    graph = graphs.hypergraph_to_graph(h, order="pin")
    plan = _plan(graph)
    assert len(re.findall(r"\bWindow \[", plan)) == 1 and "Union" not in plan
    want = graphs.undirected(graphs.small_edge_links(h).union(graphs.cycle_links(h, order="pin")))
    key = lambda df: {(r["u"], r["v"]): round(r["w"], 9) for r in df.collect()}
    assert key(graph) == key(want)
    for cycles, order in ((1, "hash"), (3, "hash"), (2, "pin")):
        want = graphs.undirected(graphs.small_edge_links(h).union(graphs.cycle_links(h, cycles, 5, order)))
        assert key(graphs.hypergraph_to_graph(h, cycles, 5, order)) == key(want)
