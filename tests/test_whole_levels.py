"""The hierarchy holds every link of the graph, light ones too."""

from pinweave.model import Hypergraph
from pinweave.plans import advanced


def test_light_links_are_in_the_hierarchy(spark, scratch):
    edges = {0: ([0, 1], 5), 1: ([1, 2], 1), 2: ([2, 3], 4), 3: ([3, 4], 2)}
    h = Hypergraph(
        spark.createDataFrame([(v, 1, -1) for v in range(5)], "v long, vwt long, fixed int"),
        spark.createDataFrame([(e, w) for e, (_, w) in edges.items()], "e long, hwt long"),
        spark.createDataFrame([(e, v) for e, (pins, _) in edges.items() for v in pins], "e long, v long"),
    )
    rows = [tuple(r) for r in advanced.multigrid_hierarchy(h, scratch).collect()]
    assert sorted(r for r in rows if r[0] == 0) == [(0, 0, 1, 5.0), (0, 1, 2, 1.0), (0, 2, 3, 4.0), (0, 3, 4, 2.0)]
    assert [r for r in rows if r[0] == 1] == [(1, 0, 2, 1.0)]
