"""A gathering scratch ends the rounds of trees, components and tours within a task while the rows are few, with the results of the rounds on tables."""

import pytest
from pyspark.sql import functions as F

from pinweave.operators import components, euler, ordered, trees
from pinweave.runtime import Scratch


class Counting(Scratch):
    """Counts what is written."""

    writes = 0

    def keep(self, *args, **options):
        self.writes += 1
        return super().keep(*args, **options)


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def gathering(spark, name):
    out = Counting(spark, name, Scratch(spark, name).gathering().gather)
    assert out.gather > 0
    return out


def graph(spark, scratch, copies, weight, nodes=60):
    ends = [f"(abs(hash(id, {i})) % {nodes}) * {copies} + id % {copies} AS {c}" for i, c in ((1, "u"), (2, "v"))]
    links = spark.range(1200).selectExpr(*ends, f"{weight} AS w").where("u <> v").groupBy(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).agg(F.max("w").alias("w"))
    return scratch.keep(links.select(F.col("u").cast("long").alias("u"), F.col("v").cast("long").alias("v"), "w"))


@pytest.mark.parametrize("copies,weight", [(1, "pow(abs(hash(id)) % 1000 + 1, 3) / 1e5"), (3, "pow(2.0D, abs(hash(id)) % 9)")])
def test_forests_equal_the_rounds_on_tables(spark, scratch, copies, weight):
    few, links = gathering(spark, "few"), graph(spark, scratch, copies, weight)
    low = rows(trees.low_stretch_forest(links, few, copies=copies))
    assert low == rows(trees.low_stretch_forest(links, scratch, copies=copies)) and len(low) == 59 * copies
    assert few.writes <= 3  # the rounds on tables write two or more for every class of weights
    for largest in (False, True):
        assert rows(trees.minimum_spanning_forest(links, few, largest)) == rows(trees.minimum_spanning_forest(links, scratch, largest))
    assert few.writes <= 7


def test_pieces_and_tours_equal_the_rounds_on_tables(spark, scratch):
    few = gathering(spark, "few")
    links = spark.range(500).selectExpr("id * 7 % 301 AS a", "(id * 7 + 21) % 301 - id % 2 AS b").union(spark.createDataFrame([(900, 901), (901, 900), (5, 5), (None, 3)], "a long, b long"))
    assert rows(components.connected_components(links, few)) == rows(components.connected_components(links, scratch))
    assert few.writes <= 2 and components.connected_components(links.where("false"), few).count() == 0
    tree = spark.range(1, 700).selectExpr("id AS u", "abs(hash(id)) % id AS v")
    before = few.writes
    assert rows(euler.rooted(tree, 0, few)) == rows(euler.rooted(tree, 0, scratch))
    assert few.writes - before <= 7
    assert rows(euler.rooted(tree.where("false"), 5, few)) == [(5, None, 0, 1, 0)]
    assert rows(ordered.ordered(tree, ["v", "u"], few, sums={"upto": "u"})) == rows(ordered.ordered(tree, ["v", "u"], scratch, sums={"upto": "u"}))


def test_links_over_a_tasks_rows_are_cut_as_they_come(spark, scratch, monkeypatch):
    links = graph(spark, scratch, 1, "abs(hash(id)) % 50 * 1.0D").selectExpr("u", "v", "w", "w AS c").toArrow()
    whole = components.forest_of(*[links[c].to_numpy() for c in ("u", "v", "c")])[0]
    monkeypatch.setattr(components, "FILE_ROWS", 80)
    got = [b.to_pylist() for b in components.own_forests(iter(links.to_batches(max_chunksize=50)))]
    key = lambda r: (r["u"], r["v"])
    assert sorted((r for b in got for r in b), key=key) == sorted(links.take(whole).to_pylist(), key=key)
