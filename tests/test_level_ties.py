"""Sums of links in another order must not decide ties or halves of the hierarchy."""

from pyspark.sql import functions as F

from pinweave.operators import multigrid
from pinweave.plans.advanced import _as_sql


def test_equal_sums_tie_at_every_level(spark, scratch):
    # groups {0, 1}, {2, 3}, {4, 5}: three links of 0.1, 0.2 and 0.3 to the second, one of 0.6 to the third
    rows = [(0, 1, 9.0), (2, 3, 9.0), (4, 5, 9.0), (0, 2, 0.1), (0, 3, 0.2), (1, 2, 0.3), (0, 4, 0.6)]
    levels = multigrid.hierarchy(spark.createDataFrame(rows, "u long, v long, w double"), scratch, bottom=1, loose=0.2, most=2, digits=6)
    assert sorted(map(tuple, levels[1].graph.collect())) == [(0, 2, 0.6), (0, 4, 0.6)]


def test_halves_fall_as_in_sql(spark):
    import duckdb

    values = [16.930555, 19.305555, 16.180555, 36.816945, 2.5, -16.930555, 0.0, 3.000005]
    got = [r[0] for r in spark.createDataFrame([(v,) for v in values], "w double").select(_as_sql("w", 5)).collect()]
    assert got == [duckdb.sql(f"SELECT round({v!r}::DOUBLE, 5)").fetchall()[0][0] for v in values]
    assert spark.range(1).select(F.round(F.lit(16.930555), 5)).first()[0] != got[0]
