"""Cuts of several candidates in one pass over the pins."""

import re

from pyspark.sql import functions as F

from pinweave import model
from pinweave.operators import metrics


def _small(spark, rows):
    return model.from_table(spark.createDataFrame(rows, "e long, v long"), "e", "v")


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


ROWS = [(e, (e * 7 + i * i) % 23) for e in range(60) for i in range(1 + e % 6)]


def test_candidates_do_not_swell_the_pins(spark, monkeypatch):
    monkeypatch.setattr(metrics, "WIDE", 3)
    h = _small(spark, ROWS)
    cand = h.vertices.select(F.explode(F.sequence(F.lit(1), F.lit(8))).alias("cand"), "v").select("cand", "v", F.pmod("v", F.col("cand")).cast("int").alias("part"))
    got = metrics.cut_sizes(h, cand, list(range(1, 9)))
    assert not re.search(r"(keys=\[[^\]]*cand[^\]]*, e#|keys=\[e#\d+L, cand)", _plan(got))
    want = {c: sum(len({v % c for e, v in set(ROWS) if e == x}) > 1 for x in range(60)) or None for c in range(1, 9)}
    assert {r["cand"]: r["cutsize"] for r in got.collect()} == want
    found = metrics.evaluate_candidates(h, cand, 8, 10)
    assert {r["cand"]: r["cutsize"] for r in found.collect()} == {c: w or 0 for c, w in want.items()}
    plan = _plan(found)
    assert not re.search(r"keys=\[cand#\d+\w*, e#", plan)
