"""Registered queries against their SQL at the smallest size, and the streaming spans."""

import duckdb
import pandas as pd
import pytest
from pyspark.sql import functions as F

from pinweave.plans import advanced, extra, registry  # noqa: F401  advanced registers with extra

QUERIES, ORACLE_SQL = registry.QUERIES | extra.QUERIES, registry.ORACLE_SQL | extra.ORACLE_SQL

DIR = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DIR}/{t}.parquet'")
    return con


def plain(df: pd.DataFrame) -> list:
    df = df[sorted(df.columns)]
    return sorted(repr([None if x is None or x is pd.NA or x != x else x.item() if hasattr(x, "item") else x for x in r]) for r in df.itertuples(index=False, name=None))


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_equals_sql(spark, duck, name):
    assert plain(QUERIES[name](spark, DIR).toPandas()) == plain(duck.sql(ORACLE_SQL[name]).df())


def test_flagship_is_balanced_and_better_than_modulo(spark, scratch):
    from pinweave.model import modulo_partition
    from pinweave.operators import metrics

    h = registry.suppliers_of_orders(spark, DIR)
    part = scratch.keep(registry.flagship(spark, DIR))
    assert part.count() == h.vertices.count()
    assert metrics.balance_penalty(h, part, 2, 2).first()["penalty"] == 0
    assert metrics.cut_size(h, part).first()["cutsize"] <= metrics.cut_size(h, modulo_partition(h.vertices, 2)).first()["cutsize"]


def stream(spark, tmp_path, files, schema="e long, v long, ts timestamp_ntz"):
    """A stream of one micro-batch for each of the given lists of rows."""
    for i, rows in enumerate(files):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        if i == 0:
            yield spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
        else:
            yield None


def test_streaming_spans(spark, tmp_path):
    from pinweave.streaming.cutstream import windowed_balance, windowed_spans

    events = spark.read.parquet(f"{DIR}/events.parquet").selectExpr("user_id AS e", "event_id AS v", "ts")
    assert dict(events.dtypes)["ts"] == "timestamp_ntz"
    events.repartition(2).write.parquet(str(tmp_path / "in"))
    pins = spark.readStream.schema(events.schema).parquet(str(tmp_path / "in"))
    part = events.selectExpr("v", "CAST(v % 2 AS INT) AS part")
    joined = events.join(part, "v")
    for name, f, by in (("spans", windowed_spans, "e"), ("balance", windowed_balance, "part")):
        q = f(pins, part, length="1 day", late="400 days").writeStream.outputMode("complete").format("memory").queryName(name).start()
        q.processAllAvailable()
        q.stop()
        want = joined.groupBy(F.window("ts", "1 day"), by).count()
        assert sorted((r[by], r["n"]) for r in spark.table(name).collect()) == sorted((r[by], r["count"]) for r in want.collect())


def test_streaming_leaves_late_rows_out(spark, tmp_path):
    import datetime as dt

    from pinweave.streaming.cutstream import windowed_spans

    at = lambda m: dt.datetime(2024, 1, 1, 0, m)
    part = spark.createDataFrame([(0, 0), (1, 1)], "v long, part int")
    files = stream(spark, tmp_path, [[(7, 0, at(1))], [(7, 1, at(2)), (8, 1, at(50))], [(7, 1, at(3)), (8, 0, at(51))]])
    q = windowed_spans(next(files), part, length="5 minutes", late="10 minutes").writeStream.outputMode("update").format("memory").queryName("late").start()
    q.processAllAvailable()
    for _ in files:
        q.processAllAvailable()
    q.stop()
    got = [(r["e"], r["lo"], r["hi"], r["n"]) for r in spark.table("late").collect()]
    assert sorted(got) == [(7, 0, 0, 1), (7, 0, 1, 2), (8, 0, 1, 2), (8, 1, 1, 1)]  # the last row of edge 7 came after the watermark


def test_every_engine_query_has_sql():
    assert set(QUERIES) == set(ORACLE_SQL)
