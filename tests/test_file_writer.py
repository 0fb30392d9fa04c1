"""Positional files are written by a task: no row of them comes to the driver."""

import pytest
from pyspark.sql import functions as F

from pinweave.sources import files


def test_lines_are_written_in_order_without_the_driver(spark, tmp_path, monkeypatch):
    rows = spark.range(5000).repartition(7).select(F.col("id").alias("v"), F.concat(F.lit("line "), F.col("id").cast("string")).alias("line"))
    more = spark.range(300).repartition(3).select(F.col("id").alias("v"), F.concat(F.lit("more "), F.col("id").cast("string")).alias("line"))
    monkeypatch.setattr(type(rows), "toLocalIterator", lambda self, *a, **k: 1 / 0)
    path = tmp_path / "sub" / "h.hgr"
    for _ in range(2):  # an older file is replaced
        files._write_lines(rows, str(path), ["head", "second"], "v", more=more)
    want = ["head", "second", *[f"line {i}" for i in range(5000)], *[f"more {i}" for i in range(300)]]
    assert path.read_text() == "\n".join(want) + "\n"
    assert [p.name for p in path.parent.iterdir() if not p.name.startswith(".")] == ["h.hgr"]


def test_lines_out_of_order_are_refused():
    import pyarrow as pa

    batch = lambda *rows: pa.RecordBatch.from_pylist([{"_k": k, "_o": o, "line": ""} for k, o in rows])
    assert sum(b.num_rows for b in files._in_order([batch((0, 0), (1, 0)), batch((1, 1), (2, 0))])) == 4
    for bad in ([batch((1, 1), (1, 0))], [batch((1, 1)), batch((0, 2))]):
        with pytest.raises(ValueError):
            list(files._in_order(bad))
