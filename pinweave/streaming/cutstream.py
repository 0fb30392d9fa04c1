"""Cut size kept up to date over a stream of pins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _placed(pins: DataFrame, partition: DataFrame, time: str, late: str) -> DataFrame:
    """Pins with their parts under a watermark; a time without zone counts in the session's."""
    return pins.withColumn(time, F.col(time).cast("timestamp")).join(partition, "v").withWatermark(time, late)


def windowed_spans(pins: DataFrame, partition: DataFrame, time: str = "ts", length: str = "5 minutes", late: str = "10 minutes") -> DataFrame:
    """``(window, e, lo, hi, n)`` by event time: the parts that each edge spans within a window, rows later than ``late`` left out.

    Only the least and greatest part of an edge are kept as state, not its pins.
    """
    return _placed(pins, partition, time, late).groupBy(F.window(time, length), "e").agg(F.min("part").alias("lo"), F.max("part").alias("hi"), F.count("*").alias("n"))


def windowed_balance(pins: DataFrame, partition: DataFrame, time: str = "ts", length: str = "5 minutes", late: str = "10 minutes") -> DataFrame:
    """``(window, part, n)``: how many pins fall on each part in a window."""
    return _placed(pins, partition, time, late).groupBy(F.window(time, length), "part").agg(F.count("*").alias("n"))
