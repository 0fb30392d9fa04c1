"""Summaries of repeated runs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def numeric_stats(df: DataFrame, by: list[str], value: str) -> DataFrame:
    """Count, least, greatest, range, mean, population variance and deviation of a column, by group."""
    v = F.col(value)
    return df.groupBy(*by).agg(F.count(v).alias("n"), F.min(v).alias("least"), F.max(v).alias("greatest"), (F.max(v) - F.min(v)).alias("spread"), F.avg(v).alias("mean"), F.var_pop(v).alias("variance"), F.stddev_pop(v).alias("deviation"))


def tool_summary(runs: DataFrame) -> DataFrame:
    """Of runs ``(tool, status, cutsize, balance_ok)``: counts by outcome, distinct cuts, best and worst cut by tool."""
    ok = F.col("status") == "ok"
    return runs.groupBy("tool").agg(F.count("*").alias("runs"), F.count_if(ok).alias("ok"), F.count_if(~ok).alias("failed"), F.count_distinct(F.when(ok, F.col("cutsize"))).alias("distinct_cuts"), F.min(F.when(ok, F.col("cutsize"))).alias("best"), F.max(F.when(ok, F.col("cutsize"))).alias("worst"))
