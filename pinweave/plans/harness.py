"""Runs case tables and reports cut, balance and time, with repeats summed up."""

from __future__ import annotations

import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pinweave.functions.stats import numeric_stats
from pinweave.model import PartitionConfig
from pinweave.operators import metrics
from pinweave.plans.engine import partition
from pinweave.runtime import Scratch
from pinweave.sources import files

SCHEMA = "name string, repeat int, seed int, status string, runtime_seconds double, cutsize long, balance array<long>, note string"
NUMBERS = ("imb", "eigvecs", "refine_iters", "solver_iters", "best_solns", "ncycles")


def run_cases(spark: SparkSession, path: str, repeats: int = 1) -> DataFrame:
    """One row for each case and repeat; a failing case is reported, not raised. Repeats raise the seed by one each."""
    out = []
    for case in [r.asDict() for r in files.read_cases(spark, path).collect()]:
        for repeat in range(repeats):
            seed, began = int(case["seed"]) + repeat, time.perf_counter()
            try:
                extra = {k: int(case[k]) for k in NUMBERS if case.get(k)}
                cfg = PartitionConfig(num_parts=int(case["num_parts"]), seed=seed, projection=case.get("projection_strategy") or "lda", **extra)
                scratch = Scratch(spark, "case")
                h = files.read_hypergraph(spark, case["hypergraph"], case.get("fixed_file"))
                hint = files.read_labels(spark, case["hint_file"]) if case.get("hint_file") else None
                row = metrics.evaluate(h, scratch.keep(partition(h, cfg, scratch, hint), "found"), cfg.num_parts).first()
                out.append((case["name"], repeat, seed, "ok", time.perf_counter() - began, row["cutsize"], list(row["balance"]), ""))
            except Exception as error:  # noqa: BLE001  a case that cannot run is a result of the harness
                out.append((case["name"], repeat, seed, "failed", time.perf_counter() - began, None, None, str(error)[:200]))
    return spark.createDataFrame(out, SCHEMA)


def summary(runs: DataFrame) -> DataFrame:
    """By case: runs and failures, and statistics of cut and time over those that ended well."""
    ok = runs.where("status = 'ok'")
    cut = numeric_stats(ok, ["name"], "cutsize").select("name", F.col("least").alias("best_cut"), F.col("mean").alias("mean_cut"), F.col("greatest").alias("worst_cut"), F.col("deviation").alias("cut_stdev"), F.col("variance").alias("cut_variance"))
    took = numeric_stats(ok, ["name"], "runtime_seconds").select("name", F.col("mean").alias("mean_seconds"), F.col("deviation").alias("seconds_stdev"))
    return runs.groupBy("name").agg(F.count("*").alias("runs"), F.count_if(F.col("status") != "ok").alias("failed")).join(cut, "name", "left").join(took, "name", "left")


def same_partition(a: DataFrame, b: DataFrame) -> DataFrame:
    """One row comparing two partitions: length_match, exact, and normalized (equal up to the names of labels)."""
    both = a.select("v", F.col("part").alias("pa")).join(b.select("v", F.col("part").alias("pb")), "v", "full")
    rows = both.agg(F.bool_and(F.col("pa").isNotNull() & F.col("pb").isNotNull()).alias("length_match"), F.coalesce(F.bool_and(F.col("pa") == F.col("pb")), F.lit(True)).alias("exact"), F.count_distinct("pa", "pb").alias("pairs"), F.count_distinct("pa").alias("na"), F.count_distinct("pb").alias("nb"))
    return rows.select("length_match", "exact", (F.col("length_match") & (F.col("pairs") == F.col("na")) & (F.col("pairs") == F.col("nb"))).alias("normalized"))
