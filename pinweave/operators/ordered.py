"""Global ranks and prefix sums without gathering a table into one task."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pinweave.runtime import Scratch


def ordered(df: DataFrame, by: list, scratch: Scratch, rank: str = "rank", sums: dict[str, str] | None = None) -> DataFrame:
    """Add the 0-based position in the order ``by`` and inclusive running sums ``{new: column}`` (null counts as 0).

    Rows are range-partitioned and sorted; each task numbers and sums its own rows as
    they pass, and one row of totals for each partition carries the offsets. ``by``
    must end in a key that leaves no ties.
    """
    sums = sums or {}
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    kept = [c for c in df.columns if c != rank and c not in sums]
    whole = {new: not isinstance(df.schema[c].dataType, (T.DoubleType, T.FloatType)) for new, c in sums.items()}
    schema = T.StructType([*[df.schema[c] for c in kept], T.StructField("_p", T.IntegerType()), T.StructField("_i", T.LongType()), *[T.StructField(f"_u_{new}", T.LongType() if whole[new] else T.DoubleType()) for new in sums]])

    def run(batches):
        own, n, upto = TaskContext.get().partitionId(), 0, dict.fromkeys(sums, 0)
        for batch in batches:
            cols = [batch.column(c) for c in kept] + [pa.array(np.full(batch.num_rows, own, np.int32)), pa.array(np.arange(n, n + batch.num_rows))]
            for new, c in sums.items():
                run = np.cumsum(pc.fill_null(batch.column(c), 0).cast(pa.int64() if whole[new] else pa.float64()).to_numpy(zero_copy_only=False)) + upto[new]
                upto[new] = run[-1] if len(run) else upto[new]
                cols.append(pa.array(run))
            n += batch.num_rows
            yield pa.RecordBatch.from_arrays(cols, names=schema.names)

    if scratch.gather:  # written first: what is small is one range, and the bounds of ranges are taken without computing the rows twice
        df = scratch.keep(df, "unordered")
        if scratch.small(df):
            return df.sortWithinPartitions(*by).mapInArrow(run, schema).select(*kept, F.col("_i").alias(rank), *[F.col(f"_u_{new}").alias(new) for new in sums])
    local = scratch.keep(df.repartitionByRange(parts, *by).sortWithinPartitions(*by).mapInArrow(run, schema), "ordered")
    totals = local.groupBy("_p").agg(F.count("*"), *[F.max_by(f"_u_{new}", "_i") for new in sums]).collect()  # one row for each partition
    before, offsets = [0, *[0 if whole[new] else 0.0 for new in sums]], []
    for p, *own in sorted(tuple(r) for r in totals):
        offsets.append((p, *before))
        before = [a + b for a, b in zip(before, own, strict=True)]
    offsets = df.sparkSession.createDataFrame(offsets, ", ".join(["_p int", "_o long", *[f"_o_{new} {'long' if whole[new] else 'double'}" for new in sums]]))
    out = local.join(F.broadcast(offsets), "_p")
    return out.select(*kept, (F.col("_o") + F.col("_i")).alias(rank), *[(F.col(f"_o_{new}") + F.col(f"_u_{new}")).alias(new) for new in sums])


def dense_ids(df: DataFrame, key: str, scratch: Scratch, new: str = "new_id") -> DataFrame:
    """``(key, new)``: the distinct values of a column numbered from 0 in ascending order."""
    return ordered(df.select(key).distinct(), [key], scratch, rank=new)
