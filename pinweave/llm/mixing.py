"""Mixing sources to target weights by whole repetitions plus one hash-seeded Bernoulli copy."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pinweave.runtime import Scratch, broadcast_if_small

WORD = r"[^\x20\x09-\x0D]+"
DRAWS_PER_DIGEST = 4
SPAN = float(1 << 32)


def word_count(text: Column) -> Column:
    """Number of ``[^\\x20\\x09-\\x0D]+`` in a text; null counts as empty."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_key(source: Column) -> Column:
    """A never-null key that sorts as source does, null last."""
    return F.when(source.isNull(), F.lit("1")).otherwise(F.concat(F.lit("0"), source))


def _draws(n: int, *ids: Column) -> list[Column]:
    """n uniform draws in [0, 1) from the digest of a row's identity."""
    out = []
    for k in range(math.ceil(n / DRAWS_PER_DIGEST)):
        digest = F.md5(F.concat_ws("|", F.lit(str(k)), *[F.coalesce(c.cast("string"), F.lit("")) for c in ids]))
        out += [F.conv(F.substring(digest, 1 + 8 * j, 8), 16, 10).cast("double") / SPAN for j in range(DRAWS_PER_DIGEST)]
    return out[:n]


def plan_targets(sizes: DataFrame, scratch: Scratch, weights: tuple[float, ...], ceiling: float) -> DataFrame:
    """One row per source: ``skey, source_size, target``.

    Sources in code-point order (null last) take the weights in turn; targets share
    the total size, stop at ``ceiling`` times their source's size, and the excess is
    shared again by weight until none is above. Only scalars reach the driver.
    """
    spark = sizes.sparkSession
    totals = scratch.keep(sizes.groupBy("skey").agg(F.sum("size").alias("source_size")), "totals")
    schema = T.StructType([*totals.schema.fields, T.StructField("pos", T.LongType())])
    ranked = spark.createDataFrame(totals.orderBy("skey").rdd.zipWithIndex().map(lambda x: (*x[0], x[1])), schema)
    cycle = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("pos") % len(weights) + 1).cast("int"))
    ranked = scratch.keep(ranked.withColumn("weight", cycle).withColumn("most", F.col("source_size") * F.lit(float(ceiling))), "ranked")
    scratch.drop(totals)
    total = float(ranked.agg(F.sum("source_size")).first()[0] or 0)
    level, full = 0.0, -1
    while True:
        capped = F.col("weight") * F.lit(level) >= F.col("most")
        r = ranked.agg(F.coalesce(F.sum(F.when(capped, F.col("most"))), F.lit(0.0)), F.sum(F.when(~capped, F.col("weight"))), F.count_if(capped)).first()
        if r[1] is None or r[2] == full:
            break
        full, level = r[2], (total - r[0]) / r[1]
    return ranked.select("skey", "source_size", F.least(F.col("weight") * F.lit(level), F.col("most")).alias("target"))


def mix(docs: DataFrame, scratch: Scratch, weights: tuple[float, ...] = (5, 2, 1), ceiling: float = 3.0, seeds: int = 32, carry: tuple[str, ...] = ()) -> DataFrame:
    """Decide how many copies of each document a mix takes.

    Tokens are added up per source, a source's repetition rate is target over size,
    and a document is taken ``floor(rate)`` times plus once more when its hashed draw
    falls below the fraction. A draw depends on doc_id and text only, so reruns
    agree. Of ``seeds`` seeds each source uses the one whose total comes nearest its
    target (ties: the lowest), which is settled by one aggregate over all documents.

    docs: doc_id, text, source and more. Returns doc_id, size, source_size, target,
    rate, copies, taken, and the columns in ``carry``, one row per input row. Null
    or empty texts have size 0; a source whose texts are all empty has target 0 and
    rate 0; rows repeated in full get equal decisions; an empty table gives no rows.
    """
    narrow = ["doc_id", source_key(F.col("source")).alias("skey"), word_count(F.col("text")).alias("size"), F.md5(F.coalesce("text", F.lit("")).cast("binary")).alias("own")]
    sizes = scratch.keep(docs.select(*narrow), "sizes")
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    plan = plan_targets(sizes, scratch, weights, ceiling).withColumn("rate", rate).withColumn("whole", F.floor("rate")).withColumn("part", F.col("rate") - F.col("whole"))
    plan = scratch.keep(plan, "plan")
    draws = _draws(seeds, F.col("doc_id"), F.col("own"))
    joined = sizes.join(broadcast_if_small(plan.select("skey", "part"), 100_000), "skey")
    hit = joined.groupBy("skey").agg(*[F.sum(F.when(d < F.col("part"), F.col("size")).otherwise(0)).alias(f"s{i}") for i, d in enumerate(draws)])
    want = F.col("target") - F.col("whole") * F.col("source_size")
    best = reduce(F.least, [F.struct(F.abs(F.col(f"s{i}") - want).alias("d"), F.lit(i).alias("i")) for i in range(seeds)]) if seeds > 1 else F.struct(F.lit(0.0).alias("d"), F.lit(0).alias("i"))
    final = scratch.keep(plan.join(hit, "skey").select("skey", "source_size", "target", "rate", "whole", "part", best["i"].alias("seed")), "final")
    scratch.drop(plan)
    out = (docs.select(*narrow, *carry) if carry else sizes).join(broadcast_if_small(final, 100_000), "skey")
    digest = F.md5(F.concat_ws("|", F.floor(F.col("seed") / DRAWS_PER_DIGEST).cast("string"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.col("own")))
    draw = F.conv(F.substr(digest, (F.col("seed") % DRAWS_PER_DIGEST * 8 + 1).cast("int"), F.lit(8)), 16, 10).cast("double") / SPAN
    out = out.withColumn("copies", F.col("whole") + (draw < F.col("part")).cast("long"))
    return out.select("doc_id", "size", "source_size", "target", "rate", "copies", (F.col("copies") * F.col("size")).alias("taken"), *carry)


def emit(docs: DataFrame, scratch: Scratch, **params) -> DataFrame:
    """The mixed corpus itself: every document repeated as often as ``mix`` decides, in the columns of ``docs``."""
    cols = docs.columns
    row = F.struct(*[F.col(c) for c in cols]).alias("_row")
    taken = mix(docs.select("doc_id", "text", "source", row), scratch, carry=("_row",), **params)
    return taken.where("copies > 0").select(F.explode(F.array_repeat("_row", F.col("copies").cast("int"))).alias("_row")).select("_row.*")
