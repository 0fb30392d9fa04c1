"""Cut size, balance, penalties, gains and the predicates on partitions."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pinweave.model import Hypergraph
from pinweave.operators.incidence import edge_sizes
from pinweave.runtime import MAX_BROADCAST_VERTICES, broadcast_if_small

WIDE = 16  # partitions whose labels stand side by side


def spans(h: Hypergraph, partition: DataFrame, *extra: str) -> DataFrame:
    """``(e, lo, hi)``: the least and greatest part on each edge (by the ``extra`` columns of the partition too)."""
    return h.pins.join(partition, "v").groupBy(*extra, "e").agg(F.min("part").alias("lo"), F.max("part").alias("hi"))


def cut_sizes(h: Hypergraph, candidates: DataFrame, names: list[int]) -> DataFrame:
    """``(cand, cutsize)`` of the partitions ``names`` in ``candidates(cand, v, part)``; null where no edge is cut.

    Labels of some partitions at a time stand side by side, so a pin passes once for all of
    them and an edge keeps two labels for each, where a row for each pin and partition
    would swell the pins.
    """
    out = h.vertices.sparkSession.createDataFrame([], "cand long, cutsize long")
    for at in range(0, len(names), WIDE):
        some = names[at : at + WIDE]
        labels = candidates.where(F.col("cand").isin(some)).groupBy("v").agg(*[F.max(F.when(F.col("cand") == c, F.col("part"))).alias(f"p{i}") for i, c in enumerate(some)])
        cut = h.pins.join(broadcast_if_small(labels, MAX_BROADCAST_VERTICES), "v").groupBy("e").agg(*[(F.min(f"p{i}") != F.max(f"p{i}")).alias(f"c{i}") for i in range(len(some))])
        sums = cut.join(h.hyperedges, "e").agg(*[F.sum(F.when(F.col(f"c{i}"), F.col("hwt"))).alias(f"s{i}") for i in range(len(some))])
        out = out.union(sums.select(F.explode(F.array(*[F.struct(F.lit(c).cast("long").alias("cand"), F.col(f"s{i}").alias("cutsize")) for i, c in enumerate(some)])).alias("x")).select("x.*"))
    return out


def cut_edges(h: Hypergraph, partition: DataFrame) -> DataFrame:
    """Edges whose pins span two parts or more."""
    return spans(h, partition).where("lo <> hi").select("e")


def cut_size(h: Hypergraph, partition: DataFrame) -> DataFrame:
    """One row: summed weight of cut edges, each once."""
    return cut_edges(h, partition).join(h.hyperedges, "e").agg(F.coalesce(F.sum("hwt"), F.lit(0)).alias("cutsize"), F.count("*").alias("edges"))


def part_weights(h: Hypergraph, partition: DataFrame, k: int) -> DataFrame:
    """``(part, weight)`` for parts 0 to k-1, empty ones too; labels outside are ignored."""
    spark = h.vertices.sparkSession
    own = h.vertices.join(partition, "v").groupBy("part").agg(F.sum("vwt").alias("weight"))
    return spark.range(k).select(F.col("id").cast("int").alias("part")).join(own, "part", "left").select("part", F.coalesce("weight", F.lit(0)).alias("weight"))


def evaluate(h: Hypergraph, partition: DataFrame, k: int) -> DataFrame:
    """One row: cutsize and the array of part weights."""
    weights = part_weights(h, partition, k).agg(F.transform(F.array_sort(F.collect_list(F.struct("part", "weight"))), lambda x: x["weight"]).alias("balance"))
    return cut_size(h, partition).select("cutsize").crossJoin(F.broadcast(weights))


def limits_of(total: int, k: int, imb: float) -> tuple[int, int]:
    """Least and greatest allowed part weight for a total: share 1/k give or take imb percent of the total."""
    import math

    most = math.ceil(total * (100.0 / k + imb) / 100.0)
    least = max(0, math.floor(total * (100.0 / k - imb) / 100.0))
    return least, max(most, least)


def balance_limits(h: Hypergraph, k: int, imb: float) -> DataFrame:
    """One row: min_cap, max_cap."""
    total = F.coalesce(F.sum("vwt"), F.lit(0)).cast("double")
    low = F.greatest(F.floor(total * F.lit(100.0 / k - imb) / 100.0), F.lit(0)).cast("long")
    high = F.ceil(total * F.lit(100.0 / k + imb) / 100.0).cast("long")
    return h.vertices.agg(low.alias("min_cap"), high.alias("_high")).select("min_cap", F.greatest("min_cap", "_high").alias("max_cap"))


def penalty_of(weight, low, high):
    """Squared violation of the limits by one weight."""
    under, over = F.greatest(low - weight, F.lit(0)), F.greatest(weight - high, F.lit(0))
    return under * under + over * over


def balance_penalty(h: Hypergraph, partition: DataFrame, k: int, imb: float) -> DataFrame:
    """One row: the summed squared violations, 0 if balanced."""
    rows = part_weights(h, partition, k).crossJoin(F.broadcast(balance_limits(h, k, imb)))
    return rows.agg(F.sum(penalty_of(F.col("weight"), F.col("min_cap"), F.col("max_cap"))).cast("long").alias("penalty"))


def total_vertex_weight(h: Hypergraph) -> DataFrame:
    return h.vertices.agg(F.coalesce(F.sum("vwt"), F.lit(0)).alias("total"))


def edge_weight_sum(h: Hypergraph, some: DataFrame) -> DataFrame:
    """Summed weight of the edges of ``some(e)``."""
    return h.hyperedges.join(some.select("e"), "e", "left_semi").agg(F.coalesce(F.sum("hwt"), F.lit(0)).alias("weight"))


def weighted_degrees(h: Hypergraph) -> DataFrame:
    """``(v, degree, wdeg)``: incident edges and their weight."""
    return h.pins.join(h.hyperedges, "e").groupBy("v").agg(F.count("*").alias("degree"), F.sum("hwt").alias("wdeg"))


def count_parts(partition: DataFrame) -> DataFrame:
    """One row: the greatest label plus one."""
    return partition.agg(F.coalesce(F.max("part") + 1, F.lit(0)).alias("parts"))


def checks(h: Hypergraph, partition: DataFrame, k: int) -> DataFrame:
    """One row of predicates: complete, all_parts (each of k labels occurs), fixed_ok and labels_ok."""
    joined = h.vertices.join(partition, "v", "left")
    broken = (F.col("fixed") >= 0) & ((F.col("fixed") >= k) | (F.coalesce("part", F.lit(-1)) != F.col("fixed")))
    inside = F.coalesce(F.col("part").between(0, k - 1), F.lit(False))
    return joined.agg(
        F.coalesce(F.min(F.coalesce("part", F.lit(-1))) >= 0, F.lit(True)).alias("complete"), (F.count_distinct(F.when(inside, F.col("part"))) == k).alias("all_parts"),
        F.coalesce(~F.bool_or(broken), F.lit(True)).alias("fixed_ok"), F.coalesce(F.bool_and(inside), F.lit(True)).alias("labels_ok"),
    )


def fixed_violations(h: Hypergraph, partition: DataFrame) -> DataFrame:
    """``(v, fixed, part)`` of fixed vertices that lie elsewhere."""
    return h.vertices.where("fixed >= 0").join(partition, "v", "left").where(~F.col("part").eqNullSafe(F.col("fixed"))).select("v", "fixed", "part")


def move_gains(h: Hypergraph, partition: DataFrame, k: int) -> DataFrame:
    """``(v, part, delta)``: change of the cut if v alone moved to another part.

    After the move an edge is uncut only if all its other pins are in the target, and
    before it was cut unless all are in v's own part, so the change follows from the
    counts of pins by edge and part.
    """
    placed = h.pins.join(partition, "v")
    counts = placed.groupBy("e", "part").agg(F.count("*").alias("n"))
    edges = edge_sizes(h).join(h.hyperedges, "e")
    own = placed.join(counts, ["e", "part"]).join(edges, "e")
    base = own.groupBy("v", "part").agg(F.sum(F.when((F.col("n") < F.col("size")) | (F.col("size") == 1), 0).otherwise(F.col("hwt"))).alias("kept"))
    lone = counts.join(edges, "e").where("n = size - 1").select("e", F.col("part").alias("q"), "hwt")
    won = placed.join(lone, "e").where("q <> part").groupBy("v", "q").agg(F.sum("hwt").alias("won"))
    target = F.explode(F.sequence(F.lit(0), F.lit(k - 1))).alias("q")
    out = base.select("v", "part", "kept", target).where("q <> part").join(won, ["v", "q"], "left")
    return out.select("v", F.col("q").alias("part"), (F.col("kept") - F.coalesce("won", F.lit(0))).cast("long").alias("delta"))


def evaluate_candidates(h: Hypergraph, candidates: DataFrame, k: int, imb: float) -> DataFrame:
    """``(cand, penalty, cutsize)`` of those of ``candidates(cand, v, part)`` that label every vertex with 0 to k - 1 and keep fixed ones in place."""
    joined = candidates.join(h.vertices, "v")
    wrong = ~F.coalesce(F.col("part").between(0, k - 1), F.lit(False)) | ((F.col("fixed") >= 0) & (F.col("fixed") != F.col("part")))
    whole = joined.groupBy("cand").agg(F.count("*").alias("n"), F.max(wrong).alias("wrong")).join(F.broadcast(h.vertices.agg(F.count("*").alias("all"))), F.col("n") == F.col("all")).where("NOT wrong").select("cand")
    sound = candidates.join(whole, "cand")
    cut = cut_sizes(h, sound, sorted(r["cand"] for r in whole.collect()))  # one number for each candidate
    parts = h.vertices.sparkSession.range(k).select(F.col("id").cast("int").alias("part"))
    held = sound.join(h.vertices, "v").groupBy("cand", "part").agg(F.sum("vwt").alias("weight"))
    every = whole.crossJoin(F.broadcast(parts)).join(held, ["cand", "part"], "left").crossJoin(F.broadcast(balance_limits(h, k, imb)))
    pen = every.groupBy("cand").agg(F.sum(penalty_of(F.coalesce("weight", F.lit(0)), F.col("min_cap"), F.col("max_cap"))).cast("long").alias("penalty"))
    return pen.join(cut, "cand", "left").select("cand", "penalty", F.coalesce("cutsize", F.lit(0)).alias("cutsize"))


def compact_labels(partition: DataFrame) -> DataFrame:
    """Labels renumbered from 0 in the order of each one's first vertex; the labels, not the vertices, are ranked."""
    first = partition.groupBy("part").agg(F.min("v").alias("first"))
    ranked = first.select("part", (F.row_number().over(Window.orderBy("first")) - 1).alias("new"))
    return partition.join(F.broadcast(ranked), "part").select("v", F.col("new").cast("int").alias("part"))


def argmin_candidate(metrics: DataFrame) -> DataFrame:
    """Of ``(cand, penalty, cutsize)`` the row least by penalty, then cutsize, then cand."""
    return metrics.agg(F.min(F.struct("penalty", "cutsize", "cand")).alias("m")).select("m.cand", "m.penalty", "m.cutsize")


def first_by_cutsize(metrics: DataFrame) -> DataFrame:
    """The first candidate of each cut size."""
    return metrics.groupBy("cutsize").agg(F.min("cand").alias("cand"))


def top_candidates(metrics: DataFrame, best: int) -> DataFrame:
    """After dropping repeated cut sizes, the ``best`` least (0 or less: all)."""
    rows = first_by_cutsize(metrics)
    return rows.orderBy(F.asc_nulls_last("cutsize"), "cand").limit(best) if best > 0 else rows


def heaviest_component(sizes: DataFrame) -> DataFrame:
    """Of ``(comp, n)`` the largest, the lowest id on a tie."""
    return sizes.agg(F.max_by("comp", F.struct("n", -F.col("comp"))).alias("comp"))


def lightest_part(weights: DataFrame) -> DataFrame:
    """Of ``(part, weight)`` the lightest, the lowest id on a tie."""
    return weights.agg(F.min(F.struct("weight", "part"))["part"].alias("part"))
