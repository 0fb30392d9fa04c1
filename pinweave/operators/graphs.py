"""Weighted graphs of hypergraphs, their Laplacian, distances in an embedding, and spectral chains."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from pinweave.model import Hypergraph
from pinweave.operators.incidence import edge_sizes
from pinweave.operators.ordered import ordered
from pinweave.runtime import Scratch

RIDGE = 1e-6
COINCIDENT = 1e9
LEAST_LENGTH = 1e-6


def scale(size: Column) -> Column:
    """floor(s/2) * ceil(s/2) / (s - 1): 1 for sizes 2 and 3."""
    return F.floor(size / 2) * F.ceil(size / 2) / (size - 1)


def undirected(links: DataFrame) -> DataFrame:
    """Sum ``(u, v, w)`` over unordered pairs; loops, negative and non-finite weights are left out."""
    sound = (F.col("u") != F.col("v")) & (F.col("w") >= 0) & (F.col("w") < F.lit(float("inf")))
    return links.where(sound).groupBy(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).agg(F.sum("w").alias("w"))


def small_edge_links(h: Hypergraph) -> DataFrame:
    """Edges of 2 pins as one link of their weight, edges of 3 as a triangle of half of it; not yet summed."""
    sized = edge_sizes(h).where("size IN (2, 3)").join(h.hyperedges, "e")
    ends = h.pins.join(sized, "e").groupBy("e", "size", "hwt").agg(F.min("v").alias("a"), F.max("v").alias("c"), F.sum("v").alias("s"))
    mid = F.col("s") - F.col("a") - F.col("c")
    link = lambda u, v, w: F.struct(u.alias("u"), v.alias("v"), w.cast("double").alias("w"))
    a, c, w = F.col("a"), F.col("c"), F.col("hwt")
    links = F.when(F.col("size") == 2, F.array(link(a, c, w))).otherwise(F.array(link(a, mid, w / 2), link(mid, c, w / 2), link(a, c, w / 2)))
    return ends.select(F.explode(links).alias("l")).select("l.*")


def cycle_links(h: Hypergraph, cycles: int = 1, seed: int = 0, order: str = "hash") -> DataFrame:
    """Edges of 4 pins or more as Hamiltonian cycles, closed within the edge, each link w / (2 * cycles * scale)."""
    if order not in ("hash", "pin"):
        raise ValueError("order must be 'hash' or 'pin'")
    big = edge_sizes(h).where("size >= 4").join(h.hyperedges, "e")
    key = F.col("pos" if "pos" in h.pins.columns else "v") if order == "pin" else F.xxhash64(F.lit(seed), "cycle", "e", "v")
    rows = h.pins.join(big, "e").withColumn("cycle", F.explode(F.sequence(F.lit(1), F.lit(cycles)))).withColumn("_k", F.struct(key.alias("k"), F.col("v").alias("v")))
    w = F.col("hwt") / (F.lit(2 * cycles) * scale(F.col("size")))
    along = rows.select(F.col("v").alias("u"), F.lead("v").over(Window.partitionBy("e", "cycle").orderBy("_k")).alias("v"), w.alias("w")).where("v IS NOT NULL")
    closing = rows.groupBy("e", "cycle", "size", "hwt").agg(F.max_by("v", "_k").alias("u"), F.min_by("v", "_k").alias("v")).select("u", "v", w.alias("w"))
    return along.union(closing)


def hypergraph_to_graph(h: Hypergraph, cycles: int = 1, seed: int = 0, order: str = "hash") -> DataFrame:
    """``(u, v, w)`` with u < v: small edges expanded, large ones as cycles, equal pairs summed.

    Edges of 2 and 3 pins are cycles too, the first without the link back, so that all
    links come out of one pass over the pins in order of their edges.
    """
    if order not in ("hash", "pin"):
        raise ValueError("order must be 'hash' or 'pin'")
    rows = h.pins.join(h.hyperedges, "e").withColumn("cycle", F.explode(F.sequence(F.lit(1), F.lit(cycles))) if cycles > 1 else F.lit(1))
    key = F.col("pos" if "pos" in h.pins.columns else "v") if order == "pin" else F.xxhash64(F.lit(seed), "cycle", "e", "v")
    along = Window.partitionBy("e", "cycle").orderBy(key, "v") if cycles > 1 else Window.partitionBy("e").orderBy(key, "v")
    whole = along.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    rows = rows.select("cycle", "hwt", F.col("v").alias("u"), F.lead("v").over(along).alias("_next"), F.first("v").over(whole).alias("_first"), F.count(F.lit(1)).over(whole).alias("size"))
    size, hwt = F.col("size"), F.col("hwt").cast("double")
    w = F.when(size == 2, hwt).when(size == 3, hwt / 2).otherwise(F.col("hwt") / (F.lit(2 * cycles) * scale(size)))
    kept = (size >= 4) | ((F.col("cycle") == 1) & ((size == 3) | F.col("_next").isNotNull()))
    return undirected(rows.where(kept).select("u", F.coalesce("_next", "_first").alias("v"), w.alias("w")))


def both_ways(graph: DataFrame) -> DataFrame:
    return graph.select("u", "v", "w").union(graph.select(F.col("v").alias("u"), F.col("u").alias("v"), "w"))


def laplacian_rows(graph: DataFrame, weighted: bool = False) -> DataFrame:
    """``(u, diag, offsum)``: diagonal (count of neighbours, or weighted degree, plus a ridge) and sum of off-diagonal entries."""
    diag = F.sum("w") if weighted else F.count("*")
    return both_ways(graph).groupBy("u").agg((diag + F.lit(RIDGE)).alias("diag"), (-F.sum("w")).alias("offsum"))


def laplacian(graph: DataFrame, weighted: bool = False) -> DataFrame:
    """``(row, col, val)`` of the sparse Laplacian."""
    off = both_ways(graph).select(F.col("u").alias("row"), F.col("v").alias("col"), (-F.col("w")).alias("val"))
    return off.union(laplacian_rows(graph, weighted).select(F.col("u").alias("row"), F.col("u").alias("col"), F.col("diag").alias("val")))


def row_sums(matrix: DataFrame) -> DataFrame:
    """``(row, total, dominated)`` of a sparse matrix: dominated is set where a positive entry lies off the diagonal."""
    return matrix.groupBy("row").agg(F.sum("val").alias("total"), F.bool_or((F.col("row") != F.col("col")) & (F.col("val") > 0)).alias("dominated"))


def column_minima(matrix: DataFrame) -> DataFrame:
    """``(col, row, val)``: the least entry of each column, the lowest row on a tie."""
    least = matrix.groupBy("col").agg(F.min(F.struct("val", "row")).alias("m"))
    return least.select("col", "m.row", "m.val")


def distance(a: Column, b: Column, lst: bool) -> Column:
    """L1 distance of two coordinate arrays, or the sum of inverse squares (1e9 where they coincide)."""
    each = F.zip_with(a, b, lambda x, y: F.when(x == y, F.lit(COINCIDENT)).otherwise(1 / ((x - y) * (x - y))) if lst else F.abs(x - y))
    return F.when(F.size(a) == 0, F.lit(1.0)).otherwise(F.aggregate(each, F.lit(0.0), lambda s, d: s + d))


def reweight(graph: DataFrame, embedding: DataFrame, lst: bool = False) -> DataFrame:
    """The graph's links weighed by distance in ``embedding(v, x)``."""
    ends = graph.select("u", "v").join(embedding.select(F.col("v").alias("u"), F.col("x").alias("xu")), "u").join(embedding.select("v", F.col("x").alias("xv")), "v")
    return ends.select("u", "v", distance(F.col("xu"), F.col("xv"), lst).alias("w"))


def spectral_order(embedding: DataFrame, scratch: Scratch) -> DataFrame:
    """``(v, x0, rank)`` by the first coordinate, then vertex; by vertex alone where there are no coordinates."""
    rows = embedding.select("v", F.coalesce(F.try_element_at("x", F.lit(1)), F.lit(0.0)).alias("x0"))
    return ordered(rows, ["x0", "v"], scratch)


def path_tree(embedding: DataFrame, scratch: Scratch) -> DataFrame:
    """``(u, v, w)``: each vertex linked to the next in spectral order at their distance (1e-6 at least)."""
    rank = spectral_order(embedding, scratch)
    nxt = rank.select((F.col("rank") - 1).alias("rank"), F.col("v").alias("v2"), F.col("x0").alias("x2"))
    gap = F.abs(F.col("x2") - F.col("x0"))
    return rank.join(nxt, "rank").select(F.col("v").alias("u"), F.col("v2").alias("v"), F.when(gap == 0, F.lit(LEAST_LENGTH)).otherwise(gap).alias("w"))


def degrees_upto(graph: DataFrame, scratch: Scratch) -> DataFrame:
    """``(u, degree, upto)``: neighbours of each vertex and their running sum by vertex id."""
    deg = both_ways(graph).groupBy("u").agg(F.count("*").alias("degree"))
    return ordered(deg, ["u"], scratch, sums={"upto": "degree"}).select("u", "degree", "upto")


def heaviest_of_pair(links: DataFrame) -> DataFrame:
    """Repeated ``(i, j)`` collapsed to the heaviest."""
    return links.groupBy("i", "j").agg(F.max("w").alias("w"))


def column_order(graph: DataFrame, scratch: Scratch) -> DataFrame:
    """``(pos, i, j, w)``: the entries of the symmetric matrix numbered by column, then row, as in a compressed sparse layout."""
    entries = both_ways(graph).select(F.col("u").alias("i"), F.col("v").alias("j"), "w")
    return ordered(entries, ["j", "i"], scratch, rank="pos").select("pos", "i", "j", "w")
