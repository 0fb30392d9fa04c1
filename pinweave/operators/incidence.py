"""Filters, projections, semi-joins and set algebra on pins."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pinweave.model import Hypergraph
from pinweave.operators.ordered import dense_ids
from pinweave.runtime import Scratch


def side_by_side(h: Hypergraph, copies: int) -> Hypergraph:
    """The hypergraph ``copies`` times over; vertex and edge i of copy c is ``i * copies + c``."""
    each = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(copies - 1).cast("long"))).alias("_c")
    at = lambda c: (F.col(c) * copies + F.col("_c")).alias(c)
    return Hypergraph(
        h.vertices.select("v", "vwt", "fixed", each).select(at("v"), "vwt", "fixed"), h.hyperedges.select("e", "hwt", each).select(at("e"), "hwt"), h.pins.select("e", "v", each).select(at("e"), at("v"))
    )


def edge_sizes(h: Hypergraph) -> DataFrame:
    """``(e, size)`` of edges with pins."""
    return h.pins.groupBy("e").agg(F.count("*").alias("size"))


def max_edge_size(h: Hypergraph) -> DataFrame:
    """One row: the largest size, 1 at least."""
    return edge_sizes(h).agg(F.greatest(F.coalesce(F.max("size"), F.lit(1)), F.lit(1)).alias("max_size"))


def by_vertex(h: Hypergraph) -> DataFrame:
    """The inverted index: pins laid out by vertex, for jobs that follow several times from vertices to edges."""
    return h.pins.repartition("v")


def drop_single_pin_edges(h: Hypergraph) -> Hypergraph:
    """Keep edges with two pins or more."""
    keep = edge_sizes(h).where("size > 1").select("e")
    return h.with_(hyperedges=h.hyperedges.join(keep, "e", "left_semi"), pins=h.pins.join(keep, "e", "left_semi"))


def renumber_edges(h: Hypergraph, scratch: Scratch) -> DataFrame:
    """``(e, new_id)``: edges with pins, densely from 0 in their original order."""
    return dense_ids(h.pins, "e", scratch)


def restrict(h: Hypergraph, keep: DataFrame) -> Hypergraph:
    """The part of a hypergraph on the vertices of ``keep(v)``: other pins go, and with them edges that lose all."""
    pins = h.pins.join(keep.select("v"), "v", "left_semi")
    return Hypergraph(h.vertices.join(keep.select("v"), "v", "left_semi"), h.hyperedges.join(pins.select("e").distinct(), "e", "left_semi"), pins)


def mobile_pins(h: Hypergraph, sides: DataFrame) -> DataFrame:
    """Pins whose vertex is on no fixed side."""
    return h.pins.join(sides.select("v"), "v", "left_anti")


def sides_of(partition: DataFrame) -> DataFrame:
    """``(v, side)`` from labels 0 and 1; others are left out."""
    return partition.where(F.col("part").isin(0, 1)).select("v", F.col("part").cast("tinyint").alias("side"))


def one_vs_rest(partition: DataFrame, focus: int) -> DataFrame:
    return partition.select("v", F.when(F.col("part") == focus, 0).otherwise(1).cast("tinyint").alias("side"))


def sides_from_fixed(h: Hypergraph) -> DataFrame:
    return h.vertices.where(F.col("fixed").isin(0, 1)).select("v", F.col("fixed").cast("tinyint").alias("side"))


def vertices_by_part(partition: DataFrame) -> DataFrame:
    """Vertices laid out by part, ascending within one; a part is never gathered into an array."""
    return partition.repartitionByRange("part", "v").sortWithinPartitions("part", "v")


def incident_edges(h: Hypergraph, some: DataFrame) -> DataFrame:
    """Distinct edges that touch a vertex of ``some(v)``."""
    return h.pins.join(some.select("v"), "v", "left_semi").select("e").distinct()


def incident_vertices(h: Hypergraph, some: DataFrame) -> DataFrame:
    """Distinct vertices on an edge of ``some(e)``."""
    return h.pins.join(some.select("e"), "e", "left_semi").select("v").distinct()


def forced_edges(h: Hypergraph, sides: DataFrame) -> DataFrame:
    """``(e, forced)``: 'free', '0', '1' or '01' by the fixed sides that an edge touches."""
    touched = h.pins.join(sides, "v", "left").groupBy("e").agg(F.max(F.col("side") == 0).alias("t0"), F.max(F.col("side") == 1).alias("t1"))
    t0, t1 = F.coalesce("t0", F.lit(False)), F.coalesce("t1", F.lit(False))
    return touched.select("e", F.when(t0 & t1, "01").when(t0, "0").when(t1, "1").otherwise("free").alias("forced"))


def ordered_distinct(df: DataFrame, value: str, pos: str) -> DataFrame:
    """Distinct values with the position where each comes first."""
    return df.groupBy(value).agg(F.min(pos).alias(pos))


def ordered_intersection(left: DataFrame, right: DataFrame, value: str) -> DataFrame:
    """Rows of ``left``, repeats and order kept, whose value is in ``right``."""
    return left.join(right.select(value).distinct(), value, "left_semi")


def ordered_difference(left: DataFrame, right: DataFrame, value: str) -> DataFrame:
    """Rows of ``left``, repeats and order kept, whose value is not in ``right``."""
    return left.join(right.select(value).distinct(), value, "left_anti")


def union_distinct(*tables: DataFrame) -> DataFrame:
    out = tables[0]
    for t in tables[1:]:
        out = out.union(t)
    return out.distinct()


def column_subsets(d: int, most: int | None = None) -> list[tuple[int, ...]]:
    """Non-empty subsets of d columns by size, then lexicographically; ``most`` limits the columns that take part."""
    d = min(d, most) if most else d
    return [c for n in range(1, d + 1) for c in combinations(range(d), n)]


def concat_embeddings(blocks: list[DataFrame], n: int) -> DataFrame | None:
    """Join embeddings ``(v, x)`` side by side; blocks that do not have n rows are left out, None if none is left."""
    out = None
    for b in blocks:
        if b.count() != n:
            continue
        out = b if out is None else out.join(b.withColumnRenamed("x", "_x"), "v").select("v", F.concat("x", "_x").alias("x"))
    return out
