"""Tables of a hypergraph and the configuration of a partition run."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TASK_ROWS = 250_000  # pins of a task, on average


@dataclass(frozen=True)
class Hypergraph:
    """``vertices(v, vwt, fixed)``, ``hyperedges(e, hwt)`` and ``pins(e, v[, pos])``; fixed is -1 for free vertices, weights are longs."""

    vertices: DataFrame
    hyperedges: DataFrame
    pins: DataFrame

    def with_(self, **tables: DataFrame) -> Hypergraph:
        return replace(self, **tables)


@dataclass(frozen=True)
class PartitionConfig:
    """Options of a run; the defaults are fixed values of the file format's usual tools."""

    num_parts: int = 2
    imb: int = 2
    eigvecs: int = 2
    refine_iters: int = 2
    solver_iters: int = 40
    best_solns: int = 3
    ncycles: int = 1
    seed: int = 0
    projection: str = "lda"
    perm_order: str = "hash"
    tol: float = 1e-8
    settle: float = 1e-4  # on tables, the share of a column's image at which its residual counts as settled
    coarse_vertices: int = 2_000  # on tables, vertices left at which coarsening ends
    local_vertices: int = 200_000
    local_pins: int = 5_000_000
    coarse_solver: Callable | None = None  # (hypergraph arrays, k, least, most) -> labels or None

    def __post_init__(self):
        if self.num_parts < 2:
            raise ValueError("num_parts must be at least 2")
        if self.imb < 0 or self.eigvecs < 1 or self.ncycles < 1:
            raise ValueError("imb, eigvecs and ncycles must not be negative or zero")


def by_edge(pins: DataFrame) -> DataFrame:
    """Rows dealt by edge over as many tasks as keep each within ``TASK_ROWS`` on average, so that a task's memory does not grow with the table."""
    tasks = -(-pins.count() // TASK_ROWS)
    return pins.repartition(tasks, "e") if tasks > int(pins.sparkSession.conf.get("spark.sql.shuffle.partitions")) else pins.repartition("e")


def from_table(df: DataFrame, edge: str, vertex: str, hwt: DataFrame | None = None, vertices: DataFrame | None = None) -> Hypergraph:
    """Read any table with a group key and a member key as a hypergraph.

    Repeated pins count once and rows with a null key are left out. ``hwt(e, hwt)``
    weighs edges (1 where absent); ``vertices(v, vwt, fixed)`` may list more vertices
    than have pins. Without it every member weighs 1 and is free. Pins are dealt by edge,
    so that what is grouped, joined or ordered by edge needs no further exchange.
    """
    pins = by_edge(df.select(F.col(edge).cast("long").alias("e"), F.col(vertex).cast("long").alias("v")).where("e IS NOT NULL AND v IS NOT NULL")).distinct()
    edges = pins.select("e").distinct()
    edges = edges.join(hwt, "e", "left").select("e", F.coalesce("hwt", F.lit(1)).cast("long").alias("hwt")) if hwt is not None else edges.withColumn("hwt", F.lit(1).cast("long"))
    if vertices is None:
        vertices = pins.select("v").distinct().select("v", F.lit(1).cast("long").alias("vwt"), F.lit(-1).alias("fixed"))
    return Hypergraph(vertices, edges, pins)


def validate(h: Hypergraph, k: int) -> Hypergraph:
    """Reject fixed labels that no part can take."""
    bad = h.vertices.where((F.col("fixed") >= k) | (F.col("fixed") < -1)).limit(1).count()
    if bad:
        raise ValueError(f"a fixed label is not in 0..{k - 1}")
    return h


def modulo_partition(vertices: DataFrame, k: int) -> DataFrame:
    """The plain partition ``v mod k``."""
    return vertices.select("v", F.pmod("v", F.lit(k)).cast("int").alias("part"))


def weight(c: str | Column) -> Column:
    return (F.col(c) if isinstance(c, str) else c).cast("long")
