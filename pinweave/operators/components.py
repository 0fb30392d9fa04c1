"""Connected components of a link table by alternating star contraction."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from pinweave.runtime import FILE_ROWS, MAX_BROADCAST_VERTICES, Scratch


def forest_of(u: np.ndarray, v: np.ndarray, cost: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Which of some links are in their least spanning forest by cost, then ends, by the rounds of ``trees.minimum_spanning_forest`` on arrays; and the nodes with the least node of each one's piece."""
    order = np.lexsort((np.maximum(u, v), np.minimum(u, v), cost))
    names, ends = np.unique(np.concatenate([u[order], v[order]]), return_inverse=True)
    piece, left = np.arange(len(names)), np.arange(len(order))
    a, b = ends[: len(order)], ends[len(order) :]
    taken = []
    while len(left):
        pa_, pb = piece[a[left]], piece[b[left]]
        apart = pa_ != pb
        left, pa_, pb = left[apart], pa_[apart], pb[apart]
        best = np.full(len(names), len(order))
        np.minimum.at(best, pa_, left)
        np.minimum.at(best, pb, left)
        own = np.flatnonzero(best < len(order))
        taken.append(np.unique(best[own]))
        up = np.arange(len(names))
        up[own] = piece[a[best[own]]] + piece[b[best[own]]] - own
        low = own[(up[up[own]] == own) & (own < up[own])]  # of two that choose each other the lesser stays
        up[low] = low
        while (up[up] != up).any():
            up = up[up]
        piece = up[piece]
    least = names.copy()
    np.minimum.at(least, piece, names)
    return order[np.concatenate(taken)] if taken else order[:0], names, least[piece]


def own_forests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The least spanning forest of a task's own ``(u, v, w, c)``, at most ``FILE_ROWS`` rows besides the forest at a time: a link outside of it is in no forest of more links."""
    held: list[pa.RecordBatch] = []

    def cut() -> list[pa.RecordBatch]:
        rows = pa.Table.from_batches(held).combine_chunks()
        return rows.take(pa.array(forest_of(*[rows[c].to_numpy() for c in ("u", "v", "c")])[0])).combine_chunks().to_batches()

    n = 0
    for batch in batches:
        held.append(batch)
        n += batch.num_rows
        if n > FILE_ROWS:
            held, n = cut(), 0
    if held:
        yield from cut()


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``(node, component)`` of a task's links."""
    held = list(batches)
    if held:
        rows = pa.Table.from_batches(held)
        u, v = rows["u"].to_numpy(), rows["v"].to_numpy()
        _, node, component = forest_of(u, v, np.zeros(len(u)))
        yield pa.RecordBatch.from_arrays([pa.array(node), pa.array(component)], names=["node", "component"])


def _toward_min(pairs: DataFrame, keep) -> DataFrame:
    """For pairs (u, v) rewire the v selected by ``keep`` to the least node of u's neighbourhood."""
    low = pairs.groupBy("u").agg(F.least(F.first("u"), F.min("v")).alias("m"))
    return pairs.where(keep).join(low, "u").select(F.col("v"), F.col("m"))


def _round(links: DataFrame) -> DataFrame:
    both = links.select(F.col("a").alias("u"), F.col("b").alias("v")).union(links.select(F.col("b").alias("u"), F.col("a").alias("v")))
    large = _toward_min(both, F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
    down = large.where("u > v")
    low = down.groupBy("u").agg(F.min("v").alias("m"))
    small = down.join(low, "u").select(F.explode(F.array(F.struct(F.col("v").alias("x"), F.col("m").alias("y")), F.struct(F.col("u").alias("x"), F.col("m").alias("y")))).alias("p"))
    return small.select(F.col("p.y").alias("a"), F.col("p.x").alias("b")).where("a < b").distinct()


def connected_components(links: DataFrame, scratch: Scratch) -> DataFrame:
    """Return ``(node, component)`` for every node of ``links(a, b)``; component is the least node id.

    Each round replaces neighbourhoods by stars around their least node (a group-by
    and two joins, all on node ids) and writes the shrunken link table, so a round
    never holds a neighbourhood in memory and hubs are split by adaptive skew joins.
    Rounds end when a table equals the one before by count and checksum, which the
    write itself takes. Links that are null or join a node to itself are ignored;
    repeated links count once.

    With a gathering scratch each task first leaves out links that close a cycle within
    it, and if ``MAX_BROADCAST_VERTICES`` links or fewer are left, one task joins the rest.
    """
    if scratch.gather:
        seen = Observation()
        rows = links.where("a IS NOT NULL AND b IS NOT NULL AND a <> b").select(F.col("a").cast("long").alias("u"), F.col("b").cast("long").alias("v"), F.lit(0.0).alias("c"))
        own = scratch.keep(rows.mapInArrow(own_forests, rows.schema).observe(seen, F.count(F.lit(1)).alias("n")), "own")
        if seen.get["n"] <= MAX_BROADCAST_VERTICES:
            return scratch.keep(own.select("u", "v").coalesce(1).mapInArrow(_pieces, "node long, component long"), "pieces")
        links = own.select(F.col("u").alias("a"), F.col("v").alias("b"))

    def written(df: DataFrame, rows: int | None = None) -> tuple[DataFrame, tuple]:
        seen = Observation()
        kept = scratch.keep(df.observe(seen, F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("s")), "links", rows)
        return kept, (seen.get["n"], seen.get["s"])

    cur, mark = written(links.where("a IS NOT NULL AND b IS NOT NULL AND a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    while mark[0]:
        nxt, now = written(_round(cur), 2 * mark[0])
        scratch.drop(cur)
        cur = nxt
        if now == mark:
            break
        mark = now
    return cur.select(F.col("b").alias("node"), F.col("a").alias("component")).union(cur.select(F.col("a").alias("node"), F.col("a").alias("component")).distinct())
