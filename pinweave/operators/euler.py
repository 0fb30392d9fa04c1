"""Rooted trees in tables: Euler tours ranked by pointer jumping, preorder intervals, ancestors and lowest common ancestors.

Nothing here walks a tree level by level or gathers a vertex's neighbours, so depth and
degree do not matter: a tour of 2n arcs is ranked in log n rounds of one join each.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from pinweave.operators.ordered import ordered
from pinweave.runtime import MAX_BROADCAST_VERTICES, Scratch


def _jumped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Steps ``(i, next, left)``, numbered from 0 without gaps, jumped to their ends: ``left`` counts what lies ahead."""
    rows = pa.Table.from_batches(held) if (held := list(batches)) else None
    if rows is not None and rows.num_rows:
        i, left = rows["i"].to_numpy(), rows["left"].to_numpy()
        at, ahead = np.full(len(i), -1), np.zeros(len(i) + 1, dtype=np.int64)  # the last stands for the end, at which -1 points
        at[i], ahead[i] = np.where(np.isnan(nxt := rows["next"].to_numpy().astype(float)), -1, nxt).astype(np.int64), left
        at = np.append(at, -1)
        while (at >= 0).any():
            ahead, at = ahead + ahead[at], at[at]
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(i))), pa.nulls(len(i), pa.int64()), pa.array(ahead[:-1])], names=["i", "next", "left"])


def _tour(links: DataFrame, root: int, scratch: Scratch) -> DataFrame:
    """``(a, b, pos)``: the arcs of a tree's tour from the root, numbered in order; an arc is followed by the next one around its head."""
    pair = links.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).where("u <> v").distinct()
    arcs = pair.select(F.col("u").alias("a"), F.col("v").alias("b")).union(pair.select(F.col("v").alias("a"), F.col("u").alias("b")))
    arcs = scratch.keep(ordered(arcs, ["b", "a"], scratch, rank="i"), "arcs")  # around each head b by tail
    turn = arcs.groupBy("b").agg(F.min("i").alias("first"), F.max("i").alias("last"))
    around = arcs.join(turn, "b").select("a", "b", "i", "last", F.when(F.col("i") == F.col("last"), F.col("first")).otherwise(F.col("i") + 1).alias("turned"))
    # the arc around b at place ``turned`` comes from some c; the tour goes on along b -> c
    to = arcs.select(F.col("i").alias("turned"), F.col("a").alias("c"))
    reverse = arcs.select(F.col("a").alias("tail"), F.col("b").alias("head"), F.col("i").alias("next"))
    stop = (F.col("b") == root) & (F.col("i") == F.col("last"))
    step = around.join(to, "turned").join(reverse, (F.col("b") == F.col("tail")) & (F.col("c") == F.col("head")))
    cur = step.select("i", F.when(~stop, F.col("next")).alias("next"), F.when(stop, F.lit(0)).otherwise(1).cast("long").alias("left"))

    def written(df: DataFrame) -> tuple[DataFrame, int, int]:
        seen = Observation()
        kept = scratch.keep(df.observe(seen, F.count("next").alias("open"), F.count(F.lit(1)).alias("n")), "steps")
        return kept, seen.get["open"], seen.get["n"]

    cur, more, total = written(cur)
    if more and scratch.small(cur):
        cur, more, _ = written(cur.mapInArrow(_jumped, cur.schema))
    while more:
        old = cur
        for _ in range(2):
            ahead = cur.select(F.col("i").alias("next"), F.col("next").alias("then"), F.col("left").alias("more"))
            cur = cur.join(ahead, "next", "left").select("i", F.col("then").alias("next"), (F.col("left") + F.coalesce("more", F.lit(0))).alias("left"))
        cur, more, _ = written(cur)
        scratch.drop(old)
    return arcs.join(cur, "i").select("a", "b", (F.lit(total - 1) - F.col("left")).alias("pos"))


def rooted(links: DataFrame, root: int, scratch: Scratch) -> DataFrame:
    """``(v, parent, tin, tout, depth)`` of the tree ``links(u, v)``: preorder position, end of the subtree's interval, depth.

    The root's parent is null. Neighbours are visited in cyclic order of their ids from
    the parent on. A single vertex without links gives one row.
    """
    tour = scratch.keep(_tour(links, root, scratch), "tour")
    both = tour.join(tour.select(F.col("a").alias("b"), F.col("b").alias("a"), F.col("pos").alias("again")), ["a", "b"])
    steps = both.select("a", "b", "pos", "again", F.when(F.col("pos") < F.col("again"), 1).otherwise(0).alias("down"), F.when(F.col("pos") < F.col("again"), 1).otherwise(-1).alias("rise"))
    placed = ordered(steps, ["pos"], scratch, rank="_r", sums={"tin": "down", "depth": "rise"}).where("down = 1")
    size = (F.col("again") - F.col("pos") + 1) / 2
    rows = placed.select(F.col("b").alias("v"), F.col("a").alias("parent"), "tin", (F.col("tin") + size).cast("long").alias("tout"), F.col("depth").cast("long").alias("depth"))
    top = rows.agg((F.count("*") + 1).alias("n")).select(F.lit(root).cast("long").alias("v"), F.lit(None).cast("long").alias("parent"), F.lit(0).cast("long").alias("tin"), F.col("n").cast("long").alias("tout"), F.lit(0).cast("long").alias("depth"))
    return scratch.keep(rows.select("v", "parent", F.col("tin").cast("long").alias("tin"), "tout", "depth").union(top), "rooted")


def rooted_forest(links: DataFrame, roots: DataFrame, scratch: Scratch) -> DataFrame:
    """Trees of a forest, each from its vertex in ``roots(v)``, rooted together below a vertex of id -1 that ids must leave free."""
    return rooted(links.select("u", "v").union(roots.select(F.lit(-1).cast("long").alias("u"), "v")), -1, scratch)


def placed(tree: DataFrame, scratch: Scratch) -> DataFrame:
    """A tree with preorder positions: as it is if it has them, else ``(v, parent)`` rooted at the vertex without another parent."""
    if "tin" in tree.columns:
        return tree
    links = tree.where("parent IS NOT NULL AND parent <> v").select(F.col("parent").alias("u"), "v")
    root = tree.where("parent IS NULL OR parent = v").agg(F.min("v")).first()[0]
    if root is None:
        raise ValueError("the tree has no root")
    return rooted(links, int(root), scratch)


def _minima(tree: DataFrame, n: int, scratch: Scratch) -> DataFrame:
    """``(i, lows)``: for each preorder position but the root's the least parents' positions over the 1, 2, 4, ... positions from it on, to n at least; four lengths for each write."""
    up = tree.select(F.col("v").alias("parent"), F.col("tin").cast("int").alias("low"))
    cur = scratch.keep(tree.where("parent IS NOT NULL").select(F.col("tin").alias("i"), "parent").join(up, "parent").select("i", F.array("low").alias("lows")), "minima", n)
    span = 1
    while span < n:
        steps = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(15).cast("long"))).alias("j")
        rows = cur.select("i", "lows", steps).select((F.col("i") - F.col("j") * span).alias("i"), "j", F.when(F.col("j") == 0, F.col("lows")).alias("lows"), F.element_at("lows", -1).alias("low")).where("i > 0")
        longer = [F.min(F.when(F.col("j") < m, F.col("low"))).alias(f"l{m}") for m in (2, 4, 8, 16)]
        nxt = rows.groupBy("i").agg(F.max("lows").alias("lows"), *longer).select("i", F.concat("lows", F.array("l2", "l4", "l8", "l16")).alias("lows"))
        cur, span = scratch.keep(nxt, "minima", n), span * 16
    return cur


def lca(pairs: DataFrame, tree: DataFrame, scratch: Scratch) -> DataFrame:
    """Add ``top``, the preorder position of the lowest common ancestor, to ``pairs(lo, hi)`` of preorder positions, lo <= hi.

    The least parent among the positions after lo up to hi is that of the ancestor.
    Minima over spans of powers of two are tabled, and a pair takes two of them. Of a tree
    within ``MAX_BROADCAST_VERTICES`` the table, a row for each position, is broadcast to the
    pairs, which pass by once; beyond that the pairs are written, spans are tabled as far
    as the widest pair needs, and both are shuffled.
    """
    n = tree.limit(MAX_BROADCAST_VERTICES + 1).count()
    if n <= MAX_BROADCAST_VERTICES:
        table = F.broadcast(_minima(tree, n, scratch))
        wide = F.col("hi") - F.col("lo")
        k = F.length(F.bin(wide)) - 1
        here = pairs.select("*", F.when(wide > 0, F.col("lo") + 1).alias("_li"), F.when(wide > 0, F.col("hi") + 1 - F.expr("shiftleft(1L, length(bin(hi - lo)) - 1)")).alias("_ri"))
        got = here.join(table.select(F.col("i").alias("_li"), F.col("lows").alias("_l")), "_li", "left").join(table.select(F.col("i").alias("_ri"), F.col("lows").alias("_r")), "_ri", "left")
        return got.select(*pairs.columns, F.when(wide == 0, F.col("lo")).otherwise(F.least(F.get("_l", k), F.get("_r", k))).cast("long").alias("top"))
    parent = tree.select("v", F.col("tin").alias("ptin"))
    spans = scratch.keep(tree.where("parent IS NOT NULL").select("tin", F.col("parent").alias("v")).join(parent, "v").select(F.lit(0).alias("k"), F.col("tin").alias("i"), F.col("ptin").alias("low")), "spans")
    pairs = scratch.keep(pairs, "pairs")
    widest = pairs.agg(F.max(F.col("hi") - F.col("lo"))).first()[0] or 0
    level, all_ = spans, spans
    for k in range(max(0, int(widest).bit_length() - 1)):
        ahead = level.select((F.col("i") - F.lit(1 << k)).alias("i"), F.col("low").alias("other"))
        level = scratch.keep(level.join(ahead, "i").select(F.lit(k + 1).alias("k"), "i", F.least("low", "other").alias("low")), "spans")
        all_ = all_.union(level)
    k = F.length(F.bin(F.col("hi") - F.col("lo"))) - 1  # its highest power of two
    asked = pairs.where("lo < hi").withColumn("k", k)
    left = all_.select("k", (F.col("i") - 1).alias("lo"), F.col("low").alias("_l"))
    right = all_.select("k", (F.col("i") + F.expr("shiftleft(1L, k)") - 1).alias("hi"), F.col("low").alias("_r"))
    got = asked.join(left, ["k", "lo"]).join(right, ["k", "hi"]).withColumn("top", F.least("_l", "_r"))
    return got.select(*pairs.columns, "top").union(pairs.where("lo = hi").select(*pairs.columns, F.col("lo").alias("top")))


def subtree_sums(tree: DataFrame, values: DataFrame, names: list[str], scratch: Scratch) -> DataFrame:
    """``(v, *names)``: sums of ``values(tin, *names)`` (rows of a position add up) over each vertex's subtree, by one running sum over the preorder."""
    at = values.groupBy("tin").agg(*[F.sum(c).alias(c) for c in names])
    rows = tree.select("v", "tin", "tout").join(at, "tin", "left").select("v", "tin", "tout", *[F.coalesce(c, F.lit(0)).alias(c) for c in names])
    run = scratch.keep(ordered(rows, ["tin"], scratch, rank="_r", sums={f"_u_{c}": c for c in names}), "running")
    end = run.select((F.col("tin") + 1).alias("tout"), *[F.col(f"_u_{c}").alias(f"_e_{c}") for c in names])
    return run.join(end, "tout").select("v", *[(F.col(f"_e_{c}") - F.col(f"_u_{c}") + F.col(c)).alias(c) for c in names])


def ancestors(tree: DataFrame, some: DataFrame) -> DataFrame:
    """``(v, a)``: which of the vertices ``some(a)`` lie on or above each vertex, by containment of intervals; some must be few."""
    picked = some.join(tree.select(F.col("v").alias("a"), F.col("tin").alias("t0"), F.col("tout").alias("t1")), "a")
    return tree.join(F.broadcast(picked), (F.col("tin") >= F.col("t0")) & (F.col("tin") < F.col("t1"))).select("v", "a")
