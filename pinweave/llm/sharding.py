"""Sharding by best-fit-decreasing packing of indivisible groups through a balanced tree."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pinweave.runtime import Scratch

CLASS_BITS = 12  # group sizes keep so many leading bits; a class stands for its largest size
SALTS = 64
OVERHEAD = 16


class AvlTree:
    """Ordered set of (room, bin) keys with insertion, deletion and least-key-not-below search in O(log n)."""

    __slots__ = ("root",)

    def __init__(self):
        self.root = None

    @staticmethod
    def _node(key, left, right):
        return (key, left, right, 1 + max(left[3] if left else 0, right[3] if right else 0))

    def _join(self, key, left, right):
        lean = (left[3] if left else 0) - (right[3] if right else 0)
        if lean > 1:
            if (left[1][3] if left[1] else 0) < (left[2][3] if left[2] else 0):
                mid = left[2]
                return self._node(mid[0], self._node(left[0], left[1], mid[1]), self._node(key, mid[2], right))
            return self._node(left[0], left[1], self._node(key, left[2], right))
        if lean < -1:
            if (right[2][3] if right[2] else 0) < (right[1][3] if right[1] else 0):
                mid = right[1]
                return self._node(mid[0], self._node(key, left, mid[1]), self._node(right[0], mid[2], right[2]))
            return self._node(right[0], self._node(key, left, right[1]), right[2])
        return self._node(key, left, right)

    def _add(self, node, key):
        if node is None:
            return self._node(key, None, None)
        if key < node[0]:
            return self._join(node[0], self._add(node[1], key), node[2])
        return self._join(node[0], node[1], self._add(node[2], key))

    def _cut_least(self, node):
        if node[1] is None:
            return node[0], node[2]
        key, left = self._cut_least(node[1])
        return key, self._join(node[0], left, node[2])

    def _remove(self, node, key):
        if key < node[0]:
            return self._join(node[0], self._remove(node[1], key), node[2])
        if key > node[0]:
            return self._join(node[0], node[1], self._remove(node[2], key))
        if node[2] is None:
            return node[1]
        nxt, right = self._cut_least(node[2])
        return self._join(nxt, node[1], right)

    def add(self, key) -> None:
        self.root = self._add(self.root, key)

    def remove(self, key) -> None:
        self.root = self._remove(self.root, key)

    def at_least(self, key):
        """The least key that is not below ``key``, or None."""
        node, best = self.root, None
        while node is not None:
            if node[0] >= key:
                best, node = node[0], node[1]
            else:
                node = node[2]
        return best


def pack(items: list[tuple[int, int]], capacity: int, bins: int | None = None) -> list[tuple[int, int, int, int]] | None:
    """Best-fit-decreasing over ``(size, count)`` items, largest first.

    Returns runs ``(item index, first rank, count, bin)``. A run places equal sizes at
    once: the tightest bin that takes one of them stays the tightest until it no
    longer fits, so this equals placing them singly. A new bin opens only when none
    fits; None is returned when more than ``bins`` would be needed. Items over the
    capacity get a bin of their own.
    """
    tree, runs, opened = AvlTree(), [], 0
    for at, (size, count) in enumerate(items):
        done = 0
        while done < count:
            key = tree.at_least((size, -1))
            if key is None:
                if bins is not None and opened >= bins:
                    return None
                room, home = max(capacity, size), opened
                opened += 1
            else:
                tree.remove(key)
                room, home = key
            n = min(count - done, room // size) if size else count - done
            runs.append((at, done, n, home))
            tree.add((room - n * size, home))
            done += n
    return runs


def tightest(items: list[tuple[int, int]], bins: int) -> tuple[int, list]:
    """The least capacity, to one part in 4,096, at which ``pack`` needs at most ``bins`` bins."""
    total = sum(s * n for s, n in items)
    low = max(-(-total // bins), 1)
    step = max(1, low >> 12)
    high = low
    while (runs := pack(items, high, bins)) is None:
        low, high = high + 1, high + step
        step *= 2
    while high - low >= max(1, low >> 12):
        mid = (low + high) // 2
        if (found := pack(items, mid, bins)) is None:
            low = mid + 1
        else:
            high, runs = mid, found
    return high, runs


def size_class(size: Column) -> Column:
    """Largest size with the same ``CLASS_BITS`` leading bits, rounded up; sizes below 2**CLASS_BITS are their own class."""
    drop = F.greatest(F.length(F.bin(size)) - CLASS_BITS, F.lit(0))
    unit = F.pow(F.lit(2.0), drop).cast("long")
    return (F.ceil(size / unit) * unit).cast("long")


def _ranked(df: DataFrame, cell: list[str], order: list[str], rank: str) -> DataFrame:
    """Gapless rank from 0 within the key ``cell[0]``, dealt over the salts ``cell[1]`` so that no key meets in one task."""
    key, salt = cell
    counts = df.groupBy(key, salt).agg(F.count("*").alias("_n"))
    before = Window.partitionBy(key).orderBy(salt).rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(key, salt, F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    inner = df.withColumn("_r", F.row_number().over(Window.partitionBy(key, salt).orderBy(*order)))
    return inner.join(offsets, [key, salt]).withColumn(rank, F.col("_before") + F.col("_r") - 1).drop("_before", "_r")


def shard(docs: DataFrame, scratch: Scratch, shards: int | None = 40, capacity: int | None = None) -> DataFrame:
    """Deal documents into fixed-capacity shards; equal texts stay together.

    Groups of equal texts (by 64-bit hash, CRC-32 and length) are sorted by size and
    each enters the open shard with the tightest room that still takes it, found in a
    balanced tree. With ``capacity`` the number of shards is what packing needs; with
    ``shards`` the capacity is the least at which packing needs no more, so sizes come
    out near equal. A group larger than total/shards (or the capacity) cannot be kept
    whole under that law: it is cut, in doc_id-hash order, into pieces of just under
    that size, and the pieces are packed like groups.

    The driver sees a histogram of size classes (at most 2**CLASS_BITS per doubling of
    size) and one row per cut group, of which there are fewer than shards. Classes
    round sizes up by at most 2**-CLASS_BITS.

    Returns doc_id, size (UTF-8 bytes plus 16; null text: 16), text_crc32, law, shard,
    slot (gapless from 0 in each shard), grown_shard (null: the law is ``bytes``).
    Null texts equal each other but not the empty text; null doc_ids and repeated
    rows each take a slot; an empty table gives no rows.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(
        "doc_id", (F.octet_length(text) + OVERHEAD).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"),
        F.when(F.col("text").isNull(), F.lit(0)).otherwise(F.xxhash64("text")).alias("h"), F.col("text").isNull().alias("none"),
    )
    rows = scratch.keep(rows, "rows")
    key = ["h", "text_crc32", "size", "none"]
    groups = scratch.keep(rows.groupBy(*key).agg(F.count("*").alias("n")), "groups")
    total = groups.agg(F.sum(F.col("n") * F.col("size"))).first()[0] or 0
    limit = capacity or max(-(-total // shards), 1)
    bytes_ = F.col("n") * F.col("size")
    over = F.col("n") * F.col("size") > F.lit(limit)
    cut = [tuple(r) for r in groups.where(over & (F.col("n") > 1)).select(*key, "n").collect()]
    whole = groups.where(~(over & (F.col("n") > 1))).withColumn("cls", size_class(bytes_))
    hist = [tuple(r) for r in whole.groupBy("cls").count().collect()]
    items, owner = [], []  # owner: a class, or (cut group, first rank of the piece, rows in it)
    for cls, n in hist:
        items.append((cls, n))
        owner.append(cls)
    for g, (*_, size, _, n) in enumerate(cut):
        per = max(1, limit // size)
        for first in range(0, n, per):
            items.append((size * min(per, n - first), 1))
            owner.append((g, first, min(per, n - first)))
    order = sorted(range(len(items)), key=lambda i: (-items[i][0], str(owner[i])))
    items, owner = [items[i] for i in order], [owner[i] for i in order]
    if capacity:
        runs = pack(items, capacity)
    else:
        runs = tightest(items, shards)[1] if items else []
    class_runs = sorted((owner[at], first, home) for at, first, _, home in runs if not isinstance(owner[at], tuple))
    piece_runs = sorted((owner[at][0], owner[at][1], home) for at, _, _, home in runs if isinstance(owner[at], tuple))

    def lookup(table):
        spark = docs.sparkSession
        table = spark.sparkContext.broadcast(tuple(np.array([r[i] for r in table], dtype=np.int64) for i in range(3)))

        @F.pandas_udf("int")
        def of(kind: pd.Series, rank: pd.Series) -> pd.Series:
            kinds, firsts, homes = table.value
            names = np.unique(kinds)
            wide = np.int64(1) << np.int64(40)
            starts = np.searchsorted(names, kinds) * wide + firsts
            at = np.searchsorted(starts, np.searchsorted(names, kind.to_numpy()) * wide + rank.to_numpy(), side="right") - 1
            return pd.Series(homes[at].astype(np.int32))

        return of

    placed = _ranked(whole.withColumn("_salt", F.pmod(F.hash("h"), F.lit(SALTS))), ["cls", "_salt"], ["h", "text_crc32", "size", "none"], "rank")
    placed = placed.select(*key, lookup(class_runs)("cls", "rank").alias("shard")) if class_runs else None
    out = rows.join(placed, key) if placed is not None else rows.withColumn("shard", F.lit(None).cast("int")).where("false")
    out = out.select("doc_id", "size", "text_crc32", "shard")
    if cut:
        names = docs.sparkSession.createDataFrame([(*c[:4], g) for g, c in enumerate(cut)], "h long, text_crc32 long, size long, none boolean, g long")
        parts = rows.join(F.broadcast(names), key).withColumn("_salt", F.pmod(F.hash("doc_id"), F.lit(SALTS)))
        parts = _ranked(parts, ["g", "_salt"], ["doc_id"], "rank")
        out = out.union(parts.select("doc_id", "size", "text_crc32", lookup(piece_runs)("g", "rank").alias("shard")))
    out = out.withColumn("_salt", F.pmod(F.hash("doc_id", F.lit(1)), F.lit(SALTS)))
    out = _ranked(out, ["shard", "_salt"], ["doc_id", "size", "text_crc32"], "slot")
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", F.col("slot").cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
