"""Near-duplicate vectors by E8 lattice hashing, with every found pair verified by cosine."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, FloatType

from pinweave.llm.tiles import each_tile, spans_of, tile
from pinweave.operators.components import connected_components
from pinweave.runtime import Scratch

TABLES = 16
BLOCKS = 3  # lattice points of 8 dimensions that name a cell of a table together
NEAR = 3  # neighbours of a lattice point that are tried in a block
CELLS = 6  # cells a vector is filed under in a table: its own and the nearest others
SCALE = 0.85  # lattice unit for unit vectors
TILE_ROWS = 4096
BATCH_ROWS = 8192  # rows of tiles in one task
SEED = 20240229
BLOCK = 256


def decode_d8(x: np.ndarray) -> np.ndarray:
    """Nearest points of D8 (integer coordinates of even sum) by rounding, then re-rounding the worst coordinate."""
    near = np.rint(x)
    odd = np.flatnonzero(near.sum(axis=1) % 2 != 0)
    if len(odd):
        err = x[odd] - near[odd]
        worst = np.abs(err).argmax(axis=1)
        near[odd, worst] += np.where(err[np.arange(len(odd)), worst] >= 0, 1, -1)
    return near


def decode_e8(x: np.ndarray) -> np.ndarray:
    """Nearest points of E8 = D8 and D8 shifted by one half in all coordinates."""
    whole = decode_d8(x)
    half = decode_d8(x - 0.5) + 0.5
    nearer = ((x - half) ** 2).sum(axis=1) < ((x - whole) ** 2).sum(axis=1)
    return np.where(nearer[:, None], half, whole)


def shortest_e8() -> np.ndarray:
    """The 240 shortest vectors of E8, by rule: two of +-1, or eight of +-1/2 with an even number of minus signs."""
    out = []
    for i in range(8):
        for j in range(i):
            for a in (-1, 1):
                for b in (-1, 1):
                    v = np.zeros(8)
                    v[i], v[j] = a, b
                    out.append(v)
    for bits in range(256):
        if bin(bits).count("1") % 2 == 0:
            out.append(np.array([-0.5 if bits >> k & 1 else 0.5 for k in range(8)]))
    return np.array(out)


SHORTEST = shortest_e8()


def projections(dim: int) -> np.ndarray:
    """TABLES x BLOCKS random projections of a unit vector to 8 dimensions, orthonormal within a table and scaled to keep lengths on average."""
    wide, out = max(dim, 8 * BLOCKS), []
    for t in range(TABLES):
        q = np.linalg.qr(np.random.default_rng((SEED, dim, t)).standard_normal((wide, 8 * BLOCKS)))[0][:dim]
        out.append(np.stack(np.split(q * np.sqrt(wide / 8), BLOCKS, axis=1)))
    return np.stack(out)


def cells(unit: np.ndarray, planes: np.ndarray) -> np.ndarray:
    """Names of each vector's cells, (n, TABLES * CELLS): in a table its own cell and the nearest others.

    A cell is one lattice point for each block; the others swap points for their
    neighbours, and the least distances in all blocks together win.
    """
    mult = np.random.default_rng(SEED).integers(1, 1 << 62, size=8) * 2 + 1
    out = np.empty((len(unit), TABLES, CELLS), dtype=np.int64)
    for t in range(TABLES):
        names, far = np.full((len(unit), 1), t, dtype=np.int64), np.zeros((len(unit), 1))
        for plane in planes[t]:
            x = unit @ plane / SCALE
            own = decode_e8(x)
            off = x - own
            away = (off**2).sum(axis=1)[:, None] + (SHORTEST**2).sum(axis=1) - 2 * off @ SHORTEST.T
            side = np.argpartition(away, NEAR - 1, axis=1)[:, :NEAR]
            points = np.concatenate([own[:, None, :], own[:, None, :] + SHORTEST[side]], axis=1)
            away = np.concatenate([(off**2).sum(axis=1)[:, None], np.take_along_axis(away, side, axis=1)], axis=1)
            code = ((2 * points).astype(np.int64) * mult).sum(axis=2)  # wraps
            names = ((names * 0x5851F42D4C957F2D)[:, :, None] + code[:, None, :]).reshape(len(unit), -1)
            far = (far[:, :, None] + away[:, None, :]).reshape(len(unit), -1)
            best = np.argsort(far, axis=1, kind="stable")[:, :CELLS]
            names, far = np.take_along_axis(names, best, axis=1), np.take_along_axis(far, best, axis=1)
        out[:, t, :] = names
    return out.reshape(len(unit), -1)


def _named(classes: DataFrame, kind: str) -> DataFrame:
    """node, label, copies, dim, the vector packed in numbers of ``kind``, and its cells."""

    def run(batches):
        planes: dict[int, np.ndarray] = {}
        for pdf in batches:
            for dim, part in pdf.groupby("dim"):
                for at in range(0, len(part), 1000):
                    sub = part.iloc[at : at + 1000]
                    x = np.stack(sub["embedding"].to_list()).astype(np.float64)
                    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
                    if dim not in planes:
                        planes[dim] = projections(dim)
                    yield pd.DataFrame({**{c: sub[c].array for c in ("node", "label", "copies", "dim")}, "vector": [v.tobytes() for v in x.astype(kind)], "cells": list(cells(unit, planes[dim]))})

    named = classes.mapInPandas(run, "node long, label string, copies long, dim int, vector binary, cells array<long>")
    return named.withColumn("cells", F.array_distinct(F.transform("cells", lambda c: F.xxhash64(c, "label", "dim"))))


def met_before(own: list[np.ndarray], here: int) -> np.ndarray:
    """Rows of a tile as bits of the cells before this one that any two of them share: two rows met before where a bit is common."""
    size = np.fromiter(map(len, own), dtype=np.int64, count=len(own))
    cell, row = np.concatenate(own), np.repeat(np.arange(len(own)), size)
    cell, row = cell[cell < here], row[cell < here]
    _, name, n = np.unique(cell, return_inverse=True, return_counts=True)
    name, row = name[n[name] > 1], row[n[name] > 1]
    kinds, name = np.unique(name, return_inverse=True)
    bits = np.zeros((len(own), -(-len(kinds) // 64)), dtype=np.uint64)
    np.bitwise_or.at(bits, (row, name >> 6), np.uint64(1) << (name & 63).astype(np.uint64))
    return bits


def _links(tiles: DataFrame, batches: int, cosine: float, kind: str) -> DataFrame:
    """Within each tile: how many vectors each class links with, counted only where two classes first meet, and links that span the tile's components."""

    keys = ["cell", "label", "dim", "_i", "_j"]

    def one(x, own, node, copies, block, here, within):
        """Links within one tile: rows, counts and least linked rows; None if there are none."""
        found, root, bits = [], np.arange(len(x)), None
        for at in range(0, len(x), BLOCK):
            i, j = np.nonzero(x[at : at + BLOCK] @ x[at:].T >= cosine)
            i, j = i + at, j + at
            ok = i < j
            if not within:
                ok &= block[i] != block[j]
            i, j = i[ok], j[ok]
            if not len(i):
                continue
            bits = met_before(own, here) if bits is None else bits
            first = ~(bits[i] & bits[j]).any(axis=1)
            found.append((i[first], j[first]))
        if not found:
            return None
        i, j = (np.concatenate(c) for c in zip(*found, strict=True))
        if not len(i):
            return None
        linked = np.bincount(i, weights=copies[j], minlength=len(x)) + np.bincount(j, weights=copies[i], minlength=len(x))
        while True:  # least row that each row reaches
            low = np.minimum(root[i], root[j])
            new = root.copy()
            np.minimum.at(new, i, low)
            np.minimum.at(new, j, low)
            new = new[new]
            if (new == root).all():
                break
            root = new
        hit = linked > 0
        return node[hit], linked[hit].astype(np.int64), node[root][hit]

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        out = []
        for _, part in pdf.groupby("dim"):
            part, spans = spans_of(part, keys, "node")
            x = np.frombuffer(b"".join(part["vector"]), dtype=kind).reshape(len(part), -1).astype(np.float64)
            x /= np.sqrt((x * x).sum(axis=1, keepdims=True))
            node, copies, block, cell, i, j, own = (part[c].to_numpy() for c in ("node", "copies", "_b", "cell", "_i", "_j", "own"))
            for s, e in spans:
                if (got := one(x[s:e], list(own[s:e]), node[s:e], copies[s:e], block[s:e], cell[s], i[s] == j[s])) is not None:
                    out.append(got)
        cols = [np.concatenate(c) for c in zip(*out, strict=True)] if out else [np.empty(0, dtype=np.int64)] * 3
        return pd.DataFrame(dict(zip(("node", "linked", "top"), cols, strict=True)))

    return each_tile(tiles, keys, batches, run, "node long, linked long, top long")


def near_duplicates(vectors: DataFrame, scratch: Scratch, cosine: float = 0.93) -> DataFrame:
    """Vectors of equal label whose cosine in double precision is at least ``cosine``, as link counts and components.

    Equal vectors of a label form a class first. Each class is projected to ``BLOCKS``
    times 8 dimensions in each of ``TABLES`` tables, decoded to E8 lattice points, and
    filed under the cell that they name together and under the ``CELLS`` - 1 nearest
    cells. Cells with one class are dropped and cells of the same classes are taken
    once before any vector is moved. Classes that share a cell are compared by cosine,
    blockwise; cells of over ``TILE_ROWS`` classes are dealt as pairs of blocks. A pair
    counts at the first cell it shares, so link counts add up without writing pairs
    out, and each tile hands on only a spanning forest of its links.

    vectors: vec_id, embedding, label (of any plain type). Returns vec_id, n_links,
    component_id, kept. Null, empty or zero vectors, those with null or non-finite
    components and those without a label link with nothing, and only vectors of equal
    length are compared. Rows of one vec_id are one node in components and one of the
    vectors that n_links counts; a null vec_id
    links with nothing, has a null component and is not kept. An empty table gives no
    rows.
    """
    # components near the ends of the doubles' range are moved by a power of two, so that their squares neither overflow nor vanish
    most = F.array_max(F.transform("embedding", lambda v: F.abs(v.cast("double"))))
    shift = F.when(most > 1e150, F.lit(2.0**-600)).when(most < 1e-150, F.lit(2.0**600)).otherwise(F.lit(1.0))
    norm = F.aggregate("embedding", F.lit(0.0), lambda s, v: s + v * v)
    sound = F.coalesce((norm > 0) & (norm < F.lit(float("inf"))) & ~F.isnan(norm), F.lit(False)) & F.col("label").isNotNull() & F.col("vec_id").isNotNull()
    vec = F.transform("embedding", lambda v: v.cast("double") * F.col("_shift") + F.lit(0.0))
    label = F.col("label") + F.lit(0.0).cast(vectors.schema["label"].dataType) if isinstance(vectors.schema["label"].dataType, (FloatType, DoubleType)) else F.col("label")
    kind = "<f4" if isinstance(getattr(vectors.schema["embedding"].dataType, "elementType", None), FloatType) else "<f8"
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "label", "embedding", shift.alias("_shift"))
    shifted = scratch.keep(rows, "shifted")
    rows = shifted.select("vec_id", label.cast("string").alias("_label"), vec.alias("embedding"), "label")
    # written before and after, as a column computed for a row would otherwise be computed again for every component
    scaled = scratch.keep(rows, "scaled")
    scratch.drop(shifted)
    rows = scaled.select("vec_id", F.col("_label").alias("label"), "embedding", sound.alias("sound"))
    good = rows.where("sound").withColumn("k1", F.xxhash64("embedding")).withColumn("k2", F.hash("embedding"))
    key = ["label", "k1", "k2", "dim"]
    good = good.withColumn("dim", F.size("embedding"))
    copies = good.select(*key, "vec_id").distinct().groupBy(*key).agg(F.count("*").alias("copies"))  # other vectors are those of other vec_ids
    classes = scratch.keep(good.groupBy(*key).agg(F.min("vec_id").alias("node"), F.first("embedding").alias("embedding")).join(copies, key), "classes")
    named = scratch.keep(_named(classes.select("node", "label", "copies", "dim", "embedding"), kind), "named")
    filed = named.select(F.explode("cells").alias("cell"), "node")
    full = filed.groupBy("cell").agg(F.count("*").alias("rows"), F.bit_xor(F.xxhash64("node")).alias("x1"), F.bit_xor(F.xxhash64("node", F.lit(1))).alias("x2")).where("rows > 1")
    once = full.groupBy("rows", "x1", "x2").agg(F.min("cell").alias("cell")).select("cell", "rows")
    shared = scratch.keep(filed.join(once, "cell"), "shared")
    total = shared.agg(F.sum(F.ceil(F.col("rows") / TILE_ROWS))).first()[0] or 0
    own = shared.groupBy("node").agg(F.collect_list("cell").alias("own"))
    shipped = shared.join(named.drop("cells").join(own, "node"), "node")
    found = scratch.keep(_links(tile(shipped, F.ceil(F.col("rows") / TILE_ROWS), F.col("node")).drop("rows"), -(-total // BATCH_ROWS), cosine, kind), "found")
    scratch.drop(named, shared)
    member = scratch.keep(good.join(classes.select(*key, "node", "copies"), key).select("vec_id", "node", "copies"), "members")
    links = found.select(F.col("top").alias("a"), F.col("node").alias("b")).union(member.where("node < vec_id").select(F.col("node").alias("a"), F.col("vec_id").alias("b")))
    comp = connected_components(links, scratch)
    linked = found.groupBy("node").agg(F.sum("linked").alias("linked"))
    counts = member.join(linked, "node", "left").select("vec_id", (F.col("copies") - 1 + F.coalesce("linked", F.lit(0))).alias("n_links"))
    counts = counts.dropDuplicates(["vec_id", "n_links"]).groupBy("vec_id").agg(F.max("n_links").alias("n_links"))
    out = rows.select("vec_id", "sound").join(counts, "vec_id", "left").join(comp.withColumnRenamed("node", "vec_id"), "vec_id", "left")
    out = out.select("vec_id", F.when(F.col("sound"), F.coalesce("n_links", F.lit(0))).otherwise(0).cast("long").alias("n_links"), F.coalesce("component", "vec_id").alias("component_id"))
    result = scratch.keep(out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False))), "result")
    scratch.drop(scaled, classes, found, member)
    return result
