"""Splitting hot groups into pairs of blocks, so that no task has to hold a whole group."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def tile(rows: DataFrame, blocks: Column, ident: Column) -> DataFrame:
    """Add ``_i, _j, _b``: the tile a row goes to and the row's own block.

    A group of one block is one tile (0, 0). A larger one is cut into ``blocks``
    blocks by the hash of ``ident``; every pair of blocks, and every block with
    itself, is a tile, so that each pair of rows of the group meets in one tile.
    """
    blocks = blocks.cast("int")
    own = F.pmod(F.hash(ident), blocks)
    pairs = F.transform(F.sequence(F.lit(0), blocks - 1), lambda j: F.struct(F.least(own, j).alias("i"), F.greatest(own, j).alias("j")))
    return rows.withColumn("_b", own).withColumn("_t", F.explode(pairs)).withColumn("_i", F.col("_t.i")).withColumn("_j", F.col("_t.j")).drop("_t")


def each_tile(tiles: DataFrame, keys: list[str], batches: int, work: Callable[[pd.DataFrame], pd.DataFrame], schema: str) -> DataFrame:
    """Apply ``work`` to hashed batches of whole tiles; ``spans_of`` finds the tiles in one.

    Tiles are small and many, so they are dealt into batches, as many as the caller's
    weights ask for, instead of being grouped one by one.
    """
    return tiles.withColumn("_batch", F.pmod(F.xxhash64(*keys), F.lit(max(1, batches)))).groupBy("_batch").applyInPandas(work, schema)


def spans_of(pdf: pd.DataFrame, keys: list[str], within: str) -> tuple[pd.DataFrame, Iterator[tuple[int, int]]]:
    """The batch sorted by tile, then by ``within``, and the row range of each tile."""
    pdf = pdf.sort_values([*keys, within], ignore_index=True)
    new = np.zeros(len(pdf), dtype=bool)
    for k in keys:
        col = pdf[k].to_numpy()
        new[1:] |= col[1:] != col[:-1]
    edge = np.concatenate([[0], np.flatnonzero(new), [len(pdf)]])
    return pdf, zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True)
