"""Filter interaction audit: what each of five filters removes in every order of applying them, by source.

Texts are read where Arrow has them: byte classes by one table look-up, prefix sums of
the classes for counts, and hashes of words from a prefix sum for distinct words.
"""

from __future__ import annotations

from itertools import permutations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pinweave.llm.rows import release
from pinweave.runtime import Scratch, broadcast_if_small

PIECE = 1 << 20  # bytes whose classes and hashes are held at a time
FILTERS = "ABCDE"
BLANKS = b" \t\n\x0b\x0c\r"
SYMBOLS = b"#$%&*|"
MIN_WORDS = 200
KEY_BITS = 40  # of a word's hash in its sort key, behind the document's place in the piece

_WORD = ~np.isin(np.arange(256), list(BLANKS))
_CAPITAL = (np.arange(256) >= 65) & (np.arange(256) <= 90)
_SYMBOL = np.isin(np.arange(256), list(SYMBOLS))
_POINT = (np.arange(256) & 0xC0) != 0x80  # the first byte of a code point
_NOISE = np.random.default_rng(13).integers(1, 1 << 62, 256, dtype=np.uint64)
_ODD = 0x9E3779B97F4A7C15
_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd number modulo 2**64 and of its inverse."""
    have = max(_POWERS, default=0)
    if have < n:
        _POWERS.clear()
        have = max(n, PIECE)
        _POWERS[have] = tuple(np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(have, base, dtype=np.uint64)]), dtype=np.uint64) for base in (_ODD, pow(_ODD, -1, 1 << 64)))
    return _POWERS[have]


def _sums(flags: np.ndarray) -> np.ndarray:
    return np.concatenate([[0], np.cumsum(flags, dtype=np.int64)])


def _same_words(data: np.ndarray, start: np.ndarray, size: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whether words a[i] and b[i] are equal byte by byte, in steps of a bounded number of bytes."""
    out = size[a] == size[b]
    check = np.flatnonzero(out)
    upto = np.cumsum(size[a[check]])
    at = 0
    while at < len(check):
        end = max(at + 1, int(np.searchsorted(upto, (upto[at - 1] if at else 0) + 2 * PIECE, side="right")))
        some = check[at:end]
        n = size[a[some]]
        first = np.cumsum(n) - n
        along = np.arange(int(n.sum())) - np.repeat(first, n)
        alike = data[np.repeat(start[a[some]], n) + along] == data[np.repeat(start[b[some]], n) + along]
        out[some] = np.logical_and.reduceat(alike, first)
        at = end
    return out


def _words(data: np.ndarray, edges: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, size and hash of every word; documents begin at ``edges[:-1]`` and the last ends at ``edges[-1]``, so no word crosses an edge."""
    inside = _WORD[data]
    begin, finish = inside.copy(), inside.copy()
    begin[1:] &= ~inside[:-1]
    finish[:-1] &= ~inside[1:]
    cut = edges[(edges > 0) & (edges < len(data))]
    begin[cut] = inside[cut]
    finish[cut - 1] = inside[cut - 1]
    start, end = np.flatnonzero(begin), np.flatnonzero(finish) + 1
    power, inverse = _powers(len(data))
    upto = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_NOISE[data] * power[: len(data)], dtype=np.uint64)])
    mixed = (upto[end] - upto[start]) * inverse[start]
    mixed ^= mixed >> np.uint64(32)
    return start, end - start, mixed * np.uint64(_ODD)


def _distinct_long(data: np.ndarray) -> int:
    """Distinct words of one long text: each piece (cut at blanks) hands on one of each of its words, and what is left is sorted once more."""
    starts, sizes, hashes, at = [], [], [], 0
    while at < len(data):
        end = min(at + PIECE, len(data))
        while end < len(data) and _WORD[data[end]]:  # to the end of the word
            more = np.flatnonzero(~_WORD[data[end : end + PIECE]])
            end = end + int(more[0]) if len(more) else min(end + PIECE, len(data))
        start, size, h = _words(data[at:end], np.array([0, end - at]))
        order = np.argsort(h)
        a, b = order[:-1], order[1:]
        again = h[a] == h[b]
        alike = _same_words(data[at:end], start, size, a[again], b[again])
        if not alike.all():  # two words of one hash
            return len(set(data.tobytes().split()))
        keep = np.concatenate([order[:1], b[~again]])
        starts, sizes, hashes = [*starts, start[keep] + at], [*sizes, size[keep]], [*hashes, h[keep]]
        at = end
    start, size, h = np.concatenate(starts), np.concatenate(sizes), np.concatenate(hashes)
    order = np.argsort(h)
    again = h[order[:-1]] == h[order[1:]]
    if not _same_words(data, start, size, order[:-1][again], order[1:][again]).all():
        return len(set(data.tobytes().split()))
    return len(h) - int(again.sum())


def _scan(data: np.ndarray, edges: np.ndarray) -> np.ndarray:
    """Words, distinct words, capitals, symbols and code points of each of the documents between ``edges``, one row a figure."""
    start, size, h = _words(data, edges)
    words = np.diff(np.searchsorted(start, edges))
    counted = [np.diff(_sums(kind[data])[edges]) for kind in (_CAPITAL, _SYMBOL, _POINT)]
    doc = np.repeat(np.arange(len(words), dtype=np.uint64), words)
    key = (doc << np.uint64(KEY_BITS)) | (h >> np.uint64(64 - KEY_BITS))
    order = np.argsort(key)
    again = key[order[:-1]] == key[order[1:]]
    a, b = order[:-1][again], order[1:][again]
    alike = _same_words(data, start, size, a, b)
    of = doc[b].astype(np.int64)
    distinct = words - np.bincount(of[alike], minlength=len(words))
    for d in np.unique(of[~alike]).tolist():  # words of one hash: count these documents exactly
        distinct[d] = len(set(data[edges[d] : edges[d + 1]].tobytes().split()))
    return np.array([words, distinct, *counted])


def figures(texts: pa.Array) -> np.ndarray:
    """``[5, n]``: words, distinct words, capitals, symbols and code points of every text (null: empty), off the array's own buffers."""
    n = len(texts)
    out = np.zeros((5, n), dtype=np.int64)
    if not n or texts.buffers()[2] is None:
        return out
    wide = np.int64 if pa.types.is_large_string(texts.type) or pa.types.is_large_binary(texts.type) else np.int32
    edges = np.frombuffer(texts.buffers()[1], dtype=wide)[texts.offset : texts.offset + n + 1].astype(np.int64)
    data = np.frombuffer(texts.buffers()[2], dtype=np.uint8)
    at = 0
    while at < n:
        end = max(at + 1, int(np.searchsorted(edges, edges[at] + PIECE, side="right")) - 1)
        part = data[edges[at] : edges[end]]
        if len(part) > PIECE:  # one text
            out[:, at] = sum((_long_piece(part[i : i + PIECE], i == 0 or not _WORD[part[i - 1]]) for i in range(0, len(part), PIECE)), np.zeros(5, np.int64))
            out[1, at] = _distinct_long(part)
        elif len(part):
            out[:, at:end] = _scan(part, edges[at : end + 1] - edges[at])
        at = end
    if texts.null_count:
        out[:, texts.is_null().to_numpy(zero_copy_only=False)] = 0
    return out


def _long_piece(data: np.ndarray, fresh: bool) -> np.ndarray:
    """Figures of a piece of a long text but distinct words; a word that goes on from the piece before is not counted again."""
    inside = _WORD[data]
    begins = int((inside[1:] & ~inside[:-1]).sum()) + int(inside[0] and fresh)
    return np.array([begins, 0, _CAPITAL[data].sum(), _SYMBOL[data].sum(), _POINT[data].sum()], dtype=np.int64)


def failed(fig: np.ndarray) -> np.ndarray:
    """Bits 0 to 3 of the failure mask (filters A to D) from ``figures``."""
    words, distinct, capitals, symbols, points = fig
    fails = (words < MIN_WORDS, 100 * distinct < 50 * words, 100 * capitals > 2 * points, symbols > 0)
    return sum((f.astype(np.int32) << i for i, f in enumerate(fails)), np.zeros(fig.shape[1], np.int32))


def _steps() -> tuple[list[tuple[str, int]], np.ndarray, np.ndarray]:
    """Orders and steps, with each step's own bit and the bits of those before it."""
    rows, own, before = [], [], []
    for order in permutations(range(len(FILTERS))):
        seen = 0
        for step, f in enumerate(order):
            rows.append(("".join(FILTERS[i] for i in order), step + 1))
            own.append(1 << f)
            before.append(seen)
            seen |= 1 << f
    return rows, np.array(own), np.array(before)


def interactions(counts: np.ndarray) -> pd.DataFrame:
    """Every order and step from ``counts[3, 32]``: documents, good ones and toxic ones by failure mask."""
    rows, own, before = _steps()
    mask = np.arange(1 << len(FILTERS))
    fails, gone = (mask & own[:, None]) != 0, (mask & before[:, None]) != 0
    here = fails & ~gone
    removed, good, toxic = (here.astype(np.int64) @ counts.T).T
    out = pd.DataFrame(rows, columns=["filter_order", "step"])
    out["kept"] = (~fails & ~gone).astype(np.int64) @ counts[0]
    out["removed"], out["redundant"] = removed, (fails & gone).astype(np.int64) @ counts[0]
    out["unique_fails"], out["good_lost"], out["toxic_lost"] = (mask == own[:, None]).astype(np.int64) @ counts[0], good, toxic
    return out.assign(shapley=out.groupby(own)["removed"].transform("sum"))


def masks(docs: DataFrame, scratch: Scratch) -> DataFrame:
    """``(doc_id, part, fails)``: the bits of the filters that each document fails, A lowest; part is the source, null as the empty string.

    A to D are read off a text. E holds for a document if a smaller doc_id has the same
    text anywhere in the table: texts are compared by their SHA-256, least doc_ids are
    aggregated where the rows are, and only texts of several doc_ids are joined back.
    Null texts are empty; a null doc_id is neither smaller nor larger than another and
    does not fail E; repeated rows of one doc_id are no copies of each other.
    """
    rows = docs.select("doc_id", F.coalesce("source", F.lit("")).alias("part"), F.unhex(F.sha2(F.coalesce("text", F.lit("")), 256)).alias("own"), "text")

    def run(batches):
        for batch in batches:
            fails = failed(figures(batch.column("text")))
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in ("doc_id", "part", "own")], pa.array(fails, pa.int32())], names=["doc_id", "part", "own", "fails"])
        release()

    read = scratch.keep(rows.mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, part string, own binary, fails int"), "figures")
    first = read.groupBy("own").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last")).where("first < last").select("own", "first")
    later = F.when(F.col("doc_id") > F.col("first"), F.lit(1 << 4)).otherwise(0)
    return read.join(broadcast_if_small(scratch.keep(first, "copies"), 100_000), "own", "left").select("doc_id", "part", F.col("fails").bitwiseOR(F.coalesce(later, F.lit(0))).alias("fails"))


def audit(docs: DataFrame, labels: DataFrame, scratch: Scratch) -> DataFrame:
    """One row for each part, order of the five filters and step: what is kept, removed, redundant and lost there.

    Documents are reduced to counts by part, mask of failed filters and label where they
    are; a part is at most 128 such rows, from which all orders follow. A document is good
    (toxic) if any label row of its doc_id has quality (toxic) 1. Sources of any number
    stay apart; a source of null and one of the empty string are one part. Repeated rows
    count each; an empty table gives no rows. Columns: part, filter_order, step, kept,
    removed, redundant, unique_fails, good_lost, toxic_lost, shapley.
    """
    truth = labels.where("doc_id IS NOT NULL AND (quality = 1 OR toxic = 1)").groupBy("doc_id").agg(F.coalesce(F.bool_or(F.col("quality") == 1), F.lit(False)).alias("good"), F.coalesce(F.bool_or(F.col("toxic") == 1), F.lit(False)).alias("toxic"))
    seen = masks(docs, scratch).join(truth, "doc_id", "left")
    counts = seen.groupBy("part", "fails", F.coalesce("good", F.lit(False)).alias("good"), F.coalesce("toxic", F.lit(False)).alias("toxic")).agg(F.count("*").alias("docs"))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        table = np.zeros((3, 1 << len(FILTERS)), dtype=np.int64)
        for i, held in enumerate((slice(None), pdf["good"].to_numpy(bool), pdf["toxic"].to_numpy(bool))):
            np.add.at(table[i], pdf["fails"].to_numpy()[held], pdf["docs"].to_numpy()[held])
        return interactions(table).assign(part=pdf["part"].iloc[0])[["part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]]

    longs = ", ".join(f"{c} long" for c in ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"))
    return counts.groupBy("part").applyInPandas(run, f"part string, filter_order string, step int, {longs}")
