"""Exact n-gram Jaccard join: size-banded tiles, bitmap bounds, sorted-array intersection."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pinweave.llm.rows import map_texts, release
from pinweave.llm.tiles import each_tile, spans_of, tile
from pinweave.operators.components import connected_components
from pinweave.runtime import Scratch, broadcast_if_small

BITS_EACH = 8  # bits of a bitmap for each element, rounded up to a power of two
LEAST_BITS = 512
VOCABULARY = 200_000  # word hashes that a worker remembers
SEEN = 200_000  # names of sets that a worker remembers, so as to write the parts of copies once
NAME = (1 << 48) - 1  # part and set names in shuffles have 48 bits; sets are told apart by 32 more, so that a chance meeting costs a comparison
TILE_ROWS = 4096  # rows of a block of a hot tile
TILE_SHINGLES = 2_000_000  # and its shingles
BATCH_SHINGLES = 4_000_000  # shingles behind the tiles of one task
DEALT_SHINGLES = 3_000_000  # shingles behind the part names that one task of the tile join gets
MAX_BROADCAST_IDS = 1_000_000
PAIRS = 4_000  # pairs whose bitmaps or sets are compared in one task, where their number is known
U = np.uint64
_HASHES: dict[bytes, int] = {}


def _mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def shingles(text: str | None, n: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the n-word shingles; with fewer words the whole sequence is one."""
    words = text.encode("utf-8", "surrogatepass").lower().split() if text else []
    if not words:
        return np.empty(0, dtype=np.uint64)
    if len(_HASHES) > VOCABULARY:
        _HASHES.clear()
    try:
        h = [_HASHES[w] for w in words]
    except KeyError:
        for w in words:
            if w not in _HASHES:
                _HASHES[w] = xxhash.xxh3_64_intdigest(w)
        h = [_HASHES[w] for w in words]
    h = np.array(h, dtype=np.uint64)
    size = min(n, len(h))
    out = np.full(len(h) - size + 1, size, dtype=np.uint64)
    for k in range(size):
        out = _mix(out * U(0x9E3779B97F4A7C15) + h[k : len(h) - size + 1 + k])
    return np.unique(out)


@lru_cache(maxsize=None)
def bands(num: int, den: int, top: int) -> tuple[tuple[int, int, int], ...]:
    """Size bands ``(low, high, parts)`` up to ``top``, and into how many parts a band cuts the hash range.

    Sets of sizes a and b with Jaccard of at least num/den differ in at most
    (a + b)(den - num)/(den + num) elements, so they differ in at most so many parts;
    a band has more parts than that for its largest sizes.
    """
    out, low = [], 1
    while low <= top:
        high = low + low // 2
        while (2 * (high + 1) * (den - num)) // (den + num) == 0:
            high += 1
        most = (2 * high * (den - num)) // (den + num)
        out.append((low, high, most + 1 + most // 8))
        low = high + 1
    return tuple(out)


def signatures(h: np.ndarray, num: int, den: int) -> np.ndarray:
    """64-bit names of parts of the set, in its own band and in those above where a linked set can lie.

    With at most d differing parts between the set and any partner in the band, the
    first d + 1 parts that have elements are named, or all parts where fewer have.
    Of two linked sets, take the one whose named parts end first: one of its d + 1
    is the same in the other, lies within the other's reach, and so is named by both.
    """
    n = len(h)
    largest = n * den // num
    top = 1 << max(largest, 1).bit_length()
    out, sums = [], np.concatenate([[U(0)], np.cumsum(_mix(h))])
    for low, high, parts in bands(num, den, top):
        if high < n:
            continue
        if low > largest:
            break
        edge = np.searchsorted(((h >> U(32)) * U(parts)) >> U(32), np.arange(parts + 1, dtype=np.uint64))
        differ = ((n + min(high, largest)) * (den - num)) // (den + num)
        at = np.flatnonzero(edge[1:] > edge[:-1])
        at = at[: differ + 1] if len(at) > differ else np.arange(parts)
        names = sums[edge[at + 1]] - sums[edge[at]]
        out.append(_mix(names + _mix(at.astype(np.uint64) * U(0x9E3779B97F4A7C15) + U(low))))
    return np.concatenate(out)


def bitmap(h: np.ndarray) -> np.ndarray:
    """The set hashed to bits, at least BITS_EACH for each element."""
    size = max(LEAST_BITS, 1 << (BITS_EACH * len(h) - 1).bit_length())
    bits = np.zeros(size, dtype=np.uint8)
    bits[(h & U(size - 1)).astype(np.int64)] = 1
    return np.packbits(bits, bitorder="little").view(np.uint64)


def folded(maps: list[bytes] | np.ndarray) -> np.ndarray:
    """Bitmaps of several lengths as rows of the least length: halves are laid over each other, which keeps every element's bit."""
    sizes = np.fromiter(map(len, maps), dtype=np.int64, count=len(maps))
    least = int(sizes.min()) // 8
    out = np.empty((len(sizes), least), dtype=np.uint64)
    for size in np.unique(sizes):
        at = np.flatnonzero(sizes == size)
        rows = np.frombuffer(b"".join([maps[i] for i in at]), dtype=np.uint64).reshape(len(at), -1, least)
        out[at] = np.bitwise_or.reduce(rows, axis=1)
    return out


def overlap_bound(maps: np.ndarray, sizes: np.ndarray, one: np.ndarray, size: int | np.ndarray) -> np.ndarray:
    """Upper bounds on the overlap of one set with many: each bit of one side only stands for an element that the other lacks."""
    lone = size - np.bitwise_count(one & ~maps).sum(axis=1, dtype=np.int64)
    many = sizes - np.bitwise_count(maps & ~one).sum(axis=1, dtype=np.int64)
    return np.minimum(lone, many)


def _name(h: np.ndarray) -> np.ndarray:
    """128-bit name of a set, as two longs."""
    return np.frombuffer(xxhash.xxh3_128_digest(h.tobytes()), dtype=np.int64)


def _digest(docs: DataFrame, n: int) -> DataFrame:
    """doc_id, size of the set and its 128-bit name."""

    def make():
        def work(texts):
            sets = [shingles(t, n) for t in texts]
            names = [_name(h).tolist() if len(h) else (None, None) for h in sets]
            return [[len(h) for h in sets], [x for x, _ in names], [y for _, y in names]]

        return work

    return map_texts(docs.select("doc_id", "text"), make, [("n_shingles", pa.int64(), "long"), ("h1", pa.int64(), "long"), ("h2", pa.int64(), "long")])


def _parts(docs: DataFrame, n: int, num: int, den: int) -> DataFrame:
    """Names of parts and of the sets that have them, with what tells sets of one name apart: sig, h, c. A set that a task meets again is written once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[tuple[int, int]] = set()
        packed = lambda *cols: pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in cols], names=["sig", "h", "c"])
        for batch in batches:
            sigs, sets, others, many = [], [], [], 0
            for text in batch.column("text").to_pylist():
                h = shingles(text, n)
                if not len(h):
                    continue
                whole = tuple(_name(h).tolist())
                if whole in seen:
                    continue
                if len(seen) >= SEEN:
                    seen.clear()
                seen.add(whole)
                sigs.append((signatures(h, num, den) & U(NAME)).view(np.int64))
                sets.append(np.full(len(sigs[-1]), whole[0] & NAME, dtype=np.int64))
                others.append(np.full(len(sigs[-1]), whole[1] & 0xFFFFFFFF, dtype=np.uint32).view(np.int32))
                many += len(sigs[-1])
                if many >= 1 << 17:
                    yield packed(sigs, sets, others)
                    sigs, sets, others, many = [], [], [], 0
            if many:
                yield packed(sigs, sets, others)
        release()

    return docs.select("text").mapInArrow(run, "sig long, h long, c int")


def _bits(texts: DataFrame, n: int) -> DataFrame:
    """Sizes and bitmaps of the sets: node, size, bits."""

    def make():
        def work(texts):
            sets = [shingles(t, n) for t in texts]
            return [[len(h) for h in sets], [bitmap(h).tobytes() for h in sets]]

        return work

    return map_texts(texts.select(F.col("doc_id").alias("node"), "text"), make, [("size", pa.int64(), "long"), ("bits", pa.binary(), "binary")])


def _elements(texts: DataFrame, n: int) -> DataFrame:
    """The sorted sets themselves, packed: node, elements."""
    make = lambda: lambda texts: [[shingles(t, n).tobytes() for t in texts]]
    return map_texts(texts.select(F.col("doc_id").alias("node"), "text"), make, [("elements", pa.binary(), "binary")])


def _texts_of(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """The documents of ``ids(node)``: by broadcast of up to MAX_BROADCAST_IDS ids, else by a shuffled join."""
    return docs.join(broadcast_if_small(ids.withColumnRenamed("node", "doc_id"), MAX_BROADCAST_IDS), "doc_id", "left_semi")


def linked(x: np.ndarray, y: np.ndarray, num: int, den: int) -> bool:
    """Whether two sorted sets have Jaccard of at least num/den, by their exact intersection."""
    at = np.searchsorted(y, x)
    at[at == len(y)] = 0
    # an overlap o links when den * o >= num * (sizes - o)
    return (den + num) * int((y[at] == x).sum()) >= num * (len(x) + len(y))


def _bounded(pairs: DataFrame, sets: DataFrame, num: int, den: int) -> DataFrame:
    """Of ``(a, b)`` those whose bitmaps allow a link."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for _, part in pdf.groupby([pdf["ma"].map(len), pdf["mb"].map(len)]):
                maps, n = folded([*part["ma"], *part["mb"]]), len(part)
                sa, sb = part["sa"].to_numpy(), part["sb"].to_numpy()
                yield part.loc[(den + num) * overlap_bound(maps[n:], sb, maps[:n], sa) >= num * (sa + sb), ["a", "b"]]
        release()

    side = lambda k: sets.select(F.col("node").alias(k), F.col("size").alias("s" + k), F.col("bits").alias("m" + k))
    return pairs.join(side("b"), "b").join(side("a"), "a").mapInPandas(run, "a long, b long")


def _verify(pairs: DataFrame, docs: DataFrame, n: int, num: int, den: int, scratch: Scratch) -> DataFrame:
    """Of ``(a, b)`` those that link by the intersection of their sorted arrays, which are made for the documents of the pairs alone."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            keep = [linked(np.frombuffer(ea, dtype=np.uint64), np.frombuffer(eb, dtype=np.uint64), num, den) for ea, eb in zip(pdf["ea"], pdf["eb"], strict=True)]
            yield pdf.loc[np.array(keep, dtype=bool), ["a", "b"]]
        release()

    firsts, rows = pairs.select(F.col("a").alias("node")).distinct(), pairs.count()
    sets = scratch.keep(_elements(_texts_of(docs, firsts.union(pairs.select(F.col("b").alias("node"))).distinct()), n), "sets")
    side = lambda df, k: df.select(F.col("node").alias(k), F.col("elements").alias("e" + k))
    left = side(sets, "b").join(broadcast_if_small(pairs, MAX_BROADCAST_IDS), "b")
    right = side(sets.join(broadcast_if_small(firsts, MAX_BROADCAST_IDS), "node", "left_semi"), "a")
    out = scratch.keep(left.join(right, "a").mapInPandas(run, "a long, b long"), "verified", rows=rows, each=PAIRS)
    scratch.drop(sets)
    return out


TILE = ["sig", "_i", "_j"]


def _partners(maps: np.ndarray, size: np.ndarray, comp: np.ndarray, block: np.ndarray, within: bool, num: int, den: int) -> Iterator[tuple[int, np.ndarray]]:
    """Rows of a tile outside its largest component, each with the rows of other components that its bitmap allows, the best bound first.

    A pair comes up once: with the largest component from the other side, else from the earlier row.
    """
    largest = np.bincount(comp).argmax()
    order = np.arange(len(comp))
    for i in np.flatnonzero(comp != largest):
        ok = (comp != comp[i]) & ((comp == largest) | (order > i))
        if not within:
            ok &= block != block[i]
        ok &= den * np.minimum(size, size[i]) >= num * np.maximum(size, size[i])
        js = np.flatnonzero(ok)
        if not len(js):
            continue
        bound = overlap_bound(maps[js], size[js], maps[i], size[i])
        fit = (den + num) * bound >= num * (size[js] + size[i])
        if fit.any():
            yield i, js[fit][np.argsort(-bound[fit], kind="stable")]


def _open_rows(open_: DataFrame, batches: int, num: int, den: int) -> DataFrame:
    """The rows of open tiles that some row of another component may link with, by their bitmaps."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf, spans = spans_of(pdf, TILE, "node")
        size, comp, block, i, j = (pdf[c].to_numpy() for c in ("size", "component", "_b", "_i", "_j"))
        bits, hit = pdf["bits"].to_numpy(), np.zeros(len(pdf), dtype=bool)
        for s, e in spans:
            names = np.unique(comp[s:e], return_inverse=True)[1]
            if names.any():
                for x, js in _partners(folded(bits[s:e]), size[s:e], names, block[s:e], i[s] == j[s], num, den):
                    hit[s + x] = True
                    hit[s + js] = True
        return pdf.loc[hit, [*TILE, "_b", "node", "size", "component"]]

    return each_tile(open_, TILE, batches, run, "sig long, _i int, _j int, _b int, node long, size long, component long")


def _close(rows: DataFrame, batches: int, num: int, den: int) -> DataFrame:
    """Links that join the components of each tile, as few as that takes: bitmaps first, then sorted arrays."""

    def one(sets, size, node, comp, block, within):
        root = list(range(int(comp.max()) + 1))

        def top(c):
            while root[c] != c:
                root[c] = root[root[c]]
                c = root[c]
            return c

        maps = folded([bitmap(x).tobytes() for x in sets])
        for i, js in _partners(maps, size, comp, block, within, num, den):
            for j in js:
                a, b = top(comp[i]), top(comp[j])
                if a != b and linked(sets[i], sets[j], num, den):
                    root[max(a, b)] = min(a, b)
                    yield min(node[i], node[j]), max(node[i], node[j])

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf, spans = spans_of(pdf, TILE, "node")
        size, node, comp, block, i, j = (pdf[c].to_numpy() for c in ("size", "node", "component", "_b", "_i", "_j"))
        sets, out = [np.frombuffer(x, dtype=np.uint64) for x in pdf["elements"]], []
        for s, e in spans:
            names = np.unique(comp[s:e], return_inverse=True)[1]
            out += one(sets[s:e], size[s:e], node[s:e], names, block[s:e], i[s] == j[s])
        return pd.DataFrame(out, columns=["a", "b"], dtype=np.int64)

    return each_tile(rows, TILE, batches, run, "a long, b long")


def join_components(docs: DataFrame, scratch: Scratch, words: int = 3, num: int = 90, den: int = 100) -> DataFrame:
    """Link documents whose shingle sets have Jaccard of at least num/den, exactly, and name their components.

    Text is lower-cased in A-Z and cut into words at ASCII white space; a set is its
    distinct shingles of ``words`` words (the whole sequence where there are fewer).
    Documents with equal sets form a class, named by its least doc_id. Classes are
    placed in bands of near size, and each set is cut by hash range into so many parts
    that two linked sets of a band must agree in one that both name; classes that share
    a part make a tile. In each tile all are first compared with the least class. Tiles
    (those of the same classes once) whose others still lie in several components are
    closed within their task: pairs across components whose hashed bitmaps allow the
    overlap are verified by their sorted arrays, until none is left or the tile is one
    component. So no link that would join components is missed, and what a tile hands
    on is never more than its rows. Tiles of over ``TILE_ROWS`` rows or
    ``TILE_SHINGLES`` shingles are dealt as pairs of blocks.

    Returns doc_id, n_shingles, component_id (the least doc_id reachable). Texts that
    are null or have no word have size 0 and link with nothing. Rows of one doc_id are
    one node; a null doc_id links with nothing and has a null component. An empty
    table gives no rows; further columns change nothing.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    rows = scratch.keep(_digest(docs, words), "names")
    docs = docs.where("doc_id IS NOT NULL")
    key = ["n_shingles", "h1", "h2"]
    named = rows.where("doc_id IS NOT NULL AND n_shingles > 0")
    total, many = rows.agg(F.coalesce(F.sum("n_shingles"), F.lit(0)), F.count("*")).first()
    classes = scratch.keep(named.groupBy(*key).agg(F.min("doc_id").alias("node"), F.count("*").alias("copies")), "classes", rows=many)
    same = named.join(classes.where("copies > 1"), key).select(F.col("node").alias("a"), F.col("doc_id").alias("b")).where("a < b")
    # one exchange serves the counting and both sides of the join, as all have the same number of partitions
    tasks = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-total // DEALT_SHINGLES))
    spread = _parts(docs, words, num, den).repartition(tasks, "sig")
    shared = spread.groupBy("sig").agg(F.min("h").alias("low"), F.max("h").alias("high"), F.min("c").alias("c0"), F.max("c").alias("c1")).where("low < high OR c0 < c1").select("sig")
    met = scratch.keep(spread.join(shared, "sig").distinct(), "met")
    del spread, shared  # lets Spark clean up their shuffles
    whose = classes.select(F.col("h1").bitwiseAND(NAME).alias("h"), F.shiftright(F.shiftleft("h2", 32), 32).cast("int").alias("c"), "node", F.col("n_shingles").alias("size"))
    members = met.join(whose, ["h", "c"]).select("sig", "node", "size")
    lows = members.groupBy("sig").agg(F.min("node").alias("low"))
    tiles = scratch.keep(members.join(lows, "sig").where("node > low"), "tiles", rows=met.count())
    scratch.drop(met)

    involved = scratch.keep(tiles.select("node").union(tiles.select("low")).distinct(), "involved", rows=many)
    sets = scratch.keep(_bits(_texts_of(docs, involved), words), "bits")
    stars = scratch.keep(tiles.select(F.col("low").alias("a"), F.col("node").alias("b")).distinct(), "stars", rows=tiles.count())
    links = _verify(scratch.keep(_bounded(stars, sets, num, den), "near", rows=stars.count(), each=PAIRS), docs, words, num, den, scratch)

    who = tiles.groupBy("sig").agg(F.count("*").alias("rows"), F.sum("size").alias("weight"), F.bit_xor(F.xxhash64("node")).alias("x1"), F.bit_xor(F.xxhash64("node", F.lit(1))).alias("x2")).where("rows > 1")
    once = who.groupBy("rows", "x1", "x2").agg(F.min("sig").alias("sig"), F.first("weight").alias("weight")).select("sig", "rows", "weight")
    comp = connected_components(links, scratch)
    labelled = tiles.join(once, "sig").join(comp, "node", "left").select("sig", "node", "size", "rows", "weight", F.coalesce("component", "node").alias("component"))
    labelled = scratch.keep(labelled, "labelled", rows=tiles.count())
    split = labelled.groupBy("sig").agg(F.min("component").alias("c0"), F.max("component").alias("c1")).where("c0 < c1").select("sig")
    open_ = scratch.keep(labelled.join(split, "sig"), "open", rows=labelled.count())
    blocks = F.greatest(F.ceil(F.col("rows") / TILE_ROWS), F.ceil(F.col("weight") / TILE_SHINGLES))
    shingles_in = lambda df: df.agg(F.sum(F.col("size") * blocks)).first()[0] or 0
    if load := shingles_in(open_):
        dealt = tile(open_.join(sets.select("node", "bits"), "node"), blocks, F.col("node")).drop("rows", "weight")
        hit = scratch.keep(_open_rows(dealt, -(-load // BATCH_SHINGLES), num, den), "hit", rows=load, each=BATCH_SHINGLES)
        if load := hit.agg(F.sum("size")).first()[0]:
            exact = scratch.keep(_elements(_texts_of(docs, hit.select("node").distinct()), words), "exact")
            links = links.union(scratch.keep(_close(hit.join(exact, "node"), -(-load // BATCH_SHINGLES), num, den), "links", rows=load, each=BATCH_SHINGLES))
            scratch.drop(exact)
    scratch.drop(sets, tiles)
    comp = connected_components(same.union(links), scratch)
    out = rows.select("doc_id", "n_shingles").join(comp.withColumnRenamed("node", "doc_id"), "doc_id", "left")
    result = scratch.keep(out.select("doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component_id")), "result", rows=many)
    scratch.drop(rows)
    return result


def keep_firsts(docs: DataFrame, scratch: Scratch, **params) -> DataFrame:
    """The documents in their columns, one of each linked group: the row of the least doc_id, once.

    Rows with a null doc_id are linked with nothing and all stay. Of several rows of
    one doc_id the one with the least text stays. Dropped ids reach the executors by
    broadcast up to ``MAX_BROADCAST_IDS`` and by a shuffled join beyond.
    """
    found = join_components(docs, scratch, **params)
    lost = found.where("component_id <> doc_id").select(F.col("doc_id").alias("_id")).distinct()
    many = found.where("doc_id IS NOT NULL").groupBy("doc_id").count().where("count > 1").select(F.col("doc_id").alias("_id"))
    drop = scratch.keep(lost.withColumn("_lost", F.lit(True)).unionByName(many.withColumn("_lost", F.lit(False))).groupBy("_id").agg(F.max("_lost").alias("_lost")), "dropped", rows=found.count())
    drop = F.broadcast(drop) if drop.count() <= MAX_BROADCAST_IDS else drop
    rows = docs.select(F.struct(*docs.columns).alias("_row"), F.col("doc_id").cast("long").alias("_id")).join(drop, "_id", "left")
    alone = rows.where("_lost IS NULL").select("_row")
    again = rows.where("NOT _lost").groupBy("_id").agg(F.min_by("_row", F.struct(F.col("_row.text"), F.xxhash64("_row"))).alias("_row")).select("_row")
    return alone.union(again).select("_row.*")
