"""Ranked lexical search: dual-sorted wavelet trees over shards of documents, searched best node first.

In a shard the postings of a term lie in order of impact, and a wavelet matrix over their
documents' places lets the same postings be entered by ranges of documents: an interval
of a term's list maps to one interval in either half of a range and keeps its order, so
the first posting of an interval has the greatest impact there. The sum of these over an
item's terms bounds every document of the range, and the range of one document has its score.
"""

from __future__ import annotations

import heapq
import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from pinweave.llm.rows import release
from pinweave.runtime import Scratch

SHARD_POSTINGS = 1 << 20
ITEM_BYTES = 16 << 20  # of items' texts that are searched together
BEAM = 16  # nodes of an item that are opened together
SEED_PART = 16  # one document in so many (by hash) is searched first, which bounds the scores that count in all others
IMPACT_BITS, PLACE_BITS = 20, 20  # an impact is less than 1e9 / 1200

TABLE = bytes(b if b >= 0x80 or chr(b).isalnum() else 0x20 for b in range(256)).lower()


def terms_of(text: str | None) -> list[bytes]:
    """The terms of a whole text: runs of ASCII letters, digits and other scripts' characters, A-Z lower-cased."""
    return text.encode("utf-8", "surrogatepass").translate(TABLE).split() if text else []


def postings(docs: DataFrame, vocabulary, column: str = "text") -> DataFrame:
    """``(doc_id, n, ids, tfs)`` of documents with a term: the number of terms, and the terms of the (broadcast) vocabulary with their counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = vocabulary.value
        for batch in batches:
            ns, ids, tfs, keep = [], [], [], []
            for i, text in enumerate(batch.column(column).to_pylist()):
                words = terms_of(text)
                if words:
                    got = [(known[t], c) for t, c in Counter(words).items() if t in known]
                    keep.append(i)
                    ns.append(len(words))
                    ids.append([t for t, _ in got])
                    tfs.append([c for _, c in got])
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(pa.array(keep, pa.int64())), pa.array(ns, pa.int64()), pa.array(ids, pa.list_(pa.int32())), pa.array(tfs, pa.list_(pa.int64()))], names=["doc_id", "n", "ids", "tfs"])
        release()

    return docs.select("doc_id", column).mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n long, ids array<int>, tfs array<long>")


def lengths_norm(n: np.ndarray, documents: int, terms: int) -> np.ndarray:
    """m of documents of n terms each, by integers."""
    if len(n) and 75 * int(n.max()) * documents >= 1 << 62:
        return np.array([25 + 75 * int(x) * documents // terms for x in n], dtype=np.int64)
    return 25 + 75 * n * documents // terms


def weight_of(df: int, documents: int) -> int:
    return math.floor(1000 * math.log((2 * documents + 2) / (2 * df + 1)))


class Shard:
    """The dual-sorted index of up to 2**20 documents: ``term, place, impact`` are parallel arrays, places run from 0 in order of doc_id."""

    def __init__(self, term: np.ndarray, place: np.ndarray, impact: np.ndarray, n: int):
        self.n, self.levels = n, max(1, (n - 1).bit_length())
        most = (1 << IMPACT_BITS) - 1
        key = (term.astype(np.int64) << (IMPACT_BITS + PLACE_BITS)) | ((most - impact) << PLACE_BITS) | place
        key.sort()
        term = key >> (IMPACT_BITS + PLACE_BITS)
        self.terms, first = np.unique(term, return_index=True)
        self.begin, self.end = first, np.append(first[1:], len(key))
        place, impact = (key & ((1 << PLACE_BITS) - 1)).astype(np.int32), (most - ((key >> PLACE_BITS) & most)).astype(np.int32)
        del key, term
        self.zeros = np.zeros(self.levels, dtype=np.int64)
        self.rank = np.zeros((self.levels, len(place) + 1), dtype=np.int32)  # zero bits ahead of each position
        self.impact = np.zeros((self.levels + 1, len(place)), dtype=np.int32)
        for level in range(self.levels):
            self.impact[level] = impact
            low = (place >> (self.levels - 1 - level)) & 1 == 0
            np.cumsum(low, out=self.rank[level, 1:])
            self.zeros[level] = self.rank[level, -1]
            place, impact = np.concatenate([place[low], place[~low]]), np.concatenate([impact[low], impact[~low]])
        self.impact[self.levels] = impact

    def children(self, level: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[tuple, tuple]:
        """Where intervals of positions on their levels go in the lower and in the upper half of their nodes."""
        s, e = self.rank[level, start].astype(np.int64), self.rank[level, end].astype(np.int64)
        z = self.zeros[level]
        return (s, e), (z + start - s, z + end - e)

    def roots(self, item: list[tuple[int, int]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Intervals of an item's terms ``(term, weight)`` that the shard holds, and their weights."""
        ids = np.array([t for t, _ in item], dtype=np.int64)
        at = np.searchsorted(self.terms, ids)
        held = (at < len(self.terms)) & (self.terms[np.minimum(at, len(self.terms) - 1)] == ids)
        at = at[held]
        return self.begin[at], self.end[at], np.array([w for _, w in item], dtype=np.int64)[held]


class Search:
    """One item's progress in a shard: open nodes by bound, then by their first place, and the scores found so far."""

    def __init__(self, k: int, least: int):
        self.k, self.least, self.heap, self.found, self.best = k, least, [], [], []

    def push(self, bound: int, low: int, level: int, leaf: bool, held: tuple) -> None:
        if bound < self.least:
            return
        if leaf:  # the k-th best score known bounds what counts
            if len(self.best) < self.k:
                heapq.heappush(self.best, bound)
            else:
                heapq.heappushpop(self.best, bound)
            if len(self.best) == self.k:
                self.least = max(self.least, self.best[0])
        heapq.heappush(self.heap, (-bound, low, level, leaf, held))

    def next(self, beam: int) -> list[tuple]:
        """Take the documents that nothing open can precede, then the best nodes to open; empty when the item is done."""
        nodes, aside = [], []
        while self.heap and len(self.found) < self.k and len(nodes) < beam:
            top = self.heap[0]
            if -top[0] < self.least:
                break
            heapq.heappop(self.heap)
            if not top[3]:
                nodes.append(top)
            elif nodes:
                aside.append(top)
            else:
                self.found.append((top[1], -top[0]))
        for leaf in aside:
            heapq.heappush(self.heap, leaf)
        return nodes


def search_shard(shard: Shard, items: list[list[tuple[int, int]]], k: int, least: list[int]) -> list[list[tuple[int, int]]]:
    """The k best ``(place, score)`` of each item, scores above 0 and not below the item's ``least``, equal scores by place.

    Items are searched side by side: each round opens the best nodes of all of them in
    one go over arrays.
    """
    runs = []
    for item, low in zip(items, least, strict=True):
        run = Search(k, max(1, low))
        s, e, w = shard.roots(item)
        if len(s):
            run.push(int((w * shard.impact[0, s]).sum()), 0, 0, False, (s, e, w))
        runs.append(run)
    live = runs
    while live:
        opened = [(run, node) for run in live for node in run.next(BEAM)]
        if not opened:
            break
        n = np.array([len(node[4][0]) for _, node in opened])
        start, end, w = (np.concatenate([node[4][i] for _, node in opened]) for i in range(3))
        level = np.array([node[2] for _, node in opened])
        own = np.repeat(np.arange(len(opened)), n)
        halves = shard.children(level[own], start, end)
        for high, (s, e) in enumerate(halves):
            keep = np.flatnonzero(e > s)
            if not len(keep):
                continue
            ks, ke, kw, ko = s[keep], e[keep], w[keep], own[keep]
            cut = np.flatnonzero(np.concatenate([[True], ko[1:] != ko[:-1]]))
            bounds = np.add.reduceat(kw * shard.impact[level[ko] + 1, ks], cut).tolist()
            edge = [*cut.tolist(), len(ko)]
            for j, of in enumerate(ko[cut].tolist()):
                run, node = opened[of]
                below, a, b = node[2] + 1, edge[j], edge[j + 1]
                if bounds[j] >= run.least:
                    run.push(bounds[j], node[1] | (high << (shard.levels - below)), below, below == shard.levels, (ks[a:b], ke[a:b], kw[a:b]))
        live = [run for run in live if run.heap and len(run.found) < k]
    return [run.found for run in runs]


def search_tables(rows: DataFrame, plan, k: int, least) -> DataFrame:
    """``(item, doc_id, score)``: the best documents of each item in each shard; a shard is a run of a task's rows of bounded postings."""
    kind = to_arrow_type(rows.schema["doc_id"].dataType)

    def flush(ids, ns, place, term, tf):
        items, documents, terms = plan.value
        order = np.array(sorted(range(len(ids)), key=lambda i: (ids[i] is None, ids[i] if ids[i] is not None else 0)))
        spot = np.empty(len(ids), dtype=np.int64)
        spot[order] = np.arange(len(ids))
        m = lengths_norm(np.array(ns, dtype=np.int64), documents, terms)
        place, term, tf = np.concatenate(place), np.concatenate(term), np.concatenate(tf)
        impact = (1_000_000_000 * tf) // (1000 * tf + 8 * m[place])
        shard = Shard(term, spot[place], impact, len(ids))
        del place, term, tf, impact
        found = search_shard(shard, items, k, least.value)
        got = [(i, ids[order[at]], score) for i, best in enumerate(found) for at, score in best]
        return pa.RecordBatch.from_arrays([pa.array([g[0] for g in got], pa.int64()), pa.array([g[1] for g in got], kind), pa.array([g[2] for g in got], pa.int64())], names=["item", "doc_id", "score"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = ([], [], [], [], []), 0
        for batch in batches:
            ids, ns = batch.column("doc_id").to_pylist(), batch.column("n").to_numpy()
            of, count = batch.column("ids"), batch.column("tfs")
            edges = of.offsets.to_numpy() - of.offsets[0].as_py()
            flat, tfs = of.flatten().to_numpy().astype(np.int64), count.flatten().to_numpy()
            at = 0
            while at < len(ids):
                end = max(at + 1, int(np.searchsorted(edges, edges[at] + SHARD_POSTINGS - size, side="right")) - 1)
                end = min(end, len(ids), at + (1 << PLACE_BITS) - len(held[0]))
                lens = np.diff(edges[at : end + 1])
                held[2].append(np.repeat(np.arange(len(held[0]), len(held[0]) + end - at), lens))
                held[3].append(flat[edges[at] : edges[end]])
                held[4].append(tfs[edges[at] : edges[end]])
                held[0].extend(ids[at:end])
                held[1].extend(ns[at:end].tolist())
                size += int(edges[end] - edges[at])
                at = end
                if size >= SHARD_POSTINGS or len(held[0]) >= 1 << PLACE_BITS:
                    yield flush(*held)
                    held, size = ([], [], [], [], []), 0
                elif at < len(ids) and size + int(edges[at + 1] - edges[at]) > SHARD_POSTINGS:
                    yield flush(*held)
                    held, size = ([], [], [], [], []), 0
        if size:
            yield flush(*held)
        release()

    return rows.mapInArrow(run, f"item long, doc_id {rows.schema['doc_id'].dataType.simpleString()}, score long")


def best_of(found: DataFrame, k: int) -> DataFrame:
    """The k best rows of each item over all shards, ranked; each task cuts its own before rows are shuffled."""
    order = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def rank(docs: DataFrame, items: DataFrame, scratch: Scratch, k: int = 10) -> DataFrame:
    """``(item_id, rank, doc_id, score)``: the k best documents of each item, exactly.

    docs: doc_id, text and more; items: item_id, text. Statistics are over all documents
    with a term. A first search over a hashed part of the documents bounds each item's
    k-th best score from below, which lets shards of the full search stop early; results
    do not depend on it. Items are taken in blocks of bounded text, one search each.

    Null and empty texts have no terms, match nothing and are not counted; documents of
    score 0 are not listed; equal scores are by doc_id, a null one last. Repeated rows of
    documents are documents of their own, repeated rows of items are ranked each. Without
    documents or items there are no rows.
    """
    spark, sc = docs.sparkSession, docs.sparkSession.sparkContext
    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"item_id {items.schema['item_id'].dataType.simpleString()}, rank int, doc_id {kind}, score long"
    asked = scratch.keep(items.select("item_id", "text").where("text IS NOT NULL").withColumn("_h", F.xxhash64("item_id", "text")), "items")
    blocks = max(1, math.ceil((asked.agg(F.sum(F.octet_length("text"))).first()[0] or 0) / ITEM_BYTES))
    out = None
    for block in range(blocks):
        rows = [(r["item_id"], Counter(terms_of(r["text"]))) for r in asked.where(F.pmod("_h", F.lit(blocks)) == block).collect()]  # ITEM_BYTES of text
        known = {t: i for i, t in enumerate(sorted({t for _, c in rows for t in c}))}
        if not known:
            continue
        names = sc.broadcast(known)
        table = scratch.keep(postings(docs, names).sortWithinPartitions("n"), "postings")  # shards of like lengths have tight bounds
        documents, terms = table.agg(F.count("*"), F.sum("n")).first()
        if not documents:
            continue
        df = dict(table.select(F.explode("ids").alias("id")).groupBy("id").count().collect())  # terms of the block
        weights = {t: weight_of(df[i], documents) for t, i in known.items() if i in df}
        asks = [[(known[t], c * weights[t]) for t, c in sorted(count.items()) if weights.get(t, 0) > 0] for _, count in rows]
        plan = sc.broadcast((asks, documents, terms))
        hit = table.where(F.size("ids") > 0)
        seeds = hit.where(F.pmod(F.xxhash64("doc_id", "n"), F.lit(SEED_PART)) == 0)
        least = [0] * len(asks)
        reached = best_of(search_tables(seeds, plan, k, sc.broadcast(least)), k).where(F.col("rank") == k)
        for r in reached.collect():  # one row an item of the block
            least[r["item"]] = r["score"]
        found = best_of(search_tables(hit, plan, k, sc.broadcast(least)), k)
        ids = spark.createDataFrame([(i, r[0]) for i, r in enumerate(rows)], f"item long, item_id {items.schema['item_id'].dataType.simpleString()}")
        found = scratch.keep(found.join(F.broadcast(ids), "item").select("item_id", F.col("rank").cast("int").alias("rank"), "doc_id", "score"), "ranked")
        out = found if out is None else out.union(found)
        names.destroy()
        plan.destroy()
        scratch.drop(table)
    return out if out is not None else spark.createDataFrame([], schema)
