"""Language identification by prediction by partial matching over bytes, with frozen statistics."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pinweave.llm.rows import map_texts
from pinweave.runtime import Scratch, broadcast_if_small

ORDER = 3  # bytes of context at most; a context and its symbol fill 32 bits
SAMPLE_DOCS = 3000  # expected training documents for each language
PIECE = 1 << 18  # bytes scored at once
PAD = b" " * ORDER
LETTER = regex.compile(r"\p{L}")
U = np.uint32


def split_flag(doc_id):
    """Whether crc32(doc_id as text) mod 4 is 2; null for a null doc_id."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2


def folded(text: str) -> bytes:
    """The bytes that are coded: UTF-8 with A-Z as a-z, all else as it is."""
    return text.encode("utf-8", "surrogatepass").lower()


def windows(data: bytes, order: int = ORDER) -> np.ndarray:
    """The code of each context of ``order`` bytes with the byte that follows it."""
    x = np.frombuffer(data, dtype=np.uint8)
    code = x[: len(x) - order].astype(U)
    for k in range(1, order + 1):
        code <<= U(8)
        code |= x[k : len(x) - order + k]
    return code


def _grams(sample: DataFrame) -> DataFrame:
    """Counts of context and byte by language: lang, code, n."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for lang, part in pdf.groupby("lang"):
                for at in range(0, len(part), 200):
                    code, n = np.unique(np.concatenate([windows(PAD + folded(t)) for t in part["text"].iloc[at : at + 200]]), return_counts=True)
                    yield pd.DataFrame({"lang": lang, "code": code.astype(np.int64), "n": n})

    return sample.mapInPandas(count, "lang string, code long, n long").groupBy("lang", "code").agg(F.sum("n").alias("n"))


class Trees:
    """The languages' byte context trees, frozen and side by side.

    For each order k there are the contexts with their following byte that occurred in
    any language (``grams``, sorted codes of k + 1 bytes) with the full code length of
    that byte in every language (``bits``), and the contexts (``known``) with the cost
    of escaping from each (``escape``; nothing in a language that never saw it). The
    longest context that occurred predicts; a byte new to it costs the escape (distinct
    over total plus distinct) and is predicted by the next shorter one, down to 1 in 256.
    """

    def __init__(self, counts: list[tuple[np.ndarray, np.ndarray]], order: int = ORDER):
        self.size, self.levels = len(counts), []
        for k in range(order + 1):
            own = []
            for codes, n in counts:
                gram, at = np.unique(codes.astype(U) & self._mask(k), return_inverse=True)
                own.append((gram, np.bincount(at, weights=n, minlength=len(gram))))
            grams = np.unique(np.concatenate([g for g, _ in own])) if own else np.empty(0, dtype=U)
            known, at = np.unique(self._context(grams), return_inverse=True)
            bits, escape = np.empty((len(grams), self.size)), np.zeros((len(known), self.size))
            for j, (gram, n) in enumerate(own):
                count = np.zeros(len(grams))
                count[np.searchsorted(grams, gram)] = n
                distinct = np.bincount(at, weights=count > 0, minlength=len(known))
                total = np.bincount(at, weights=count, minlength=len(known)) + distinct
                seen = distinct > 0
                escape[seen, j] = np.log2(total[seen] / distinct[seen])
                with np.errstate(divide="ignore", invalid="ignore"):
                    bits[:, j] = np.where(count > 0, np.log2(total[at]) - np.log2(count), np.inf)
            lower = self.code_lengths(grams, k - 1)
            bits = np.where(np.isfinite(bits), bits, escape[at] + lower)
            self.levels.append((grams, bits.astype(np.float32), known, escape.astype(np.float32)))

    @staticmethod
    def _mask(k: int) -> np.uint32:
        return U((1 << 8 * (k + 1)) - 1)

    @staticmethod
    def _context(grams: np.ndarray) -> np.ndarray:
        return grams >> U(8)

    def code_lengths(self, codes: np.ndarray, order: int | None = None) -> np.ndarray:
        """Bits of each code's last byte after the bytes before it, by language."""
        order = len(self.levels) - 1 if order is None else order
        out = np.zeros((len(codes), self.size), dtype=np.float32)
        todo = slice(None)  # rows not predicted yet
        for k in range(order, -1, -1):
            grams, bits, known, escape = self.levels[k]
            cur = codes[todo] & self._mask(k)
            if not len(grams) or not len(cur):
                continue
            at = np.minimum(np.searchsorted(grams, cur), len(grams) - 1)
            hit = grams[at] == cur
            if isinstance(todo, slice):
                np.take(bits, at, axis=0, out=out)
                todo = np.flatnonzero(~hit)
                out[todo] = 0
            else:
                out[todo[hit]] += bits[at[hit]]
                todo = todo[~hit]
            if not len(todo):
                return out
            context = self._context(cur[~hit])
            at = np.minimum(np.searchsorted(known, context), len(known) - 1)
            out[todo] += np.where((known[at] == context)[:, None], escape[at], np.float32(0))
        out[todo] += 8
        return out

    def total_bits(self, texts: list[bytes]) -> np.ndarray:
        """Code length of each text in each language; every byte counts."""
        out = np.zeros((len(texts), self.size))
        held, size, at = [], 0, []

        def flush():
            nonlocal held, size, at
            if at:
                bits = self.code_lengths(windows(b"".join(held)))
                bits = np.concatenate([bits, np.zeros((ORDER + 1, self.size), dtype=np.float32)])
                edges = np.array([e for _, s, n in at for e in (s, s + n)])
                sums = np.add.reduceat(bits, edges, axis=0, dtype=np.float64)[::2]
                np.add.at(out, [i for i, _, _ in at], sums)
            held, size, at = [], 0, []

        for i, text in enumerate(texts):
            coded = PAD + text
            for first in range(0, len(text), PIECE):
                part = coded[first : first + PIECE + ORDER]
                at.append((i, size, len(part) - ORDER))
                held.append(part)
                size += len(part)
                if size >= PIECE:
                    flush()
        flush()
        return out


def identify(docs: DataFrame, scratch: Scratch, carry: bool = False) -> DataFrame:
    """Predict the language of every whole text.

    Trains on text and lang of rows outside the held-out quarter (crc32 of the
    doc_id's digits mod 4 is not 2) whose lang is known: a sample by hash of doc_id of
    SAMPLE_DOCS expected documents for each language, all of them where there are
    fewer, which bounds the counts that the driver gets. Each language's byte context
    tree of depth ORDER is then frozen, and a text goes to the language with the
    shortest code (ties: the first by name).

    Returns doc_id, held_out, lang_pred and score, the share of the winner among
    2 ** -bits. Null texts and texts without a letter are ``und`` with score 0, and so
    is every text when nothing can be learned. A null doc_id is neither held out nor
    learned from; repeated rows are predicted alike; an empty table gives no rows.
    With ``carry`` text comes along, and the other columns as the struct ``_row``.
    """
    spark = docs.sparkSession
    train = docs.where(~split_flag(F.col("doc_id")) & F.col("lang").isNotNull() & F.col("text").isNotNull()).select("doc_id", "lang", "text")
    rate = train.groupBy("lang").agg((F.lit(float(SAMPLE_DOCS)) / F.count("*")).alias("rate"))
    draw = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) / F.lit(float(1 << 30))
    sample = scratch.keep(train.join(broadcast_if_small(rate, 10_000), "lang").where(draw < F.col("rate")).select("lang", "text"), "sample")
    rows = dict(list(_grams(sample).toPandas().groupby("lang")))
    scratch.drop(sample)
    names = sorted(rows)
    shared = spark.sparkContext.broadcast(Trees([(rows[k]["code"].to_numpy(), rows[k]["n"].to_numpy()) for k in names]))

    def make():
        def work(texts):
            known = [i for i, t in enumerate(texts) if names and t and LETTER.search(t)]
            pred, score = ["und"] * len(texts), [0.0] * len(texts)
            if known:
                bits = shared.value.total_bits([folded(texts[i]) for i in known])
                sure = 1 / np.exp2(np.maximum(bits.min(axis=1, keepdims=True) - bits, -1000)).sum(axis=1)
                for i, k, s in zip(known, bits.argmin(axis=1).tolist(), sure.tolist(), strict=True):
                    pred[i], score[i] = names[k], s
            return [pred, score]

        return work

    flagged = docs.select("doc_id", F.coalesce(split_flag(F.col("doc_id")), F.lit(False)).alias("held_out"), "text", *([F.struct(*[c for c in docs.columns if c != "text"]).alias("_row")] if carry else []))
    return map_texts(flagged, make, [("lang_pred", pa.string(), "string"), ("score", pa.float64(), "double")], drop=not carry)


def keep_identified(docs: DataFrame, scratch: Scratch, least_score: float = 0.5) -> DataFrame:
    """The documents in their columns with lang as predicted, without those that are ``und`` or predicted below ``least_score``."""
    done = identify(docs, scratch, carry=True).where((F.col("lang_pred") != "und") & (F.col("score") >= least_score))
    return done.select(*[F.col("lang_pred").alias(c) if c == "lang" else F.col(c) if c == "text" else F.col(f"_row.`{c}`") for c in docs.columns])
